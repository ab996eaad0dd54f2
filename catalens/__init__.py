"""Catalogue-quality analytics for music-rights data, built on Spark DataFrames."""

from catalens.plans.kpis import KPIS, register
from catalens.session import tune
from catalens.sources.catalogue import load_catalogue

__all__ = ["KPIS", "load_catalogue", "register", "tune"]
