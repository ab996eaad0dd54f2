"""The confidence summaries over tables stored by recording."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from catalens.operators.colocated import StoredLinks, store_by_key
from catalens.operators.confidence import confidence
from catalens.plans import flags, kpis
from catalens.sources.catalogue import Catalogue


@dataclass(frozen=True)
class RecordingStore:
    """Recording facts, work links and tracks in as many buckets of the recording's id.

    Written once a load; each of the four summaries then joins them bucket by bucket, and
    what it shuffles is partial flags of works, credits, media and releases.
    """

    cat: Catalogue
    facts: DataFrame
    works: StoredLinks
    tracks: StoredLinks

    @classmethod
    def store(cls, cat: Catalogue, buckets: int | None = None, folder: str | None = None) -> RecordingStore:
        facts = store_by_key(flags.recording_facts(cat), "id", "facts", buckets, folder)
        links = cat["l_recording_work"].select("entity0", "entity1")
        works = StoredLinks.store(links, "entity0", "works", buckets, folder)
        tracks = StoredLinks.store(cat["track"].select("recording", "medium"), "recording", "tracks", buckets, folder)
        return cls(cat, facts, works, tracks)

    def flags(self, entity: str) -> DataFrame:
        """Every settled entity of a kind with its flags, as ``flags`` works them out."""
        if entity == "work":
            linked = self.works.joined(self.facts, "id", *flags.WORK_ROLL_UP)
            return flags.work_flags(self.cat, self.facts, linked=linked)
        if entity == "release":
            tracks = self.tracks.joined(self.facts, "id", *flags.RELEASE_ROLL_UP)
            return flags.release_flags(self.cat, self.facts, tracks=tracks)
        return kpis.ENTITY_FLAGS[entity](self.cat, self.facts)

    def summary(self, entity: str) -> DataFrame:
        """The figures of one confidence KPI."""
        return confidence(self.flags(entity), kpis.CONFIDENCE[entity])


def stored_confidence(cat: Catalogue) -> DataFrame:
    """entity, total, and the counts and mean score of each summary, over stored tables."""
    store = RecordingStore.store(cat)
    frames = []
    for entity, rules in kpis.CONFIDENCE.items():
        counts = [f"{phase}_{level}_count" for phase in ("phase1", "phase2") for level in ("high", "medium", "low")]
        figures = store.summary(entity).selectExpr(f"'{entity}' as entity", f"total_{rules.entities} as total", *counts, "average_phase2_score")
        frames.append(figures)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
