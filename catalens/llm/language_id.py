"""Language identification: words first, then ever shorter character n-grams.

Training counts words per language in labelled documents.  A known word adds its log
frequency in every language.  A word not known backs off to the n-grams of ``^word$`` for
n = 5, 4, 3, 2, 1: the longest n with a known n-gram is used, and the known ones of that
length are averaged.  The score is the share of the predicted language in the softmax.

Words are runs of letters and marks, of the text in Unicode's composed form (NFC) and in
lower case: ``words_of`` cuts them for training and prediction alike.

The model is learned from ``SAMPLE_TEXTS`` different labelled texts of each language, those of
least hash, so every labelled language is learned, copies count once, and the same texts are
taken whatever the partitioning.  All that these texts hold is kept.  Every whole text is
judged; nothing but the text is looked at.

``accepted`` keeps documents that are language: of their characters beside blanks and
digits, ``MIN_LETTERS`` are letters or marks, and ``MIN_KNOWN`` of their words are known or
reach an n-gram of ``LONG_GRAM``.  Neither rule punishes short texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing was labelled.  Languages with equal scores go to the first by code point.
Repeated rows are judged alike.  Very long texts are judged whole.  Other columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.shared import map_texts, releasing, ship_package, written

SAMPLE_TEXTS = 1000
#: How many times as many texts are looked at for the sample; their number is estimated.
AMPLE = 3
LONGEST_GRAM = 5
LONG_GRAM = 3
UNKNOWN = "und"
MIN_LETTERS = 2 / 3
MIN_KNOWN = 0.5
#: Words whose scores a worker remembers before it starts afresh.
REMEMBERED = 400_000
SMOOTHING = 0.5
#: Entries a task counts before it hands them on.
COUNTED = 200_000
ENTRIES = "lang string, level int, entry string, n long"


@cache
def letters() -> re.Pattern:
    """Runs of letters and marks, as Unicode's categories have them."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in "LM":
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


ASCII_LETTERS = re.compile("[a-z]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it has no letter."""
    if not text:
        return []
    if text.isascii():
        return ASCII_LETTERS.findall(text.lower())
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    words = letters().findall(text.lower())
    # Marks alone are no word.
    return words if any(map(str.isalpha, text)) else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def sampled(labelled: DataFrame, sample_texts: int) -> DataFrame:
    """(lang, text): the ``sample_texts`` different texts of least hash of each language."""
    hashed = F.xxhash64("text").alias("hash")
    # Written tables of one row per language: their known size keeps texts from being shuffled.
    sizes = labelled.select("lang", hashed).groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"))
    chance = F.lit(float(AMPLE * sample_texts)) / F.greatest("texts", F.lit(1))
    chances = written(sizes.select("lang", chance.alias("chance")), "languages")
    # The least hashes of a language, a few times as many as are taken, whatever its size.
    low = labelled.select("lang", hashed).join(chances, "lang").where(F.col("hash") / F.lit(2.0**64) + F.lit(0.5) < F.col("chance"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    least = low.select("lang", "hash").distinct().withColumn("rank", rank).where(F.col("rank") <= sample_texts)
    last = written(least.groupBy("lang").agg(F.max("hash").alias("last")), "last-hashes")
    rows = labelled.select("lang", "text", hashed).join(last, "lang").where("hash <= last")
    return rows.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")


def entry_counts(sample: DataFrame) -> DataFrame:
    """(lang, level, entry, n): words (level 0) and n-grams (level n) of the sample."""
    ship_package(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[tuple[str, str]] = Counter()

        def counted() -> pa.RecordBatch:
            entries: Counter[tuple[str, int, str]] = Counter()
            for (lang, word), n in words.items():
                entries[lang, 0, word] += n
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, size):
                        entries[lang, size, gram] += n
            langs, levels, names = zip(*entries) if entries else ((), (), ())
            columns = [pa.array(langs, pa.string()), pa.array(levels, pa.int32()), pa.array(names, pa.string()), pa.array(list(entries.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "level", "entry", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for word in words_of(text.as_py()):
                    words[lang, word] += 1
                if len(words) > COUNTED:
                    yield counted()
                    words.clear()
        yield counted()

    partial = sample.select("lang", "text").mapInArrow(releasing(run), ENTRIES)
    return partial.groupBy("lang", "level", "entry").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies per language: of words (level 0) and of n-grams (level n)."""

    def __init__(self, counts: pa.Table):
        """``counts``: (lang, level, entry, n), one row each."""
        self.langs = sorted(counts.column("lang").unique().to_pylist(), key=lambda s: s.encode())
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.levels: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        levels = counts.column("level").to_numpy()
        for level in range(LONGEST_GRAM + 1):
            own = counts.filter(pa.array(levels == level)).sort_by([("entry", "ascending"), ("lang", "ascending")])
            coded = own.column("entry").combine_chunks().dictionary_encode()
            if not len(coded):
                continue
            raw = np.zeros((len(coded.dictionary), len(self.langs)))
            columns = np.array([place[x] for x in own.column("lang").to_pylist()])
            np.add.at(raw, (coded.indices.to_numpy(), columns), own.column("n").to_numpy())
            base = np.log(raw.sum(axis=0) + SMOOTHING * (len(raw) + 1))
            logs = np.log(raw + SMOOTHING) - base
            # Only differences between languages matter for the answer.
            self.logs[level] = (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
            self.levels[level] = dict(zip(coded.dictionary.to_pylist(), range(len(raw))))

    def word_score(self, word: str) -> tuple[np.ndarray, int]:
        """A word's scores and where they are from: n of its n-grams, 0 if none is known; a
        known word counts as longer than any n-gram."""
        known = self.levels.get(0, {}).get(word)
        if known is not None:
            return self.logs[0][known], LONGEST_GRAM + 1
        for n in range(LONGEST_GRAM, 0, -1):
            entries = self.levels.get(n, {})
            found = [entries[g] for g in grams_of(word, n) if g in entries]
            if found:
                return self.logs[n][found].sum(axis=0) / np.float32(len(found)), n
        return np.zeros(len(self.langs), dtype=np.float32), 0


class Scorer:
    """A model with the scores of the words it has met lately."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.empty((1024, max(1, len(self.model.langs))), dtype=np.float32)
        self.reach = np.empty(1024, dtype=np.int8)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Places of the words' scores."""
        if len(self.places) > REMEMBERED:
            self.forget()
        places = self.places
        if missing := set(words).difference(places):
            need = len(places) + len(missing)
            if need > len(self.scores):
                more = 2 * need - len(self.scores)
                self.scores = np.concatenate((self.scores, np.empty((more, self.scores.shape[1]), dtype=np.float32)))
                self.reach = np.concatenate((self.reach, np.empty(more, dtype=np.int8)))
            for word in missing:
                at = len(places)
                self.scores[at], self.reach[at] = self.model.word_score(word)
                places[word] = at
        return np.fromiter(map(places.__getitem__, words), dtype=np.int32, count=len(words))

    def judged(self, words: list[str]) -> tuple[str, float, float]:
        """The language, its score, and the share of words known or reaching ``LONG_GRAM``."""
        if not words or not self.model.langs:
            return UNKNOWN, 0.0, 0.0
        index = self.look_up(words)
        total = self.scores[index].sum(axis=0, dtype=np.float64)
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum()), float((self.reach[index] >= LONG_GRAM).mean())

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judged(words_of(text))[:2]

    def accepts(self, text: str | None, min_letters: float = MIN_LETTERS, min_known: float = MIN_KNOWN) -> bool:
        words = words_of(text)
        lang, _, known = self.judged(words)
        if lang == UNKNOWN or known < min_known:
            return False
        spelled = sum(map(len, words))
        others = sum(map(len, text.split())) - sum(map(len, DIGITS.findall(text))) - spelled
        return spelled >= min_letters * (spelled + max(0, others))


DIGITS = re.compile(r"\d+")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """A model from the documents with a text and a language."""
    usable = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null"
    )
    # Bounded by the texts sampled for each language, not by the corpus.
    return Model(written(entry_counts(sampled(usable, sample_texts)), "entries").toArrow())


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())}

    def start():
        scorer = Scorer(held.value)
        return lambda texts: list(zip(*map(scorer.predict, texts))) or [[], []]

    return map_texts(docs, text_col, keep, new, start)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_letters: float = MIN_LETTERS, min_known: float = MIN_KNOWN) -> DataFrame:
    """The documents that are language; columns as they are."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pd.Series([scorer.accepts(t if isinstance(t, str) else None, min_letters, min_known) for t in texts], dtype=bool)

    @F.pandas_udf(T.BooleanType())
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from releasing(judged)(batches)

    return docs.where(passes(F.col(text_col)))
