from __future__ import annotations

import math
import random
import unicodedata
import zlib

import pytest

from catalens.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(truth)
    held = [r for r in truth if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in held}
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def labelled():
    rows = [(i, "the cat sat on the mat with that hat", "en") for i in range(20)]
    rows += [(100 + i, "le chat est sur la table avec une robe", "fr") for i in range(20)]
    return rows


def plain_words(text):
    """Runs of letters and marks, character by character."""
    out, word = [], ""
    for c in unicodedata.normalize("NFC", text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out if any(c.isalpha() for c in text or "") else []


def plain_grams(word, n):
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] or [marked]


class Plain:
    """Training and scoring in plain dictionaries, over all texts."""

    def __init__(self, rows):
        texts = sorted({(lang, text) for _, text, lang in rows if text is not None and lang is not None})
        self.langs = sorted({lang for lang, _ in texts})
        self.counts = {n: {} for n in range(6)}
        for lang, text in texts:
            for word in plain_words(text):
                for n in range(6):
                    for entry in [word] if n == 0 else plain_grams(word, n):
                        own = self.counts[n].setdefault(entry, dict.fromkeys(self.langs, 0))
                        own[lang] += 1
        self.totals = {n: {g: sum(c[g] for c in own.values()) for g in self.langs} for n, own in self.counts.items()}

    def logs(self, n, entry):
        own = self.counts[n][entry]
        logs = [math.log(own[g] + 0.5) - math.log(self.totals[n][g] + 0.5 * (len(self.counts[n]) + 1)) for g in self.langs]
        return [x - sum(logs) / len(logs) for x in logs]

    def word(self, word):
        if word in self.counts[0]:
            return self.logs(0, word)
        for n in range(5, 0, -1):
            found = [self.logs(n, g) for g in plain_grams(word, n) if g in self.counts[n]]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(self.langs)

    def predict(self, text):
        words = plain_words(text)
        if not words or not self.langs:
            return "und", 0.0
        total = [sum(x) for x in zip(*map(self.word, words))]
        odds = [math.exp(x - max(total)) for x in total]
        return self.langs[total.index(max(total))], max(odds) / sum(odds)


def test_against_a_plain_scorer(spark, documents):
    rng = random.Random(4)
    letters = {"en": "etaoin", "fr": "eéàsui", "hi": "हिन्दीभाष", "xx": "abcdé\u0301"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 7))) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(1, 30)), lang) for i, lang in enumerate(rng.choices(list(letters), k=120))]
    rows += [rows[0], rows[0], (500, None, "en"), (501, "no label", None), (502, "", "fr")]
    model, plain = language_id.train(documents(rows)), Plain(rows)
    assert model.langs == plain.langs
    asked = [(i, text(lang, rng.randrange(1, 12)) + rng.choice(["", " 12", "!", " new"])) for i, lang in enumerate(rng.choices(list(letters), k=80))]
    asked += [(100, None), (101, ""), (102, "12"), (103, "\u0301 \u0301"), (104, "ÉTÉ e\u0301te\u0301"), (105, "日本"), (106, "a b " * 50_000)]
    got = {r.doc_id: r for r in language_id.predict(documents(asked), model).collect()}
    for i, t in asked:
        lang, score = plain.predict(t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-3), t


@pytest.mark.parametrize("text", ["हिन्दी भाषा", "مُحَمَّد", "ภาษาไทย ที่", "e\u0301te\u0301"])
def test_marks_stay_in_words(spark, documents, text):
    words = plain_words(text)
    assert language_id.words_of(text) == words
    model = language_id.train(documents([*labelled(), (1, text, "xx")]))
    assert all(model.word_score(w)[1] == language_id.LONGEST_GRAM + 1 for w in words)


def test_sample_is_of_different_texts(spark, documents):
    """A language of many copies is learned, and the bound holds for each language."""
    rows = [(i, f"copy number {i % 3}", "en") for i in range(300)] + [(i, f"mot {i}x", "fr") for i in range(50)]
    usable = documents(rows).select("text", "lang")
    got = sorted(tuple(r) for r in language_id.sampled(usable, 10).collect())
    assert len(got) == len(set(got)) == 13
    assert got == sorted(tuple(r) for r in language_id.sampled(usable.repartition(7), 10).collect())


def test_defined_cases(spark, documents):
    model = language_id.train(documents(labelled() + [(1, None, "xx"), (2, "unlabelled", None)]))
    texts = [(1, None), (2, ""), (3, "12 !?"), (4, "the hat"), (5, "une table"), (6, "THE MATS"), (7, "le " * 100_000), (4, "the hat"), (None, "the")]
    got = language_id.predict(documents(texts), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr"), (6, "en"), (7, "fr"), (0, "en")]
    )
    kept = language_id.accepted(documents(texts), model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 5, 6, 7]


def test_what_is_no_language_goes(spark, documents):
    model = language_id.train(documents(labelled()))
    texts = [(1, "the hat"), (2, "the%%% hat*** that&&& mat### with$$$"), (3, "zzqx wvvj kkpq"), (4, "the 555 123 4567 89"), (5, "the hat, (that) mat."), (6, "日本語")]
    assert sorted(r.doc_id for r in language_id.accepted(documents(texts), model).collect()) == [1, 4, 5]


def test_numerals_are_no_letters(spark, documents):
    model = language_id.train(documents(labelled()))
    got = language_id.predict(documents([(1, "½ ² Ⅷ 7"), (2, "½ hat")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "und", 2: "en"}


def test_nothing_labelled_and_empty_tables(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    model = language_id.train(docs)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"und"}
    assert language_id.accepted(docs, model).collect() == []
    assert language_id.predict(docs.limit(0), model).collect() == []
