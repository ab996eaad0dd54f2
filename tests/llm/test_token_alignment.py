"""Alignment and counts against whole-text encoding and plain dictionaries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brute import prose
from tokenizers import Tokenizer

from catalens.llm import queries, token_alignment
from catalens.llm.shared import sliced

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, extra = {}, 0
    for byte in range(256):
        names[chr(byte if byte in plain else 256 + extra)] = byte
        extra += byte not in plain
    return a, b, names


def tokens(encoders, text):
    """(id, start, end) of both, or nothing."""
    a, b, names = encoders
    if not text:
        return [], []
    spelled = []
    for i in a.encode(f" {text}", add_special_tokens=False).ids:
        spelled.append((i, bytes(names[c] for c in a.id_to_token(i))))
    pieces = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        pieces.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if not b"".join(x for _, x in spelled) == b"".join(x for _, x in pieces) == f" {text}".encode():
        return [], []
    out = []
    for side in (spelled, pieces):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return tuple(out)


def brute(encoders, rows):
    docs = [tokens(encoders, t) for _, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])] for a, b in docs]
    counts = Counter(p for own in links for p in own)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (doc_id, _), (a, b), own in zip(rows, docs, links):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            part = lambda side: ",".join(str(i) for i, s, e in side if s >= start and e <= end)  # noqa: B023, E731
            groups.append(f"{part(a)}|{part(b)}")
            start = end
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        best = sum(counts[p] == top[p[1]] for p in own)
        out.append((doc_id, len(a), len(b), len(ends), len(own), best, sum(counts[p] for p in own), digest))
    return sorted(out, key=repr), counts


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "x  ", "tab\tand\r\nline ", "▁x y", "it's 'll don't", "<|endoftext|> <s> </s>"]
ODD += ["nul\0byte a", "é è ü", "日本語 テキスト です", "हिन्दी भाषा में", "😀 👩‍👩‍👧 x", "1234567890 3.14", "é t́", "a b c　d", "<0x41> x", "﻿bom a", "a​ b"]


def test_counts_and_groups(spark, documents, encoders, table_dir):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(40)] + list(enumerate(ODD, 100))
    rows += [(i, rows[3][1]) for i in range(200, 220)] + [(3, rows[3][1]), (None, "a null id"), (300, "x" * 5000), (301, prose(rng, 5000, 900))]
    folder = table_dir(documents=documents(rows).repartition(5))
    found = queries.op13_token_alignment(spark, folder)
    columns = ["doc_id", *token_alignment.COUNTS, "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == brute(encoders, rows)[0]


def test_many_shards_and_leaves(spark, documents, encoders, monkeypatch):
    monkeypatch.setattr(token_alignment, "FAN", 2)
    rng = random.Random(6)
    rows = [(i, prose(rng, 40, 3000)) for i in range(60)]
    docs = documents(rows).repartition(6)
    counts = token_alignment.count_pairs(docs, A_PATH, B_PATH, shard_pairs=40, leaf_rows=30)
    assert counts.shards > 10
    expected = brute(encoders, rows)[1]
    assert {(r.a, r.b): r.n for r in counts.pairs(spark).collect()} == dict(expected)
    out = token_alignment.align(docs, counts, A_PATH, B_PATH)
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in out.collect()) == sorted((r[0], r[5], r[6]) for r in brute(encoders, rows)[0])


def test_empty_table(spark, documents):
    out = token_alignment.aligned(documents([]), A_PATH, B_PATH)
    assert out.collect() == [] and out.columns == ["doc_id", "groups", *token_alignment.COUNTS]
    none = token_alignment.aligned(documents([(1, None), (2, "")]), A_PATH, B_PATH)
    assert sorted((r.doc_id, r.groups, r.count_sum) for r in none.collect()) == [(1, "", 0), (2, "", 0)]


def test_units_spell_whole_texts(encoders):
    """Random odd texts: units one after the other are what the whole text is encoded to."""
    units = token_alignment.Aligner(A_PATH, B_PATH, True)
    rng = random.Random(7)
    letters = list("aB1é.,'-_ \t\n\r  ") + [" ", " ", "\u200d", "ß", "語", "😀", "\u0301", "s", "'s", "the", "ing", "\u0085", "\x1c", "!?", "ɐ", "ª"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    found, ends = units.places(pa.array(texts))
    for text, own in zip(texts, np.split(found, ends[:-1])):
        a, b = tokens(encoders, text)
        assert units.numbers[own].sum(axis=0)[:2].tolist() == [len(a), len(b)], text
        groups = [g.split("|") for g in ";".join(units.groups[i] for i in own).split(";") if g]
        assert [int(i) for g in groups for i in g[0].split(",")] == [i for i, *_ in a], text
        assert [int(i) for g in groups for i in g[1].split(",")] == [i for i, *_ in b], text


def test_workers_that_start_afresh(encoders):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40, 3000)) for i in range(60)]
    units = token_alignment.Aligner(A_PATH, B_PATH, True)
    texts = pa.array([t for _, t in rows] + [None, "x" * 1000])
    some_texts = list(sliced(texts, texts, 300))
    assert len(some_texts) > 20 and sum(map(len, some_texts)) == 62
    for some in some_texts:
        found, ends = units.places(some)
        assert len(ends) == len(some) and ends[-1] == len(found)
        units.held = token_alignment.HELD_BYTES + 1
        assert units.full()
        units.forget()
        assert not units.full() and not units.place and len(units.groups) == len(units.links) == len(units.facts) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    shard = token_alignment.Shard.load(token_alignment.Shard.build(keys).dump())
    assert sorted(shard.index(keys).tolist()) == list(range(len(keys)))
    assert shard.hashed.n == len(keys)
    strangers = np.setdiff1d(rng.integers(0, 1 << 48, 100), keys)
    with pytest.raises(ValueError):
        shard.index(strangers)
