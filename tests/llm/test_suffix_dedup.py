from __future__ import annotations

import hashlib
import random
import re

import brute
import numpy as np
import pytest
from brute import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from catalens.llm import queries, suffix_dedup as sd


@given(st.lists(st.binary(max_size=60), max_size=40), st.integers(0, 3), st.binary(min_size=30, max_size=30))
def test_deep_shallow_sorts_within_groups(texts, kinds, stem):
    texts = [stem + t[: len(t) // 2] if i % 2 else t for i, t in enumerate(texts)]
    texts += texts[:3] + [stem * 2, stem, stem + b"\0", stem + b"\0\0"]
    groups = np.sort(np.arange(len(texts)) % (kinds + 1))
    order, shared = sd.deep_shallow(texts, groups)
    assert sorted(order.tolist()) == list(range(len(texts)))
    got = [(groups[i], texts[i]) for i in order]
    assert got == sorted(got)
    for (g, a), (h, b), n in zip(got, got[1:], shared[1:]):
        assert n == (-1 if g != h else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@given(st.lists(st.binary(max_size=12), max_size=60))
def test_blind_trie_orders_strings(texts):
    trie = sd.BlindTrie()
    for i, t in enumerate(texts):
        trie.insert(t, i)
    assert [texts[i] for i in trie.rows()] == sorted(texts)


@settings(max_examples=60)
@given(st.integers(1, 40), st.binary(min_size=1, max_size=200))
def test_rolling_hash_and_minimum(width, data):
    array = np.frombuffer(data, dtype=np.uint8)
    if len(data) >= width:
        hashes = sd.rolling_hashes(array, width)
        same = {}
        for i in range(len(data) - width + 1):
            assert same.setdefault(data[i : i + width], hashes[i]) == hashes[i]
        assert sd.sliding_minimum(array, width).tolist() == [min(data[i : i + width]) for i in range(len(data) - width + 1)]


def corpus(rng):
    passage, near = prose(rng, 150), prose(rng, 300)
    rows = [(i, prose(rng, rng.randrange(0, 200))) for i in range(20)]
    rows += [(20 + i, f"{prose(rng, 20)} {passage} {prose(rng, 30)}") for i in range(5)]
    for i in range(30, 50):
        words = near.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(["é", "x", "yy zz"])
        rows.append((i, " ".join(words)))
    rows += [(60, None), (61, ""), (62, "a" * 399), (63, "b" * 400), (64, "c" * 401), (65, "ab" * 2000), (66, "é" * 500)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, passage[:399]), (73, passage[:400]), (74, near + near), (75, "\n".join(["same line here"] * 60))]
    rows += rows[5:8] + [(None, rows[1][1])]
    return rows


def expected(rows):
    data, marks = brute.duplicated_bytes([t for _, t in rows])
    out = []
    for (i, _), b, m in zip(rows, data, marks):
        spans = sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1]))
        kept = bytes(x for x, gone in zip(b, m) if not gone)
        out.append((i, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "split", "block"), [(1, 2000, 20_000), (2, 3, 10), (3, 0, 1)])
def test_matches_brute_force(spark, documents, table_dir, monkeypatch, seed, split, block):
    monkeypatch.setattr(sd, "SPLIT_ABOVE", split)
    monkeypatch.setattr(sd, "BLOCK_ROWS", block)
    rows = corpus(random.Random(seed))
    folder = table_dir(documents=documents(rows))
    found = queries.op2_suffix_dedup(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        # The text that is left; a character that was cut apart shows as such.
        left = hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert left or "\ufffd" in r.kept
        assert r.n_removed or r.kept == texts[r.doc_id]


def test_scans_of_long_texts_meet(monkeypatch):
    """Pieces of a long text have the windows of the whole."""
    rng = random.Random(5)
    text = prose(rng, 2000).encode()
    whole = list(sd.anchor_rows([text], 400, 200))
    monkeypatch.setattr(sd, "SCAN", 700)
    parts = list(sd.anchor_rows([text, b"x" * 10, text[:450]], 400, 200))

    def anchors_of(scans, wanted):
        out = {}
        for of, start, windows, offset, gram, _ in scans:
            for d, s, w, o, g in zip(of, start, windows, offset, gram):
                if d == wanted:
                    out |= {s + k: (s + o, g) for k in range(w)}
        return out

    assert anchors_of(whole, 0) == anchors_of(parts, 0)
    assert len(anchors_of(whole, 0)) == len(text) - 399
    assert len(anchors_of(parts, 2)) == 51


def test_shared_passage_does_not_meet_in_one_task(spark, documents, monkeypatch):
    """A passage of many documents with different surroundings: no sort gets a row of each."""
    monkeypatch.setattr(sd, "SPLIT_ABOVE", 20)
    rng = random.Random(8)
    passage = prose(rng, 150)
    rows = [(i, f"{prose(rng, 100)} {passage} {prose(rng, 100)}") for i in range(120)]
    largest = []

    def compared(contexts, length, own=sd.compared):
        key = contexts.columns[0]
        largest.append(max((r["count"] for r in contexts.groupBy(key).count().collect()), default=0))
        return own(contexts, length)

    monkeypatch.setattr(sd, "compared", compared)
    got = {r.doc_id: (len(r.spans), sum(s.end - s.start for s in r.spans)) for r in sd.deduplicated(documents(rows)).collect()}
    assert got == {i: (spans, n) for i, _, n, spans, _ in expected(rows)}
    assert max(largest) <= 20


def test_without_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_KEYS", -1)
    rows = corpus(random.Random(6))
    got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in sd.deduplicated(documents(rows)).collect()}
    assert got == {i: n for i, _, n, _, _ in expected(rows)}


def test_empty_table(spark, documents):
    assert sd.deduplicated(documents([(1, "a")]).limit(0)).collect() == []


def passages_of(rows, words=51):
    """Per row: byte spans of the runs of words in strings of so many that another row has too."""
    found = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    where = {}
    for d, ws in enumerate(found):
        for i in range(len(ws) - words + 1):
            where.setdefault(tuple(w for _, _, w in ws[i : i + words]), set()).add(d)
    out = []
    for ws in found:
        marks = [False] * (len(ws) + 1)
        for i in range(len(ws) - words + 1):
            if len(where[tuple(w for _, _, w in ws[i : i + words])]) > 1:
                marks[i : i + words] = [True] * words
        begins = [i for i in range(len(ws)) if marks[i] and not (i and marks[i - 1])]
        out.append([(ws[i][0], ws[marks.index(False, i) - 1][1]) for i in begins])
    return out


def passage_corpus(rng):
    """Passages of 51 words and more, all under 400 bytes, and what must not count as such."""
    rows = corpus(rng)
    short, long, few, own = (prose(rng, n, 90) for n in (51, 60, 50, 55))
    around = lambda text: f"{prose(rng, rng.randrange(70), 10**6)} {text} {prose(rng, rng.randrange(70), 10**6)}"
    rows += [(100 + i, around(short)) for i in range(2)] + [(110 + i, around(few)) for i in range(8)]
    rows += [(120 + i, around(long)) for i in range(30)] + [(150, long.replace(" ", "\t\n ")), (151, f"{long} {short}"), (152, long)]
    # Only within one document; with a word changed; without white space before the next word.
    rows += [(160, f"{own} {prose(rng, 9)} {own}"), (161, around(short.upper())), (162, around(f"{short}.")), (163, " " + "line " * 300)]
    rows += [(170, "né à " * 60), (171, "né à " * 30 + "x"), (172, short), (None, short), (None, None), (173, "ab c " + prose(rng, 60, 10**6))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force(spark, documents, table_dir, monkeypatch, seed):
    rows = passage_corpus(random.Random(seed))
    spans = passages_of(rows)
    planted = {i: s for (i, _), s in zip(rows, spans)}
    assert all(planted[i] for i in (100, 101, 120, 150, 170)) and not any(planted[i] for i in (110, 160, 161, 163, 173))
    folder = table_dir(documents=documents(rows))
    found = queries.op2_suffix_dedup(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected(rows)
    want = [(i, len(s), sum(b - a for a, b in s)) for (i, _), s in zip(rows, spans)]
    assert sorted([(r.doc_id, r.n_passages, r.passage_bytes) for r in found], key=repr) == sorted(want, key=repr)
    got = [(r.doc_id, [(s.start, s.end) for s in r.passages]) for r in sd.deduplicated(documents(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(i, s) for (i, _), s in zip(rows, spans)], key=repr)


def test_words_of_long_texts(monkeypatch):
    """Words, windows and anchors are the same however a text is scanned."""
    rng = random.Random(7)
    text = f"{prose(rng, 900)} {'é' * 400} {prose(rng, 900)}".encode()
    texts = [text, b"", b"one two", text[100:900], b" " * 5 + text[:1500]]

    def windows_of(scans):
        out = {}
        for of, start, windows, offset, gram, _ in scans:
            for d, s, w, o, g in zip(*(a.tolist() for a in (of, start, windows, offset, gram))):
                out |= {(d, s + k): (s + o, g) for k in range(w)}
        return out

    whole = windows_of(sd.word_rows(texts, 51, 20))
    begins = sd.word_codes(text)[0].tolist()
    assert begins == [m.start() for m in re.finditer(rb"\S+", text)]
    assert sorted(s for d, s in whole if d == 0) == list(range(len(begins) - 50))
    monkeypatch.setattr(sd, "SCAN", 900)
    assert windows_of(sd.word_rows(texts, 51, 20)) == whole
    # A word longer than a scan.
    monkeypatch.setattr(sd, "SCAN", 300)
    codes = sd.word_codes(text + b" " + text)[1].tolist()
    assert len(codes) == 2 * len(begins) and codes[: len(begins)] == codes[len(begins) :]


@settings(max_examples=60)
@given(st.lists(st.text(alphabet="ab\0\x01é", min_size=1, max_size=4), min_size=2, max_size=60))
def test_word_codes_tell_words_apart(words):
    data = " ".join(words).encode()
    begins, codes = sd.word_codes(data)
    assert len(codes) == len(words)
    assert len(set(codes.tolist())) == len(set(words))
    # Nor do sums over several words stand for other words.
    pairs = sd.rolling_hashes(codes, 2).tolist()
    assert len(set(pairs)) == len(set(zip(words, words[1:])))
