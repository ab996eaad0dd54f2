from __future__ import annotations

import random
import tracemalloc
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import prose
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from catalens.llm import queries, token_counts, token_output

ODD = [None, "", " \n\t", "Hello  World's\nêtre 12", "<|endoftext|> a<|endoftext|>b", "ΑΣ ς\x1cx\x85y\xa0z", "e\u0301 e \u0301", "日本語 text", "x" * 3000, "word, Word. WORD!? it's. 's, don't! a.b, ,. é\u0301, 'll. İ, straße."]


@given(st.lists(st.integers(0, 5000), max_size=600))
def test_elias_fano_round_trip(steps):
    ends = np.cumsum(steps)
    coded = token_output.EliasFano.encode(ends)
    assert coded.all().tolist() == ends.tolist()
    assert [coded[i] for i in range(len(ends))] == ends.tolist()


def test_elias_fano_takes_about_two_bits_more_than_the_low_ones():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    coded = token_output.EliasFano.encode(ends)
    bits = 8 * (coded.low.nbytes + coded.high.nbytes + coded.directory.nbytes)
    assert bits / len(ends) < coded.width + 3.5 < 16


def encoded_documents(rows):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_match_whole_text_encoding(spark, documents, table_dir):
    rng = random.Random(4)
    rows = [*enumerate(ODD), *((i, prose(rng, rng.randrange(300), 5000)) for i in range(1000, 900, -1)), (None, "none")]
    rng.shuffle(rows)
    folder = table_dir(documents=documents(rows))
    got = [tuple(r) for r in queries.op9_token_files(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == encoded_documents(rows)


def test_shard_gives_single_documents(tmp_path):
    ids = [[5, 6, 1], [1], [7, 8, 9, 1]]
    ends = np.cumsum([len(i) for i in ids])
    data = b"".join(token_output.shard_parts([None, 10, 12], ends, 2)) + np.concatenate(ids).astype("<u2").tobytes()
    shard = token_output.Shard(data)
    assert [shard.doc_id(i) for i in range(len(shard))] == [None, 10, 12]
    assert [shard.document(i).tolist() for i in range(len(shard))] == ids


@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), max_size=60))
def test_shard_keeps_any_ids(ids):
    ids = sorted(ids, key=lambda i: (i is not None, i or 0))
    shard = token_output.Shard(b"".join(token_output.shard_parts(ids, np.arange(1, len(ids) + 1), 2)) + b"\1\0" * len(ids))
    assert [shard.doc_id(i) for i in range(len(shard))] == ids
    assert [shard.span(i) for i in range(len(shard))] == [(i, i + 1) for i in range(len(ids))]


def test_encoder_is_the_tokenizer():
    """Random odd texts, many in a batch, against whole-text encoding."""
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    coder, tok, rng = token_output.Encoder(path), Tokenizer.from_file(path), random.Random(11)
    letters = list("abEé.,'!? \n\t-_1") + [" ", " ", "ing", "the", "\u0301", "ß", "İ", "ǅ", "語", "'s", "\u00a0", "œ", "\u01c5", "ə"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(5000)] + [prose(rng, 400, 5000), "x" * 3000, "a " * 3000]
    for some in (texts[:2000], texts[2000:], []):
        ids, ends = coder.encode(pa.array(some, pa.string()))
        for text, own in zip(some, np.split(ids, ends[:-1])):
            assert own.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1], text
        coder.forget()


def test_encoder_holds_few_bytes_a_word(monkeypatch):
    """Ids are put together a part of the words at a time; the parts make the whole."""
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    coder, rng = token_output.Encoder(path), random.Random(12)
    texts = pa.array([prose(rng, 2000, 5000) for _ in range(400)])
    whole, ends = coder.encode(texts)
    tracemalloc.start()
    coder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * 2000 * 400
    monkeypatch.setattr(token_output, "PLACED", 777)
    again, stops = coder.encode(texts)
    assert (again == whole).all() and (stops == ends).all()


def test_repeated_ids_are_whole(spark, documents):
    rows = [(7, f"word{i % 5} again") for i in range(50)]
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    got = sorted(tuple(r) for r in token_output.encode_corpus(documents(rows), path).select("start", "n_tokens").collect())
    assert len(got) == 50 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_large_ranges_go_on_in_further_shards(spark, documents, tmp_path):
    rows = [(i, f"word {i} " * (i % 7)) for i in range(300)]
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    folder = f"file://{tmp_path}/shards"
    shards = token_output.write_shards(documents(rows), path, folder, shard_bytes=200)
    listed = shards.collect()
    assert sum(r.docs for r in listed) == 300 and any(r.part > 1 for r in listed)
    assert all(r.docs == 1 or 2 * r.tokens <= 200 for r in listed)
    got = sorted((tuple(r) for r in token_output.read_shards(shards, folder).collect()), key=lambda r: r[1])
    assert got == encoded_documents(rows)


def test_empty_table(spark, documents):
    docs = documents([(1, "a")]).limit(0)
    assert token_output.encode_corpus(docs, public_tokenizers.path(queries.WORD_VOCABULARY)).collect() == []
    assert token_counts.token_counts(docs, public_tokenizers.path(queries.PIECE_VOCABULARY)).collect() == []


SCORES = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -3.5, "ba": -4.0, "bab": -4.5, "é": -5.0, "aa": -4.0}


@given(st.sets(st.text("abéxœ", max_size=9)))
def test_trie_counts_match_plain_segmentation(words):
    model = token_counts.Unigram(SCORES)
    marked = {token_counts.MARK + w for w in words}
    assert model.counts(marked) == {w: brute.unigram_tokens(w, SCORES, model.byte_score) for w in marked}


def test_token_counts_of_texts(spark, documents, table_dir):
    rng = random.Random(8)
    rows = [*enumerate(ODD), *((i, prose(rng, rng.randrange(80), 900)) for i in range(50, 90))]
    scores = token_counts.piece_scores(public_tokenizers.path(queries.PIECE_VOCABULARY))
    byte_score = min(scores.values()) - 1.0
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op7_token_counts(spark, table_dir(documents=documents(rows))).collect()}
    for i, text in rows:
        words = brute.WHITE.findall(text or "")
        tokens = sum(brute.unigram_tokens(token_counts.MARK + w, scores, byte_score) for w in words)
        assert got[i] == (len(words), tokens), text


@pytest.mark.parametrize("text", ["a\x1cb c", "a\x85b", "a\xa0b c", " a\x0bb\x0cc "])
def test_words_end_at_ascii_white_space_only(text):
    assert token_counts._words(text) == brute.WHITE.findall(text)
