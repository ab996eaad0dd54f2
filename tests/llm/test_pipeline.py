"""The pipeline against the plain versions of its stages."""

from __future__ import annotations

import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import prose
from test_decontamination import ITEMS
from test_decontamination import brute as leaks
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from catalens.llm import mixing, queries

STAGES = dict(corpus_pipeline.STAGES)


def corpus(rng):
    items = [(i, prose(rng, 30)) for i in range(10)]
    rows = [(i, prose(rng, rng.randrange(5, 90)), rng.choice(["en", "fr"]), f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[3][1], "en", "s0") for i in range(20)]
    rows += [(300 + i, f"{prose(rng, 20)} {items[i][1]} {prose(rng, 20)}", "en", "s1") for i in range(8)]
    rows += [(400, None, None, None), (401, "", "en", None), (402, "123 456", "en", "s2"), (403, prose(rng, 9), None, None)]
    rows += [(404, "w1$$$ w2%%% w3&&& w4***", "en", "s1"), (405, prose(rng, 20_000), "fr", "s2"), (None, prose(rng, 40), "en", "s0")]
    rows += [rows[5], rows[5]]
    return rows, items


def order(i):
    return i is None, i or 0


def kept_by_brute_force(rows, items):
    rows = list({r[:2]: r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and "$" not in r[1]}.values())
    prints = [brute.simhash(r[1]) for r in rows]
    label = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    rows = [r for i, r in enumerate(rows) if r[0] == min((o[0] for j, o in enumerate(rows) if label[j] == label[i]), key=order)]
    bad = {d for d, _ in leaks([r[:2] for r in rows], items)}
    return [r for r in rows if r[0] not in bad]


def test_every_stage_and_the_whole(spark, documents, table_dir):
    rows, items = corpus(random.Random(1))
    docs = documents(rows)
    folder = table_dir(documents=docs, benchmark=spark.createDataFrame(items, ITEMS))
    for name in ("language_id", "simhash_dedup", "decontamination"):
        docs = STAGES[name](spark, docs, folder)
        assert docs.columns == documents([]).columns
    assert sorted((r.doc_id for r in docs.collect()), key=order) == sorted((r[0] for r in kept_by_brute_force(rows, items)), key=order)

    mixed = STAGES["source_mix"](spark, docs, folder)
    copies = {r.doc_id: r.copies for r in mixing.plan(docs).collect()}
    ids = sorted((i for i, n in copies.items() for _ in range(n)), key=lambda i: (i is not None, i or 0))
    assert sorted((r.doc_id for r in mixed.collect()), key=order) == sorted(ids, key=order)

    tok = Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    expected, start, texts = [], 0, {r[0]: r[1] for r in rows}
    for i in ids:
        coded = [*tok.encode(texts[i], add_special_tokens=False).ids, 1]
        expected.append((i, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        start += len(coded)
    whole = entry_point.queries()["pipeline"](spark, folder)
    assert sorted((tuple(r) for r in whole.collect()), key=lambda r: r[1]) == expected


def test_empty_documents(spark, documents, table_dir):
    folder = table_dir(documents=documents([]), benchmark=spark.createDataFrame([], ITEMS))
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_entry_without_the_corpus_operators(tmp_path):
    """Deleting the folder leaves the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(entry_point.__file__)
    for name in ("__spark_entry__.py", "oracle_queries.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/catalens", tmp_path / "catalens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) == set(e.BUILDERS)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
