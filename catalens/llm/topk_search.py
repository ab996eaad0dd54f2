"""Exact BM25 top-k over an inverted index, with block-max pruning per shard.

Indexing: every task turns its documents into shards (at most ``SHARD_DOCS`` documents),
each an inverted index in a file of the shared folder, and reports document frequencies.
Searching uses global statistics (documents, mean length, frequency of each query term), so
scores do not depend on the sharding and merging the shards' best is exact.

A shard's documents lie in parts that share common terms (which separates languages), each
with its own index.  Queries are taken in blocks against groups of shards, next to others that
are like the same part and as long, and scored a chunk at a time.  Terms that are common in a
part and in the chunk are columns of a matrix of 32-bit impacts, the lists of all others are
added up in 64 bits; the split is where both cost the same.  Blocks of ``BLOCK_DOCS`` documents
have the highest impact of each column.  As in WAND, a block is looked into only if the bound
for it (the block's best score by lists plus the sum of its maxima) reaches the query's current
k-th best score; blocks go from the highest bound on, and the threshold rises on the way.
Scores of 32 bits only decide, within what they may be off, which documents are scored in 64
bits; those scores are compared, and are the same however they are split.  Documents are ordered by their commonest term and length
within a part, so that blocks are alike inside.  Ties go to the smaller id.

Files are written under a temporary name and renamed; a task that runs again leaves the
same files.  Terms are 64-bit hashes of lower-cased runs of letters and digits.

Defined cases: null and empty texts have no terms, count as documents, and are never
found.  Queries without known terms find nothing.  A document with no id can be found, and
comes last among ties.  Repeated rows are documents of their own; repeated queries with
the same id and text are asked once.  A query without an id is asked, and its rows have a null
query_id; several such queries are told apart by their texts alone.  Very long texts are
indexed and asked whole.  Empty tables give empty results.  Only the id and text are read.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.shared import releasing, text_key, work_folder, written

K = 10
K1, B = 1.2, 0.75
SHARD_DOCS = 1 << 14
SHARD_WORDS = 20_000_000
BLOCK_DOCS = 128
#: A part of a shard has at least so many documents, and a shard at most so many parts.
PART_DOCS, PARTS = 1024, 8
COMMON = 0.1
#: Lists over this share of a part's documents are also held as columns of a matrix; adding an
#: entry of a list costs as much as so many products of matrix elements.
DENSE, ENTRY_COST = 0.05, 800
#: Bits for the length of a list and for where it begins.
DF_BITS, FIRST_BITS = 15, 27
#: Queries and shards of a task at most, and where there are few of them.
QUERY_BLOCK, QUERY_TASK = 8192, 1024
SHARD_GROUP, SHARDS_TASK = 32, 8
#: Queries scored together, and entries of lists added up together.
QUERY_CHUNK = 256
ENTRIES = 1 << 15
#: Scores are compared to this many decimals.
DECIMALS = 9
#: Terms that are numbered together at first.
ENCODED = 1 << 18
TERM = re.compile(r"[^\W_]+")
NO_ID = np.iinfo(np.int64).max


#: ASCII characters, those that are of no term as blanks.
ASCII = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> Counter:
    lower = (text or "").lower()
    # The same terms either way.
    return Counter(lower.encode().translate(ASCII).decode().split() if lower.isascii() else TERM.findall(lower))


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


# --- one shard -----------------------------------------------------------------------


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def alike(term: np.ndarray, docs: np.ndarray, many: int, seeds: list[str]) -> np.ndarray:
    """A part for each of ``many`` documents, so that those of a part share common terms.

    ``term`` and ``docs`` are the postings.  Spherical k-means over the common terms a document
    has, from the largest groups of equal ``seeds``; too small a part is given up.
    """
    df = np.bincount(term)
    common = np.flatnonzero(df > COMMON * many)
    part = np.zeros(many, dtype=np.int64)
    if many < 2 * PART_DOCS or not len(common):
        return part
    row = np.full(len(df), -1)
    row[common] = np.arange(len(common))
    own = row[term] >= 0
    points = np.zeros((many, len(common)), dtype=np.float32)
    points[docs[own], row[term[own]]] = 1
    points /= np.maximum(np.sqrt(points.sum(axis=1, keepdims=True)), 1)
    first = sorted(Counter(seeds).items(), key=lambda r: (-r[1], r[0]))[:PARTS]
    number = {seed: i for i, (seed, _) in enumerate(first)}
    part = np.array([number.get(seed, -1) for seed in seeds])
    for _ in range(4 + len(first)):
        centres = np.stack([points[part == i].sum(axis=0) for i in range(part.max() + 1)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        part = (points @ centres.T).argmax(axis=1)
        sizes = np.bincount(part, minlength=len(centres))
        if sizes.min() < PART_DOCS:
            part[part == sizes.argmin()] = -1
            left = part >= 0
            part[left] = np.unique(part[left], return_inverse=True)[1]
            part = part if left.any() else part + 1
    # Those whose part was given up last go to the one whose centre is nearest.
    if (part < 0).any():
        centres = np.stack([points[part == i].sum(axis=0) for i in range(part.max() + 1)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        lost = part < 0
        part[lost] = (points[lost] @ centres.T).argmax(axis=1)
    return np.unique(part, return_inverse=True)[1]


def build_shard(ids: list[int | None], texts: list[str | None]) -> dict[str, np.ndarray]:
    """The documents in parts of alike ones, each an index of its own, one after the other:
    terms (sorted hashes), first (of each term's postings), docs (within the part), tfs,
    lengths, ids; part_terms and part_docs say where each part begins."""
    # Of each document only numbers are kept: its terms' within some documents, their counts,
    # and what orders it.
    words, terms, tfs, totals, commonest = [], [], [], [], []
    for text in texts:
        own = terms_of(text)
        words += own
        if len(words) >= ENCODED:
            terms.append(pa.array(words, pa.string()).dictionary_encode())
            words = []
        tfs.append(np.fromiter(own.values(), np.int32, len(own)))
        totals.append(own.total())
        most = max(own.values(), default=0)
        commonest.append(max((t for t, n in own.items() if n == most), default=""))
    sizes = np.fromiter(map(len, tfs), np.int64, len(tfs))
    terms.append(pa.array(words, pa.string()).dictionary_encode())
    terms = pa.chunked_array(terms).unify_dictionaries().chunks
    hashes = np.fromiter(map(term_hash, terms[0].dictionary.to_pylist()), np.uint64, len(terms[0].dictionary))
    by_hash = np.argsort(hashes)
    place = np.empty(len(hashes), dtype=np.int32)
    place[by_hash] = np.arange(len(hashes))
    hashes = hashes[by_hash]
    term = place[np.concatenate([t.indices.to_numpy() for t in terms])]
    del terms, place
    part = alike(term, np.repeat(np.arange(len(ids), dtype=np.int32), sizes), len(ids), commonest)
    order = sorted(range(len(ids)), key=lambda i: (part[i], commonest[i], totals[i]))
    part_docs = np.concatenate(([0], np.cumsum(np.bincount(part)))).astype(np.int64)
    begins, part, sizes = (np.cumsum(sizes) - sizes)[order], part[order], sizes[order]
    # The postings by document as they are ordered, then by part and term.
    entries = _ranges(begins, sizes)
    keys, counts = term[entries].astype(np.int64), np.concatenate([*tfs, np.empty(0, np.int32)])[entries]
    del entries, term, tfs
    keys += np.repeat(part * len(hashes), sizes)
    sort = np.argsort(keys, kind="stable")
    keys, counts = keys[sort], _small(counts[sort])
    docs = _small(np.repeat((np.arange(len(order)) - part_docs[part]).astype(np.int32), sizes)[sort])
    del sort
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    in_part, of = np.divmod(keys[first], max(len(hashes), 1))
    return {
        "terms": hashes[of],
        "first": np.append(first, len(keys)),
        "docs": docs,
        "tfs": counts,
        "lengths": np.array([totals[i] for i in order], dtype=np.int64),
        "ids": np.array([NO_ID if ids[i] is None else ids[i] for i in order], dtype=np.int64),
        "part_terms": np.searchsorted(in_part, np.arange(len(part_docs))),
        "part_docs": part_docs,
    }


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(begins - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def find(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of the sorted ``wanted`` is in the sorted ``terms``, or -1."""
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        #: By query, best first; places that are not taken have no score.
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), NO_ID)
        #: The score to reach; above zero, as documents without a query term are not found.
        self.threshold = np.full(queries, 10.0**-DECIMALS)

    query = property(lambda self: np.nonzero(self.scores > -np.inf)[0])
    score = property(lambda self: self.scores[self.scores > -np.inf])
    id = property(lambda self: self.ids[self.scores > -np.inf])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, query = np.unique(query, return_inverse=True)
        query = np.concatenate((np.repeat(np.arange(len(touched)), self.k), query))
        score, ids = np.concatenate((self.scores[touched].ravel(), score)), np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        begins = np.searchsorted(query, np.arange(len(touched)))
        kept = order[np.arange(len(query)) - begins[query] < self.k]
        self.scores[touched], self.ids[touched] = score[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)
        self.threshold[touched] = np.maximum(self.threshold[touched], self.scores[touched, -1])


class Asked:
    """Queries of (terms, weights): their distinct terms, and of each entry the term's number."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]]):
        self.first = np.concatenate(([0], np.cumsum([len(t) for t, _ in queries]))).astype(np.int64)
        self.weights = np.concatenate([*(w for _, w in queries), np.empty(0)])
        self.terms, number = np.unique(np.concatenate([*(t for t, _ in queries), np.empty(0, np.uint64)]), return_inverse=True)
        self.number = number.astype(np.int32)
        # A power of two over the highest score that each could have.
        most = np.bincount(np.repeat(np.arange(len(queries)), np.diff(self.first)), self.weights, len(queries)) * (K1 + 1)
        self.scale = np.ldexp(1.0, np.frexp(most)[1])
        #: The place of each query among those given.
        self.place, self.arranged = np.arange(len(queries)), False

    def __len__(self) -> int:
        return len(self.place)

    def arrange(self, shard: Shard) -> None:
        """Queries next to others that are like the same part of ``shard`` and as long."""
        sizes = np.diff(self.first)
        query = np.repeat(np.arange(len(self)), sizes)
        like = np.zeros((max(1, len(shard.spans)), len(self)))
        for i, (terms, docs) in enumerate(shard.spans):
            if terms.stop > terms.start:
                at = find(shard.arrays["terms"][terms], self.terms)
                share = np.diff(shard.arrays["first"][terms.start : terms.stop + 1]) / (docs.stop - docs.start)
                like[i] = np.bincount(query, np.where(at >= 0, share[at], 0)[self.number], len(self))
        order = np.lexsort((sizes, like.argmax(axis=0)))
        entries = _ranges(self.first[:-1][order], sizes[order])
        self.first = np.concatenate(([0], np.cumsum(sizes[order])))
        self.weights, self.number = self.weights[entries], self.number[entries]
        self.scale, self.place = self.scale[order], self.place[order]
        self.arranged = True


def even(products: np.ndarray) -> np.ndarray:
    """Numbers under 1 in place to 51 binary digits: their sums are exact if they are under 1,
    so the same in any order, however a score is split."""
    products += 3
    products -= 3
    return products


class Nearly:
    """Documents that could be among the best of some queries, by scores that are not exact."""

    def __init__(self, best: Best, numbers: np.ndarray, off: float):
        self.k, self.off = best.k, off
        self.least = best.threshold[numbers] * (1 - off) - 10.0**-DECIMALS
        #: The highest scores of each query, in no order; some may be those of ``best`` already.
        self.scores = np.zeros((len(numbers), best.k))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, queries: np.ndarray, scores: np.ndarray, begin: int) -> None:
        reached = (scores >= self.least[queries][:, None]) & (scores > 0)
        some = np.flatnonzero(reached.any(axis=1))
        if not len(some):
            return
        queries, scores, reached = queries[some], scores[some], reached[some]
        both = np.concatenate((self.scores[queries], scores), axis=1)
        self.scores[queries] = np.partition(both, -self.k, axis=1)[:, -self.k :]
        # k documents surely score more than those that are further off.
        sure = self.scores[queries].min(axis=1) * (1 - 2 * self.off) - 10.0**-DECIMALS
        self.least[queries] = np.maximum(self.least[queries], sure)
        q, d = np.nonzero(reached & (scores >= self.least[queries][:, None]))
        self.found.append((queries[q], begin + d, scores[q, d]))

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and documents that still could be."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        query, doc, score = map(np.concatenate, zip(*self.found))
        kept = score >= self.least[query]
        return query[kept], doc[kept]


class Part:
    """Documents of a shard that share common terms, and the lists of all terms in them."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, mean_length: float):
        self.terms, self.ids = terms, ids
        self.blocks = -(-len(ids) // BLOCK_DOCS)
        self.width = self.blocks * BLOCK_DOCS
        self.norm = np.ones(self.width)
        self.norm[: len(ids)] = K1 * (1 - B + B * lengths / mean_length)
        df = np.diff(first)
        #: Lists: documents and impacts.
        self.docs, counts = docs, tfs.astype(float)
        self.impacts = counts * (K1 + 1) / (counts + self.norm[self.docs])
        #: Of common terms counts and impacts by document, and the highest impact in each block;
        #: columns by falling document frequency.
        common = np.flatnonzero(df > DENSE * len(ids))
        common = common[np.argsort(-df[common], kind="stable")]
        self.common_df = df[common]
        entries = _ranges(first[common], self.common_df)
        cells = self.docs[entries], np.repeat(np.arange(len(common)), self.common_df)
        self.counts = np.zeros((self.width, len(common)), dtype=tfs.dtype)
        self.counts[cells] = tfs[entries]
        self.products = np.zeros((self.width, len(common)), dtype=np.float32)
        self.products[cells] = self.impacts[entries]
        self.maxima = self.products.reshape(self.blocks, BLOCK_DOCS, len(common)).max(axis=1)
        #: Of each term the column (from 1 on, or 0), where its list begins, and how long it is.
        self.places = first[:-1] << DF_BITS | df
        self.places[common] |= np.arange(1, len(common) + 1) << DF_BITS + FIRST_BITS
        # Sums of 32-bit products of so many terms are off by less.
        self.off = (len(common) + 16) * 2.0**-23

    def search(self, asked: Asked, best: Best) -> None:
        at = find(self.terms, asked.terms)
        at = np.where(at >= 0, self.places[at], 0)
        for begin in range(0, len(asked), QUERY_CHUNK):
            self._search(asked, at, begin, min(begin + QUERY_CHUNK, len(asked)), best)

    def _search(self, asked: Asked, at: np.ndarray, begin: int, end: int, best: Best) -> None:
        entries = slice(asked.first[begin], asked.first[end])
        place = at[asked.number[entries]]
        known = np.flatnonzero(place)
        place, weight = place[known], asked.weights[entries][known]
        query = np.repeat(np.arange(end - begin), np.diff(asked.first[begin : end + 1]))[known]
        numbers = asked.place[begin:end]
        # Common terms that many of the queries have cost less as a matrix, others as lists.
        column = (place >> DF_BITS + FIRST_BITS) - 1
        listed = np.bincount(column + 1, minlength=len(self.common_df) + 1)[1:] * self.common_df * ENTRY_COST
        columns = int(np.argmin(np.concatenate(([0], np.cumsum((end - begin) * self.width - listed)))))
        common = np.flatnonzero((column >= 0) & (column < columns))
        weights = np.zeros((end - begin, columns))
        weights[query[common], column[common]] = weight[common]
        left = np.flatnonzero((column < 0) | (column >= columns))
        place = place[left]
        begins, sizes = place >> DF_BITS & (1 << FIRST_BITS) - 1, place & (1 << DF_BITS) - 1
        scale = asked.scale[begin:end]
        rare, bounds = self.rare_scores(begins, sizes, weight[left], query[left], scale)
        single = weights.astype(np.float32)
        bounds += single @ self.maxima[:, :columns].T
        bounds *= 1 + self.off
        bounds += 10.0**-DECIMALS
        # First each query's most promising block, which sets a threshold; then the others.
        top = bounds.argmax(axis=1)
        nearly = Nearly(best, numbers, self.off)
        for block in np.unique(top):
            self._look(block, np.flatnonzero(top == block), rare, single, bounds, nearly)
        bounds[np.arange(end - begin), top] = -1.0
        for block in np.argsort(-bounds.max(axis=0)):
            self._look(block, np.arange(end - begin), rare, single, bounds, nearly)
        query, doc = nearly.left()
        for some in range(0, len(query), 256):
            self._add(query[some : some + 256], doc[some : some + 256], numbers, rare, weights, scale, best)

    def rare_scores(self, begins: np.ndarray, sizes: np.ndarray, weight: np.ndarray, query: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by lists (query x document), and the highest in each block; lists come by query."""
        queries, weight = len(scale), weight / scale[query]
        scores, highest = np.empty((queries, self.width)), np.empty((queries, self.blocks))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(query, np.arange(queries + 1))]
        begin = 0
        while begin < queries:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ENTRIES, side="right")) - 1)
            if ends[end] == ends[begin]:
                scores[begin:end] = highest[begin:end] = 0
            else:
                own = slice(*np.searchsorted(query, (begin, end)))
                of = sizes[own]
                entries = _ranges(begins[own], of)
                cell = np.repeat((query[own] - begin) * self.width, of)
                cell += self.docs.take(entries)
                score = np.repeat(weight[own], of)
                score *= self.impacts.take(entries)
                sums = np.bincount(cell, even(score), (end - begin) * self.width)
                np.multiply(sums.reshape(-1, self.width), scale[begin:end, None], out=scores[begin:end])
                highest[begin:end] = sums.reshape(-1, self.blocks, BLOCK_DOCS).max(axis=2) * scale[begin:end, None]
            begin = end
        return scores, highest

    def _look(self, block: int, queries: np.ndarray, rare: np.ndarray, single: np.ndarray, bounds: np.ndarray, nearly: Nearly) -> None:
        queries = queries[bounds[queries, block] >= nearly.least[queries]]
        if len(queries):
            own = slice(block * BLOCK_DOCS, (block + 1) * BLOCK_DOCS)
            nearly.add(queries, rare[queries, own] + single[queries] @ self.products[own, : single.shape[1]].T, own.start)

    def _add(self, query: np.ndarray, doc: np.ndarray, numbers: np.ndarray, rare: np.ndarray, weights: np.ndarray, scale: np.ndarray, best: Best) -> None:
        """Exact scores of single documents."""
        counts = self.counts[doc, : weights.shape[1]].astype(float)
        impacts = counts * (K1 + 1) / (counts + self.norm[doc][:, None])
        impacts *= weights[query] / scale[query][:, None]
        score = np.round(rare[query, doc] + even(impacts).sum(axis=1) * scale[query], DECIMALS)
        reached = score >= best.threshold[numbers[query]]
        if reached.any():
            best.add(numbers[query[reached]], score[reached], self.ids[doc[reached]])


class Shard:
    def __init__(self, arrays: dict[str, np.ndarray], mean_length: float):
        self.arrays, self.mean_length = arrays, mean_length
        terms, docs = (arrays[k].tolist() for k in ("part_terms", "part_docs"))
        #: Where the terms and the documents of each part are.
        self.spans = [(slice(*t), slice(*d)) for t, d in zip(zip(terms, terms[1:]), zip(docs, docs[1:]))]
        self.blocks = sum(-(-(d.stop - d.start) // BLOCK_DOCS) for _, d in self.spans)

    def part(self, terms: slice, docs: slice) -> Part:
        first = self.arrays["first"][terms.start : terms.stop + 1]
        entries = slice(first[0], first[-1])
        lists, lengths = (self.arrays[k][entries] for k in ("docs", "tfs")), self.arrays["lengths"][docs]
        return Part(self.arrays["terms"][terms], first - first[0], *lists, lengths, self.arrays["ids"][docs], self.mean_length)

    def search(self, queries: Asked | list[tuple[np.ndarray, np.ndarray]], best: Best) -> None:
        asked = queries if isinstance(queries, Asked) else Asked(queries)
        if not asked.arranged:
            asked.arrange(self)
        for terms, docs in self.spans:
            # One part at a time is held as a matrix.
            if terms.stop > terms.start:
                self.part(terms, docs).search(asked, best)


# --- files ---------------------------------------------------------------------------


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    data = io.BytesIO()
    np.savez(data, **arrays)
    own = f"{root}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
    with store.open_output_stream(own) as out:
        out.write(data.getbuffer())
    store.move(own, f"{root}/{name}.npz")


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}.npz") as source:
        with np.load(io.BytesIO(source.read())) as arrays:
            return {k: arrays[k] for k in arrays.files}


# --- over a table --------------------------------------------------------------------

SHARD_ROWS = "shard string, docs long, words long, term long, df long"


def write_index(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Write the shards; their names and sizes (term null) and each term's documents in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list = []
        held = made = 0

        def finished() -> Iterator[pa.RecordBatch]:
            arrays = build_shard(ids, texts)
            name = f"shard-{TaskContext.get().partitionId():06d}-{made:04d}"
            _save(folder, name, arrays)
            terms, of = np.unique(arrays["terms"], return_inverse=True)
            df = np.bincount(of, np.diff(arrays["first"])).astype(np.int64)
            for shard, docs, words, term, count in (
                ([name], [len(ids)], [int(arrays["lengths"].sum())], [None], [None]),
                ([None] * len(df), [None] * len(df), [None] * len(df), terms.view(np.int64), df),
            ):
                columns = [pa.array(shard, pa.string()), *(pa.array(c, pa.int64()) for c in (docs, words, term, count))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "docs", "words", "term", "df"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(ids) >= SHARD_DOCS or held >= SHARD_WORDS * 6:
                    yield from finished()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(text)
                held += len(text or "")
        if ids:
            yield from finished()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(releasing(run), SHARD_ROWS), "index")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, key, term, count) of the distinct queries."""
    rows = queries.select(F.col(id_col).cast("long").alias("query_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [terms_of(t) for t in batch.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]), pa.int64())
            terms = np.fromiter((term_hash(t) for c in counts for t in c), np.uint64).view(np.int64)
            numbers = np.fromiter((n for c in counts for n in c.values()), np.int64)
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(terms), pa.array(numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "key", "term", "count"])

    return rows.dropDuplicates(["query_id", "key"]).mapInArrow(releasing(run), "query_id long, key string, term long, count long")


QUERY_FILES = "block int, queries int"


def write_queries(weighted: DataFrame, blocks: int, folder: str) -> DataFrame:
    """Write the queries (query_id, key, terms, weights) in ``blocks`` files."""
    dealt = weighted.withColumn("block", F.pmod(F.xxhash64("query_id", "key"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "query_id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None

        def finished() -> pa.RecordBatch:
            terms, weights = zip(*held)
            first = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
            unnamed = np.array([i is None for i in ids])
            named = np.array([i or 0 for i in ids], dtype=np.int64)
            _save(folder, f"queries-{current:06d}", {"ids": named, "unnamed": unnamed, "first": first, "terms": np.concatenate(terms).view(np.uint64), "weights": np.concatenate(weights)})
            return pa.RecordBatch.from_pydict({"block": pa.array([current], pa.int32()), "queries": pa.array([len(ids)], pa.int32())})

        for batch in batches:
            own, blocks = batch.column("query_id").to_pylist(), batch.column("block").to_pylist()
            pairs = zip(*(([r.values.to_numpy() for r in batch.column(k)]) for k in ("terms", "weights")))
            for query, block, pair in zip(own, blocks, pairs):
                if held and current != block:
                    yield finished()
                    ids, held = [], []
                current = block
                ids.append(query)
                held.append(pair)
        if held:
            yield finished()

    return written(dealt.mapInArrow(releasing(run), QUERY_FILES), "query-files")


FOUND = "query_no long, query_id long, doc_id long, score double"


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents for every query row."""
    spark = docs.sparkSession
    folder = work_folder(spark, "search")
    index = write_index(docs, folder, id_col, text_col)
    shards = index.where("shard is not null")
    # One row in all, then one short name per shard.
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    names = [r.shard for r in shards.select("shard").orderBy("shard").collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    if not total.words:
        return empty
    mean_length = total.words / total.docs

    asked = written(query_terms(queries, id_col, text_col), "query-terms")
    df = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf: Column = F.log(1 + (F.lit(float(total.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pair = F.struct("term", (F.col("count") * idf).alias("weight"))
    weighted = asked.join(df, "term").groupBy("query_id", "key").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    weighted = weighted.select("query_id", "key", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"))
    many = asked.select("query_id", "key").distinct().count()
    blocks = -(-many // QUERY_BLOCK)
    if not blocks:
        return empty
    # Two tasks for each core, if that leaves them enough shards and queries.
    wanted = 2 * spark.sparkContext.defaultParallelism
    groups = max(-(-len(names) // SHARD_GROUP), min(-(-len(names) // SHARDS_TASK), -(-wanted // blocks)))
    blocks = max(blocks, min(-(-many // QUERY_TASK), -(-wanted // groups)))
    filled = [r.block for r in write_queries(weighted, blocks, folder).select("block").orderBy("block").collect()]
    tasks = spark.range(0, len(filled) * groups, 1, max(1, len(filled) * groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            block, group = filled[number // groups], number % groups
            asked = _load(folder, f"queries-{block:06d}")
            first, ids, unnamed = asked["first"], asked["ids"], asked["unnamed"]
            own = Asked([(asked["terms"][a:b], asked["weights"][a:b]) for a, b in zip(first, first[1:])])
            del asked
            best = Best(len(own), k)
            for at in range(group, len(names), groups):
                Shard(_load(folder, names[at]), mean_length).search(own, best)
            found = pa.array(best.id, mask=best.id == NO_ID)
            numbers = best.query + (block << 32)
            query_ids = pa.array(ids[best.query], mask=unnamed[best.query])
            columns = [pa.array(numbers), query_ids, found, pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_no", "query_id", "doc_id", "score"])

    order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = tasks.mapInArrow(releasing(run), FOUND).withColumn("rank", F.row_number().over(order))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
