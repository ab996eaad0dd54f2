"""Exact removal of repeated byte strings by sorting suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.  Only
suffixes at anchors are sorted: the anchor of a window of ``length`` bytes is its leftmost
``GRAM``-byte string of least hash, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor make a row: the anchor's gram, the windows' offsets.

1. Anchors are found in one pass over the texts (a few rows per thousand bytes).
2. Rows whose gram occurs once are done.  Rows whose whole context (all bytes of their
   windows) occurs twice are repeated throughout, however many copies there are; they are
   counted by hash and their bytes never move.
3. Of grams with several different contexts, each distinct context is fetched once and
   brought together by gram.  There the suffixes at the anchors, and the reversed bytes
   before them, are ordered by deep-shallow sorting: multikey quicksort on eight bytes at
   a time to ``SHALLOW`` bytes, then a blind trie for each group still tied.  With the
   longest common prefixes of neighbours, a window at offset o is repeated if another row
   lies in the same stretch of both orders: at least length - o bytes shared after the
   anchor, and o before it.  That takes time in proportion to rows times offsets, never pairs.
4. A gram with more than ``SPLIT_ABOVE`` contexts is split: its windows are dealt out by
   offset, ``PIECE`` at a time, and their bytes stay where they are.  Pieces are counted by
   hash; those that occur twice are repeated throughout.  Of pieces that differ but have
   the bytes common to all their windows in common, as at the end of a passage with different
   surroundings, the single windows are counted by hash.  So a passage that very many
   documents share meets in counts only, and in joins that AQE can split.

Passages of over 50 words that another document has too are often shorter than ``length``.
They stay, and are reported beside the removed spans, whole.  They are found the same way with
words in place of bytes: each word is a 64-bit number, windows are ``WORDS`` words, anchors are
strings of ``GRAM_WORDS`` words.  Contexts that two documents have are shared throughout; of
the others with an anchor in common, the single windows are counted by hash.  So copies and
passages of very many documents meet in counts only.  Repeats within one document do not
count, nor does the kind of white space between words.

Keys of texts are broadcast only while they number at most ``BROADCAST_KEYS`` (16 bytes
each); beyond that the same joins are shuffled.

Defined cases: null texts are empty; shorter texts than ``length`` are kept whole; matches
never cross documents; repeated rows are copies of each other.  Very long texts are scanned
in pieces.  Empty tables give empty results.  Columns but the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.shared import releasing, ship_package, written

LENGTH = 400
GRAM = 200
SHALLOW = 24
SPLIT_ABOVE = 2000
PIECE = 16
BROADCAST_KEYS = 2_000_000
#: Passages of over 50 words.
WORDS = 51
GRAM_WORDS = 20
#: Window starts scanned at a time; places within a scan fit in PLACE_BITS.
SCAN = 1 << 19
PLACE_BITS = 20
#: Contexts sorted at a time, unless one gram has more.
BLOCK_ROWS = 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MASK64 = (1 << 64) - 1
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
SECOND_SEED = 7
KEY = ["__llm_k1", "__llm_k2"]


# --- anchors -------------------------------------------------------------------------


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all ``width``-byte strings, by doubling."""
    power, size = BASE, 1
    block = data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if width & size:
            # out covers the first `done` bytes; append the next `size`.
            out = block if out is None else out[: len(out) - size] * power + block[done : done + len(out) - size]
            done += size
        if done == width:
            return out[: len(data) - width + 1]
        block = block[:-size] * power + block[size:]
        power, size = np.uint64(int(power) ** 2 & MASK64), size * 2


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, windows, offset, gram hash) of each run of valid windows with one anchor."""
    hashes = rolling_hashes(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    order = ((hashes ^ (hashes >> np.uint64(29))) * MIX) & ~mask
    least = sliding_minimum(order | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    place = (least & mask).astype(np.int64)
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.empty(0, dtype=np.int64),) * 4
    at = place[starts]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(starts) != 1))))
    windows = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], at[first]
    return begin, windows, anchor - begin, hashes[anchor].view(np.int64)


def anchor_rows(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, windows, offset, gram hash, context hash) in scans of bounded size."""
    scan: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, SCAN):
            piece = text[at : at + SCAN + length - 1]
            if held + len(piece) > SCAN + length - 1 and scan:
                yield _scanned(scan, length, gram)
                scan, held = [], 0
            scan.append((number, at, piece))
            held += len(piece)
    if scan:
        yield _scanned(scan, length, gram)


def _scanned(scan: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    joined = b"".join(piece for _, _, piece in scan)
    sizes = np.array([len(piece) for _, _, piece in scan])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(scan)), sizes)
    data = np.frombuffer(joined, dtype=np.uint8)
    valid = owner[: len(data) - length + 1] == owner[length - 1 :]
    start, windows, offset, grams = anchors(data, valid, length, gram)
    digest = xxhash.xxh64_intdigest
    ends = start + windows + (length - 1)
    context = np.array([digest(joined[a:b]) for a, b in zip(start.tolist(), ends.tolist())], dtype=np.uint64).view(np.int64)
    of = owner[start]
    numbers, bases = np.array([s[0] for s in scan]), np.array([s[1] for s in scan])
    return numbers[of], start - begins[of] + bases[of], windows, offset, grams, context


# --- words ---------------------------------------------------------------------------


@cache
def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base)
    out[0] = 1
    return np.cumprod(out)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each maximal run of other bytes than ASCII white space begins and ends."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = (data != 0x20) & (data - np.uint8(0x09) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, 64-bit hash) of each word."""
    data = np.frombuffer(text, dtype=np.uint8)
    begins, ends = word_bounds(data)
    codes = np.empty(len(begins), dtype=np.uint64)
    at = 0
    while at < len(begins):
        first = begins[at]
        to = int(np.searchsorted(ends, first + SCAN, side="right"))
        if to == at:  # longer than a scan
            codes[at] = xxhash.xxh64_intdigest(text[first : ends[at]])
            at += 1
            continue
        piece = data[first : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * _powers(BASE, SCAN)[: len(piece)], out=sums[1:])
        a, b = begins[at:to] - first, ends[at:to] - first
        codes[at:to] = (sums[b] - sums[a]) * _powers(INVERSE, SCAN)[a]
        at = to
    # Sums of these must not be sums of bytes.
    for _ in range(2):
        codes = (codes ^ (codes >> np.uint64(32))) * MIX
    return begins, codes ^ (codes >> np.uint64(32))


def word_rows(texts: list[bytes], words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``anchor_rows``, with starts, windows and offsets in words."""
    first = 0
    while first < len(texts):
        to, held = first + 1, len(texts[first])
        while to < len(texts) and held + len(texts[to]) < SCAN:
            held += len(texts[to]) + 1
            to += 1
        begins, codes = word_codes(b"\n".join(texts[first:to]))
        ends = np.cumsum([len(t) + 1 for t in texts[first:to]])
        owner = np.searchsorted(ends, begins, side="right")
        for at in range(0, len(codes) - words + 1, SCAN):
            part, of = codes[at : at + SCAN + words - 1], owner[at : at + SCAN + words - 1]
            start, windows, offset, grams = anchors(part, of[: len(part) - words + 1] == of[words - 1 :], words, gram)
            raw, stops = part.tobytes(), start + windows + (words - 1)
            context = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(start.tolist(), stops.tolist())], dtype=np.uint64).view(np.int64)
            text = of[start]
            yield first + text, at + start - np.searchsorted(owner, text), windows, offset, grams, context
        first = to


# --- deep-shallow sorting ------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the bytes at which they branch; a search compares one string in full."""

    def __init__(self):
        self.root: list | tuple | None = None
        self.texts: dict[int, bytes] = {}

    @staticmethod
    def _byte(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def insert(self, text: bytes, row: int) -> None:
        """Inner nodes are (depth, children by byte), leaves are lists of rows."""
        if self.root is None:
            self.root, self.texts[row] = [row], text
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(self._byte(text, depth)) or next(iter(children.values()))
        other = self.texts[node[0]]
        shared = common_prefix(text, other)
        if shared == len(text) == len(other):
            node.append(row)
            return
        self.texts[row] = text
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            above, node = node, node[1][self._byte(text, node[0])]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][self._byte(text, shared)] = [row]
            return
        split = (shared, {self._byte(other, shared): node, self._byte(text, shared): [row]})
        if above is None:
            self.root = split
        else:
            above[1][self._byte(text, above[0])] = split

    def rows(self) -> list[int]:
        """In ascending order of the strings; a prefix comes before what it begins."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def multikey_quicksort(words: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (8 bytes each) within ``groups`` (ascending), and the
    segments still tied on all words.

    All segments are partitioned at once around a pivot word each; the equal part goes on
    to the next word, the others stay at theirs.
    """
    order = np.arange(len(words))
    segment = np.cumsum(np.concatenate(([0], groups[1:] != groups[:-1]))) if len(groups) else groups
    depth = np.zeros(segment[-1] + 1 if len(segment) else 0, dtype=np.int64)
    while True:
        sizes = np.bincount(segment, minlength=len(depth))
        active = (sizes > 1) & (depth < words.shape[1])
        places = np.flatnonzero(active[segment])
        if not len(places):
            return order, segment
        own = segment[places]
        word = words[order[places], depth[own]]
        begins = np.cumsum(sizes) - sizes
        middle = np.searchsorted(places, begins[own] + sizes[own] // 2)
        pivot = word[middle]
        part = (word > pivot).astype(np.int64) - (word < pivot)
        move = np.argsort(own * 3 + part + 1, kind="stable")
        order[places] = order[places[move]]
        parts = np.zeros(len(segment), dtype=np.int64)
        parts[places] = part[move]
        fresh = np.concatenate(([True], (segment[1:] != segment[:-1]) | (parts[1:] != parts[:-1])))
        old, kind = segment[fresh], parts[fresh]
        depth = depth[old] + (active[old] & (kind == 0))
        segment = np.cumsum(fresh) - 1


def deep_shallow(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``texts`` within ascending ``groups``, and the common prefix of each with the
    one before it (-1 where a group begins)."""
    count = len(texts)
    if not count:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    lengths = np.array([len(t) for t in texts])
    width = max(SHALLOW, -(-int(lengths.max()) // 8) * 8)
    table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(count, width)
    shallow = table[:, :SHALLOW].copy().view(">u8").astype(np.uint64)
    order, segment = multikey_quicksort(shallow, groups)
    sizes = np.bincount(segment)
    ends = np.cumsum(sizes)
    for tied in np.flatnonzero(sizes > 1):
        place = slice(ends[tied] - sizes[tied], ends[tied])
        trie = BlindTrie()
        for row in order[place].tolist():
            trie.insert(texts[row], row)
        order[place] = trie.rows()
    above, below = order[:-1], order[1:]
    differ = table[above] != table[below]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(lengths[above], lengths[below]))
    return order, np.concatenate(([-1], np.where(groups[above] == groups[below], shared, -1)))


def repeated_windows(contexts: list[bytes], offsets: np.ndarray, windows: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """For each row and offset o of a window's anchor (columns): is the window repeated?

    Rows of a group share their anchor's gram; row i has the windows at offsets
    ``offsets[i] - windows[i] + 1`` to ``offsets[i]``.
    """
    count = len(contexts)
    cuts = offsets.tolist()
    after, shared_after = deep_shallow([c[o:] for c, o in zip(contexts, cuts)], groups)
    before, shared_before = deep_shallow([c[:o][::-1] for c, o in zip(contexts, cuts)], groups)
    place = np.arange(count)
    lowest = offsets - windows + 1
    out = np.zeros((count, int(offsets.max()) + 1), dtype=bool)
    stretch = np.empty(count, dtype=np.int64)
    for o in range(int(lowest.min()), int(offsets.max()) + 1):
        active = np.flatnonzero((lowest <= o) & (o <= offsets))
        if len(active) < 2:
            continue
        # A row's stretch is named by the first place of it.
        stretch[after] = np.maximum.accumulate(np.where(shared_after < length - o, place, 0)) * count
        name = stretch[active]
        stretch[before] = np.maximum.accumulate(np.where(shared_before < o, place, 0))
        name = name + stretch[active]
        sort = np.argsort(name)
        name = name[sort]
        same = name[1:] == name[:-1]
        out[active[sort[1:][same]], o] = True
        out[active[sort[:-1][same]], o] = True
    return out


# --- over a table --------------------------------------------------------------------


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({KEY[0]: F.xxhash64(text), KEY[1]: F.xxhash64(F.lit(SECOND_SEED), text)})


def _arrow(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_pydict(columns)

    ship_package(df.sparkSession)
    return df.mapInArrow(releasing(run), schema)


ANCHORS = "__llm_k1 long, __llm_k2 long, start long, windows long, offset long, gram long, context long"


def anchor_table(docs: DataFrame, text_col: str, length: int, gram: int, shortest: int | None = None, rows_of: Callable = anchor_rows) -> DataFrame:
    """The rows that ``rows_of`` finds in texts of at least ``shortest`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for of, start, windows, offset, grams, context in rows_of(texts, length, gram):
                yield {KEY[0]: k1[of], KEY[1]: k2[of], "start": start, "windows": windows, "offset": offset, "gram": grams, "context": context}

    # Texts too short for a window need no look.
    long_enough = F.octet_length(F.col(text_col)) >= (length if shortest is None else shortest)
    return _arrow(_keyed(docs.select(text_col), text_col).where(long_enough).select(*KEY, text_col), ANCHORS, work)


CONTEXTS = "gram long, __llm_k1 long, __llm_k2 long, start long, windows long, offset long, once boolean, bytes binary"


def context_table(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted row of ``texts`` (key, text, wanted)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in CONTEXTS.split(", ")}
            for row in batch.to_pylist():
                data = row["text"].encode()
                for w in row["wanted"]:
                    start, windows = w["start"], w["windows"]
                    values = (w["gram"], row[KEY[0]], row[KEY[1]], start, windows, w["offset"], w["once"], data[start : start + windows + length - 1])
                    for column, value in zip(out.values(), values):
                        column.append(value)
            yield {k: pa.array(v, pa.bool_() if k == "once" else pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()}

    return _arrow(texts, CONTEXTS, work)


PIECES = "part long, piece long, __llm_k1 long, __llm_k2 long, start long, once boolean, hashes array<long>"


def piece_table(texts: DataFrame, length: int) -> DataFrame:
    """The pieces of each wanted row of ``texts``: the ``part`` that equal windows have in
    common, the hash of the whole piece, and the hash of each window from ``start`` on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
                data = row["text"].encode()
                for w in row["wanted"]:
                    for part, piece, start, hashes in _pieces(data, w, length):
                        for column, value in zip(out.values(), (part, piece, row[KEY[0]], row[KEY[1]], start, w["once"], hashes)):
                            column.append(value)
                kinds = {"once": pa.bool_(), "hashes": pa.list_(pa.int64())}
                yield {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    return _arrow(texts, PIECES, work)


def _pieces(data: bytes, wanted: dict, length: int) -> Iterator[tuple[int, int, int, list[int]]]:
    start, windows, offset = (wanted[k] for k in ("start", "windows", "offset"))

    def digest(a: int, b: int, seed: int) -> int:
        return xxhash.xxh64_intdigest(data[a:b], seed) - (1 << 63)

    anchor = start + offset
    for piece in range((offset - windows + 1) // PIECE, offset // PIECE + 1):
        low, high = max(piece * PIECE, offset - windows + 1), min(piece * PIECE + PIECE - 1, offset)
        # These bytes are in every window whose anchor is at an offset of the piece.
        core = digest(anchor - piece * PIECE, anchor - piece * PIECE - PIECE + 1 + length, piece)
        hashes = [digest(anchor - o, anchor - o + length, o) for o in range(high, low - 1, -1)]
        yield core, digest(anchor - high, anchor - low + length, high), anchor - high, hashes


WINDOWS = "gram long, hash long, __llm_k1 long, __llm_k2 long, start long, own boolean"


def window_table(texts: DataFrame, words: int) -> DataFrame:
    """The hash of each window of the wanted rows of ``texts``, in words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                out: dict[str, list] = {f.split()[0]: [] for f in WINDOWS.split(", ")}
                raw = word_codes(row["text"].encode())[1].tobytes()
                for w in row["wanted"]:
                    for start in range(w["start"], w["start"] + w["windows"]):
                        digest = xxhash.xxh64_intdigest(raw[8 * start : 8 * (start + words)]) - (1 << 63)
                        for column, value in zip(out.values(), (w["gram"], digest, row[KEY[0]], row[KEY[1]], start, w["own"])):
                            column.append(value)
                yield {k: pa.array(v, pa.bool_() if k == "own" else pa.int64()) for k, v in out.items()}

    return _arrow(texts, WINDOWS, work)


RANGES = "__llm_k1 long, __llm_k2 long, start long, end long"


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """Byte ranges covered by repeated windows, of contexts that occur once."""

    def judged(rows: list[dict]) -> dict:
        groups = np.array([r["gram"] for r in rows])
        offsets, windows = np.array([r["offset"] for r in rows]), np.array([r["windows"] for r in rows])
        hit = repeated_windows([r["bytes"] for r in rows], offsets, windows, groups, length)
        out: dict[str, list] = {f.split()[0]: [] for f in RANGES.split(", ")}
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            row = rows[i]
            if row["once"]:
                # Offsets fall as window starts rise.
                flags = np.concatenate(([False], hit[i][::-1], [False])).astype(np.int8)
                edges = np.flatnonzero(np.diff(flags)).reshape(-1, 2)
                origin = row["start"] + row["offset"] - hit.shape[1] + 1
                for a, b in edges.tolist():
                    for column, value in zip(out.values(), (row[KEY[0]], row[KEY[1]], origin + a, origin + b - 1 + length)):
                        column.append(value)
        return {k: pa.array(v, pa.int64()) for k, v in out.items()}

    block_rows = BLOCK_ROWS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= block_rows and held[-1]["gram"] != row["gram"]:
                    yield judged(held)
                    held = []
                held.append(row)
        if held:
            yield judged(held)

    return _arrow(contexts.repartition("gram").sortWithinPartitions("gram"), RANGES, work)


def counted(pieces: DataFrame, length: int) -> DataFrame:
    """Byte ranges covered by repeated windows, of the pieces of contexts that occur once."""
    pieces = written(pieces, "pieces")
    same = F.first("hashes").alias("hashes")
    place = F.min(F.struct(*KEY, "start", "once")).alias("place")
    counts = written(pieces.groupBy("part", "piece").agg(F.count(F.lit(1)).alias("copies"), place, same), "piece-counts")
    copied = written(counts.where("copies > 1").select("part", "piece"), "repeated-pieces")
    end = F.col("start") + F.size("hashes") + (length - 1)
    whole = pieces.where("once").join(copied, ["part", "piece"], "left_semi").select(*KEY, "start", end.alias("end"))

    # Different pieces that may have some windows in common: one row for each window.
    several = counts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    mixed = counts.join(written(several, "mixed-parts"), "part", "left_semi")
    alone = (F.col("place.once") & (F.col("copies") == 1)).alias("alone")
    windows = mixed.select("part", "place.*", alone, F.posexplode("hashes").alias("at", "hash"))
    windows = written(windows.select("part", "hash", "alone", *KEY, (F.col("start") + F.col("at")).alias("start")), "piece-windows")
    again = windows.groupBy("part", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "hash")
    single = windows.where("alone").join(written(again, "repeated-windows"), ["part", "hash"], "left_semi")
    return whole.unionByName(single.select(*KEY, "start", (F.col("start") + length).alias("end")))


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _with_texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(key, text, wanted): each text that rows are wanted of, once."""
    texts = _keyed(docs.select(F.col(text_col).alias("text")), "text").join(_few(wanted.select(*KEY)), KEY, "left_semi")
    return texts.groupBy(*KEY).agg(F.first("text").alias("text")).join(wanted, KEY).select(*KEY, "text", "wanted")


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, ranges): per distinct text with a repeat, its repeated byte ranges (may overlap)."""
    rows = written(anchor_table(docs, text_col, length, gram), "anchors")
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("context").alias("low"), F.max("context").alias("high"))
    several = written(grams.where("rows > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")), "repeated-grams")
    rows = written(rows.join(several.hint("shuffle_hash"), "gram"), "repeated-anchors")

    contexts = rows.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"), F.min("mixed").alias("mixed"))
    contexts = written(contexts, "contexts")
    copied = contexts.where("copies > 1").select("gram", "context")
    end = F.col("start") + F.col("windows") + (length - 1)
    whole = rows.join(copied, ["gram", "context"], "left_semi").select(*KEY, "start", end.alias("end")).distinct()

    # One place for each context of the grams that have several.
    sizes = contexts.where("mixed").groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"))
    # Few, as each stands for many contexts; a table of its own, so that a gram's contexts need not meet.
    split = written(sizes.where(F.col("contexts") > SPLIT_ABOVE).select("gram", F.lit(True).alias("split")), "split-grams")
    place = F.min(F.struct(*KEY, "start", "windows", "offset")).alias("place")
    places = rows.where("mixed").groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"), place)
    once = (F.col("copies") == 1).alias("once")

    def fetched(places: DataFrame, name: str) -> DataFrame:
        wanted = places.select("place.*", F.struct("gram", "place.start", "place.windows", "place.offset", once).alias("w"))
        wanted = written(wanted.groupBy(*KEY).agg(F.collect_list("w").alias("wanted")), name)
        return _with_texts(docs, text_col, wanted)

    if split.isEmpty():
        parts = compared(context_table(fetched(places, "wanted"), length), length)
    else:
        places = written(places.join(split, "gram", "left"), "places")
        parts = compared(context_table(fetched(places.where("split is null"), "wanted"), length), length)
        parts = parts.unionByName(counted(piece_table(fetched(places.where("split"), "wanted-split"), length), length))

    ranges = whole.unionByName(parts).groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    return written(ranges, "repeated-ranges")


def shared_passages(docs: DataFrame, text_col: str = "text", words: int = WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(key, passages): per distinct text with any, the ranges of words (may overlap) of the
    strings of ``words`` words that another document has too."""
    rows = written(anchor_table(docs, text_col, words, gram, 2 * words - 1, word_rows), "word-anchors")
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("context", KEY[0]) for f in (F.min, F.max)]
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), *bounds)
    # Several contexts, not all of one text.
    mixed = F.expr(f"min_context != max_context and min_{KEY[0]} != max_{KEY[0]}").alias("mixed")
    several = written(grams.where("rows > 1").select("gram", mixed), "repeated-word-grams")
    # A table of its own: counted in the same stage, all rows of a gram would have to meet.
    rows = written(rows.join(several.hint("shuffle_hash"), "gram"), "repeated-word-anchors")
    # A row that occurs twice is of documents with equal texts.
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "distinct-word-anchors")

    shared = ((F.min(KEY[0]) != F.max(KEY[0])) | (F.max("copies") > 1)).alias("shared")
    contexts = written(rows.groupBy("gram", "context").agg(shared, F.min("mixed").alias("mixed")), "word-contexts")
    common = contexts.where("shared").select("gram", "context")
    whole = rows.join(common, ["gram", "context"], "left_semi").select(*KEY, "start", (F.col("start") + F.col("windows") + (words - 1)).alias("end"))

    # Of the grams that have several contexts: those of one document, and one place for each of the others.
    single = contexts.where("mixed and not shared").select("gram", "context")
    own = rows.join(single, ["gram", "context"], "left_semi").select(*KEY, F.struct("gram", "start", "windows", F.lit(True).alias("own")).alias("w"))
    place = F.min(F.struct(*KEY, "start", "windows")).alias("place")
    places = rows.where("mixed").groupBy("gram", "context").agg(shared, place)
    others = places.where("shared").select(*[f"place.{k}" for k in KEY], F.struct("gram", "place.start", "place.windows", F.lit(False).alias("own")).alias("w"))
    wanted = written(own.unionByName(others).groupBy(*KEY).agg(F.collect_list("w").alias("wanted")), "wanted-words")

    windows = written(window_table(_with_texts(docs, text_col, wanted), words), "word-windows")
    found = windows.groupBy("gram", "hash").agg(F.min(KEY[0]).alias("low"), F.max(KEY[0]).alias("high"), F.min("own").alias("own"))
    found = written(found.where("low != high or not own").select("gram", "hash"), "shared-windows")
    parts = windows.where("own").join(found, ["gram", "hash"], "left_semi").select(*KEY, "start", (F.col("start") + words).alias("end"))

    passages = whole.unionByName(parts).groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("passages"))
    return written(passages, "shared-passages")


def _merged(ranges: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for r in ranges:
        if out and r["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["end"])
        else:
            out.append([r["start"], r["end"]])
    return out


SPANS = "array<struct<start: bigint, end: bigint>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """Per document: id, n_bytes, the removed byte spans, the bytes kept, and as ``passages``
    the byte spans of the passages of ``words`` words or more that another document has too."""
    marks = repeated_ranges(docs, text_col, length, gram).join(shared_passages(docs, text_col, words, gram_words), KEY, "full")
    marks = written(marks, "marks")
    keys = _few(marks.select(*KEY))
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), "text")
    whole: Column = F.col("text").cast("binary")
    size, none = F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(SPANS)
    untouched = rows.join(keys, KEY, "left_anti").select("doc_id", size, none.alias("spans"), whole.alias("kept"), none.alias("passages"))
    touched = rows.join(keys, KEY, "left_semi").join(marks, KEY).select("doc_id", size, "ranges", "passages", "text")
    id_type = touched.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, passages = [], [], []
            for found, shared, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                data, merged = text.encode(), _merged(found or [])
                begins = [0, *(end for _, end in merged)]
                stops = [*(start for start, _ in merged), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(begins, stops)))
                spans.append([{"start": a, "end": b} for a, b in merged])
                first, last = word_bounds(np.frombuffer(data, dtype=np.uint8)) if shared else ((), ())
                passages.append([{"start": int(first[a]), "end": int(last[b - 1])} for a, b in _merged(shared or [])])
            columns = [batch.column(0), batch.column(1), pa.array(spans, ARROW_SPANS), pa.array(kept, pa.binary()), pa.array(passages, ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept", "passages"])

    schema = f"doc_id {id_type}, n_bytes long, spans {SPANS}, kept binary, passages {SPANS}"
    return untouched.unionByName(touched.mapInArrow(releasing(run), schema))
