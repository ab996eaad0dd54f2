"""Two tokenizers aligned byte by byte, with corpus-wide counts of the id pairs that meet.

Both tokenizers spell a text as bytes.  Where a token of each ends at the same byte, a group
ends.  Tokens whose bytes overlap are linked; an id pair's count is how many links of the
whole corpus hold it.

1. The first pass aligns all documents; each task hands on its distinct pairs with counts.
2. Distinct pairs are dealt by a hash to shards of about ``SHARD_PAIRS``, and each shard gets
   a minimal perfect hash: a key that alone falls on a place of a level's bit array has
   it, the others go on to the next level, and the place's rank is the key's index.
   The keys are stored in that order, so a pair that is no member is told from one that is.
3. Counts are dense vectors, one a shard and leaf, indexed by the hash.  They are summed up
   a tree of ``FAN`` branches, each vector of ``SHARD_PAIRS`` numbers at most.
4. The second pass aligns the documents again and looks their pairs up.

Alignment works on units: a blank that follows a visible character starts one.  Neither
tokenizer has a token across such a place (the byte-level one splits there, and no piece of
the other has its blank mark after another character, which is checked), so a text's tokens
are those of its units one after the other.  A worker remembers the units it has met, up
to ``HELD_BYTES``; common words are aligned and looked up once, wherever they are.

Memory: a worker holds its units, one shard's vector while counting, and at most
``TABLE_BYTES`` of shards while looking up; further shards are read again as needed.  The
highest count of each id of the second tokenizer is bounded by its vocabulary, and is
the only thing that the driver gathers.  Shards are files in the shared folder, written under
another name and renamed, so a task run twice leaves one whole file.

Defined cases: texts that are null, empty, or not spelled back byte for byte by both tokenizers
(as one with U+2581) have no tokens: zeros, no groups, no links that count.  Repeated rows
count as often as they occur.  Very long texts are cut at blanks; one without blanks is one
unit.  Empty tables give empty results.  Only the columns named are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.shared import map_columns, release_memory, sliced, work_folder, written
from catalens.llm.token_output import byte_letters

BLANK_MARK = "▁"
#: A blank after a visible character and before anything.
CUT = re.compile(r"(?<=[!-~\w]) (?=.)", re.DOTALL)
VISIBLE = re.compile(r"[!-~\w]")
#: Bytes of units, about, after which a worker starts afresh.
HELD_BYTES = 80 << 20
#: Distinct pairs in a shard, about; and the most shards there can be.
SHARD_PAIRS = 1 << 20
MOST_SHARDS = 1 << 20
#: Rows of pairs that a leaf of the tree adds up, about, and branches of the tree.
LEAF_ROWS = 4 << 20
FAN = 8
#: Bytes of shards that a worker holds while looking up.
TABLE_BYTES = 192 << 20
#: Places for each key of a level of the perfect hash.
PLACES = 2
PAIR_BITS = 32
LOW_ID = (1 << PAIR_BITS) - 1
#: Bytes of texts that are aligned at a time, about.
AT_ONCE = 4 << 20
#: Characters of a unit beyond which it is encoded by itself, in time that grows less with them.
LONG_UNIT = 500
# Fixed value: how byte-level tokenizers of this kind split a text.
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key (the finalizer of SplitMix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(pairs: np.ndarray) -> np.ndarray:
    """The number that decides a pair's shard."""
    return (mixed(pairs, 1 << 20) % np.uint64(MOST_SHARDS)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct keys: the index of each, from 0 on."""

    def __init__(self, levels: list[np.ndarray]):
        #: Bit arrays, 64 places a word.
        self.levels = levels
        self.ranks, n = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.n = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            words = -(-PLACES * len(keys) // 64)
            place = (mixed(keys, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words)[place] == 1
            bits = np.zeros(64 * words, dtype=np.uint8)
            bits[place[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            keys = keys[~alone]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of one that was not built in, any index or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            place = mixed(keys[left], level) % np.uint64(64 * len(words))
            at, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            word = words[at]
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (ranks[at] + before)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class Shard:
    """A perfect hash with its keys, and their counts if they are known."""

    def __init__(self, hashed: PerfectHash, keys: np.ndarray, counts: np.ndarray | None = None):
        self.hashed, self.keys, self.counts = hashed, keys, counts

    @classmethod
    def build(cls, keys: np.ndarray) -> Shard:
        hashed = PerfectHash.build(keys)
        placed = np.empty(len(keys), dtype="<i8")
        placed[hashed.index(keys)] = keys
        return cls(hashed, placed)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, all of which must be members."""
        at = self.hashed.index(keys)
        if len(keys) and (at.min() < 0 or not np.array_equal(self.keys[at], keys)):
            raise ValueError("a pair was not there when pairs were counted")
        return at

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes + r.nbytes for w, r in zip(self.hashed.levels, self.hashed.ranks)) + 16 * len(self.keys)

    def dump(self) -> bytes:
        sizes = [len(w) for w in self.hashed.levels]
        head = struct.pack(f"<QQ{len(sizes)}Q", len(self.keys), len(sizes), *sizes)
        return b"".join([head, *(w.tobytes() for w in self.hashed.levels), self.keys.tobytes()])

    @classmethod
    def load(cls, data: bytes, counts: bytes | None = None) -> Shard:
        n, k = struct.unpack_from("<QQ", data)
        sizes = struct.unpack_from(f"<{k}Q", data, 16)
        at, levels = 16 + 8 * k, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(PerfectHash(levels), np.frombuffer(data, "<i8", n, at), None if counts is None else np.frombuffer(counts, "<i8"))


def write_file(folder: str, name: str, data: bytes) -> None:
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{root}/{name}")


def read_file(folder: str, name: str) -> bytes:
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def keys_file(shard: int) -> str:
    return f"pairs-{shard:07d}.bin"


def counts_file(shard: int) -> str:
    return f"counts-{shard:07d}.bin"


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def among(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the ascending ``ends`` are among the ascending ``others``."""
    if not len(others):
        return np.zeros(len(ends), dtype=bool)
    return others[np.minimum(np.searchsorted(others, ends), len(others) - 1)] == ends


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary whose merges go by ascending id."""
    with open(path, encoding="utf-8") as source:
        model = json.load(source)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = np.array([model["vocab"][a + b] for a, b in pairs])
    value = {letter: byte for byte, letter in enumerate(byte_letters())}
    if (np.diff(merged) <= 0).any() or not set(value) <= set(model["vocab"]):
        raise ValueError("not a byte-level vocabulary in the order of its merges")
    out = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        out[i] = bytes(map(value.__getitem__, token))
    return out


class Aligner:
    """Units met lately, by place: their tokens aligned, and what is known of them.

    For a byte-level tokenizer that splits between blanks, letters and other marks, and a
    piece tokenizer that puts a blank mark in front and none after another character within
    a piece.  New units are aligned many at a time, as if they were one text: every unit
    ends at a byte where a token of each ends.
    """

    def __init__(self, byte_path: str, piece_path: str, spell: bool):
        """``spell``: whether the groups are to be written out."""
        # Spark runs a worker per core; more threads in each would only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_path)
        self.byte_level.encode_special_tokens = True
        self.a_bytes = byte_tokens(byte_path)
        # The same tokenizer, many times as fast; it has no special tokens.
        ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = list(map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))
        if any(re.search(f"[^{BLANK_MARK}]{BLANK_MARK}", name) for name in names):
            raise ValueError("a piece has a blank after another character")
        self.b_bytes = [
            bytes([int(name[3:-1], 16)]) if self.pieces.is_byte(i) else name.replace(BLANK_MARK, " ").encode() for i, name in enumerate(names)
        ]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.spell = spell
        # Ids as they are written within a group, at the end of its first part, at its end.
        self.a_written, self.b_written = (
            [np.array([f"{i}{mark}" for i in range(len(x))], dtype=object) for mark in marks] for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
        )
        self.lookup: Lookup | None = None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        #: Of each unit: whether its tokens spell it, and whether a blank after it starts another.
        self.good, self.closed = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
        self.numbers = np.zeros((0, 4), dtype=np.int64)
        #: One entry a link: the first tokenizer's id in the high bits, the second's in the low.
        self.links, self.link_ends = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.held = 0
        self.judge_by(self.lookup and self.lookup.counts)

    def judge_by(self, counts: PairCounts | None) -> None:
        """``facts`` are to be those by ``counts``; none of them is known yet."""
        if counts is None or self.lookup is None or self.lookup.counts.folder != counts.folder:
            self.lookup = None if counts is None else Lookup(counts)
        self.facts = np.zeros((0, len(COUNTS)), dtype=np.int64)
        self.judged = np.zeros(0, dtype=bool)

    def encoded(self, pieces: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokenizer's ids of the units, and how many each has; ``ends``: where units
        end, in bytes."""
        if all(len(p) <= LONG_UNIT for p in pieces):
            ids = self.fast.encode_to_numpy(" " + " ".join(pieces), disallowed_special=()).astype(np.int64)
            places = np.searchsorted(np.cumsum(self.a_sizes[ids]), ends, side="right")
            return ids, np.diff(places, prepend=0)
        each = [self.byte_level.encode(f" {p}", add_special_tokens=False).ids for p in pieces]
        return flat(each), np.array(list(map(len, each)), dtype=np.int64)

    def add(self, pieces: list[str]) -> None:
        """Align new units: a blank and each of ``pieces``."""
        closed = np.array([p != "" and VISIBLE.match(p[-1]) is not None for p in pieces], dtype=bool)
        # Units that may stand one after the other as one text, then all others one by one.
        alike = [p for p, own in zip(pieces, closed) if own and len(p) <= LONG_UNIT]
        if alike:
            self._add(alike, True)
        for p, own in zip(pieces, closed):
            if not own or len(p) > LONG_UNIT:
                self._add([p], bool(own))

    def _add(self, pieces: list[str], closed: bool) -> None:
        whole = " " + " ".join(pieces)
        spelled = whole.encode()
        sizes = np.array(list(map(len, pieces)) if whole.isascii() else [len(p.encode()) for p in pieces], dtype=np.int64) + 1
        ends = np.cumsum(sizes)
        a, n_a = self.encoded(pieces, ends)
        b = self.pieces.encode(pieces, num_threads=1)
        n_b = np.array(list(map(len, b)), dtype=np.int64)
        b = flat(b)
        unit_a, unit_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
        size_of = lambda unit, sizes: np.bincount(unit, sizes, len(pieces)).astype(np.int64)
        good = (size_of(unit_a, self.a_sizes[a]) == sizes) & (size_of(unit_b, self.b_sizes[b]) == sizes)
        joined = b"".join(map(self.b_bytes.__getitem__, b.tolist())) if good.all() else b""
        if joined != spelled:
            stops = np.cumsum(n_b)
            for i, (end, to) in enumerate(zip(ends.tolist(), stops.tolist())):
                own = b"".join([self.b_bytes[t] for t in b[to - n_b[i] : to]])
                good[i] &= own == spelled[end - sizes[i] : end]
        if not pieces[0]:
            good[0] = False
        if not good.all():
            a, unit_a, b, unit_b = a[good[unit_a]], unit_a[good[unit_a]], b[good[unit_b]], unit_b[good[unit_b]]
            n_a, n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # The second tokenizer's tokens that a token of the first overlaps: from, to.
        low = np.searchsorted(end_b, end_a - self.a_sizes[a], side="right")
        n = np.searchsorted(end_b, end_a) - low + 1
        links = np.repeat(a, n) << PAIR_BITS | b[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends_group, ends_too = among(end_a, end_b), among(end_b, end_a)
        count = lambda unit, weights=None: np.bincount(unit, weights, len(pieces)).astype(np.int64)
        numbers = np.stack((n_a, n_b, count(unit_a, ends_group), count(unit_a, n)), axis=1)

        base = len(self.place)
        self.place.update(zip(pieces, range(base, base + len(pieces))))
        self.good = np.concatenate((self.good, good))
        self.closed = np.concatenate((self.closed, np.full(len(pieces), closed)))
        self.numbers = np.concatenate((self.numbers, numbers))
        self.link_ends = np.concatenate((self.link_ends, len(self.links) + np.cumsum(numbers[:, 3])))
        self.links = np.concatenate((self.links, links))
        self.held += 250 * len(pieces) + 8 * len(links) + 2 * sum(map(len, pieces))
        if self.spell:
            written_a = np.where(ends_group, self.a_written[1][a], self.a_written[0][a])
            written_b = np.where(ends_too, self.b_written[1][b], self.b_written[0][b])
            group = np.concatenate((np.cumsum(ends_group) - ends_group, np.cumsum(ends_too) - ends_too))
            order = np.argsort(2 * group + np.repeat((0, 1), (len(a), len(b))), kind="stable")
            texts = np.concatenate((written_a, written_b))[order].tolist()
            ends = np.cumsum(n_a + n_b).tolist()
            spelled = ["".join(texts[i:j])[:-1] for i, j in zip([0, *ends], ends)]
            self.groups += spelled
            self.held += sum(map(len, spelled))

    def known(self, pieces: list[str]) -> np.ndarray:
        """The places of units, aligned now if they are new."""
        new = [p for p in pieces if p not in self.place]
        if new:
            self.add(list(dict.fromkeys(new)))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int32, len(pieces))

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, one after the other, and where each text's end; none of a text
        that has no tokens."""
        plain = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, BLANK_MARK)))
        plain = pc.fill_null(plain, False).to_numpy(zero_copy_only=False)
        listed = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        n = np.zeros(len(texts), dtype=np.int64)
        n[plain] = pc.list_value_length(listed).to_numpy()
        coded = listed.flatten().dictionary_encode()
        units = self.known(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.cumsum(n)
        last = np.zeros(len(units), dtype=bool)
        last[ends[n > 0] - 1] = True
        # Within a text, all units but the last must let a blank start the next.
        bad = np.cumsum(np.concatenate(([0], ~self.good[units] | ~(self.closed[units] | last))))
        odd = np.flatnonzero(bad[ends] > bad[ends - n])
        if len(odd):
            split = np.split(units, ends[:-1])
            for i in odd.tolist():
                own = self.known(CUT.split(texts[i].as_py()))
                split[i] = own if self.good[own].all() else own[:0]
            units, ends = np.concatenate(split), np.cumsum(list(map(len, split)))
        return units, ends

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the units, and the number of each unit's."""
        n = self.numbers[units, 3]
        starts = self.link_ends[units] - n
        return self.links[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def judge(self, used: np.ndarray) -> None:
        """Fill in ``facts`` of the units at ``used``, which are units of texts that were counted."""
        more = len(self.place) - len(self.facts)
        self.facts = np.concatenate((self.facts, np.zeros((more, len(COUNTS)), dtype=np.int64)))
        self.judged = np.concatenate((self.judged, np.zeros(more, dtype=bool)))
        new = pd.unique(used[~self.judged[used]])
        links, n = self.links_of(new)
        place, pairs = pd.factorize(links)
        own = np.repeat(new, n)
        counts = self.lookup(pairs)
        best = counts == self.lookup.counts.highest[pairs & LOW_ID]
        self.facts[new, :4] = self.numbers[new]
        np.add.at(self.facts[:, 4], own, best[place].astype(np.int64))
        np.add.at(self.facts[:, 5], own, counts[place])
        self.judged[new] = True

    def full(self) -> bool:
        return self.held > HELD_BYTES


_ALIGNERS: dict[tuple[str, str, bool], Aligner] = {}


def aligner(byte_path: str, piece_path: str, spell: bool) -> Aligner:
    """One per worker process and purpose; the other makes room."""
    key = byte_path, piece_path, spell
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    for other, held in _ALIGNERS.items():
        if other != key:
            held.forget()
    return _ALIGNERS[key]


@dataclass(frozen=True)
class PairCounts:
    """Counts of id pairs as files: their folder, shards, and each second id's highest count."""

    folder: str
    shards: int
    highest: np.ndarray

    def pairs(self, spark) -> DataFrame:
        """(a, b, n): the counted pairs as rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number in (n for batch in batches for n in batch.column(0).to_pylist()):
                shard = self.shard(number)
                yield pa.RecordBatch.from_pydict({"a": shard.keys >> PAIR_BITS, "b": shard.keys & LOW_ID, "n": shard.counts})

        numbers = spark.read.parquet(f"{self.folder}/shards").repartition(self.shards, "shard")
        return numbers.mapInArrow(run, "a long, b long, n long")

    def shard(self, shard: int) -> Shard:
        return Shard.load(read_file(self.folder, keys_file(shard)), read_file(self.folder, counts_file(shard)))


class Lookup:
    """Counts of pairs, holding the shards used last."""

    def __init__(self, counts: PairCounts):
        self.counts, self.held, self.nbytes = counts, OrderedDict(), 0

    def _shard(self, number: int) -> Shard:
        if number not in self.held:
            self.held[number] = shard = self.counts.shard(number)
            self.nbytes += shard.nbytes
            while self.nbytes > TABLE_BYTES and len(self.held) > 1:
                self.nbytes -= self.held.popitem(last=False)[1].nbytes
        self.held.move_to_end(number)
        return self.held[number]

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        own = slots(pairs) % self.counts.shards
        order = np.argsort(own, kind="stable")
        out = np.empty(len(pairs), dtype=np.int64)
        values, starts = np.unique(own[order], return_index=True)
        for value, at in zip(values.tolist(), np.split(order, starts[1:])):
            shard = self._shard(value)
            out[at] = shard.counts[shard.index(pairs[at])]
        return out


def task_pairs(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """(node, slot, pair, n): each task's distinct pairs and how many links hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, node = aligner(byte_path, piece_path, False), TaskContext.get().partitionId()
        seen = np.zeros(0, dtype=np.int64)

        def counted() -> pa.RecordBatch:
            at = np.flatnonzero(seen)
            links, each = units.links_of(at)
            place, pairs = pd.factorize(links)
            n = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(n, place, np.repeat(seen[at], each))
            return pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(pairs), node), pa.int64()), "slot": slots(pairs), "pair": pairs, "n": n})

        for batch in batches:
            for texts in sliced(batch.column(0), batch.column(0), AT_ONCE):
                more = np.bincount(units.places(texts)[0], minlength=len(units.place))
                more[: len(seen)] += seen
                seen = more
                if units.full():
                    yield counted()
                    units.forget()
                    seen = seen[:0]
        yield counted()
        release_memory()

    texts = docs.select(F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "node long, slot long, pair long, n long")


def write_hashes(pairs: DataFrame, shards: int, folder: str) -> None:
    """Write the perfect hash of each shard of distinct (slot, pair) rows, and a list of shards."""
    own = F.pmod("slot", F.lit(shards)).alias("shard")
    dealt = pairs.select(own, "pair").repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches):
            built = Shard.build(rows[0])
            write_file(folder, keys_file(shard), built.dump())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "size": pa.array([len(built.keys)], pa.int64())})
        release_memory()

    dealt.mapInArrow(run, "shard long, size long").write.parquet(f"{folder}/shards")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of rows with the same first column, and their other columns."""
    shard, held = None, []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for at in np.split(np.arange(batch.num_rows), cuts):
            if len(at):
                own = int(columns[0][at[0]])
                if own != shard and held:
                    yield shard, [np.concatenate(c) for c in zip(*held)]
                    held = []
                shard = own
                held.append([c[at] for c in columns[1:]])
    if held:
        yield shard, [np.concatenate(c) for c in zip(*held)]


def leaf_vectors(rows: DataFrame, shards: int, leaves: int, folder: str) -> DataFrame:
    """(shard, leaf, counts): dense vectors of the counts of a share of the tasks."""
    own = F.pmod("slot", F.lit(shards)).alias("shard")
    dealt = rows.select((own * leaves + F.pmod("node", F.lit(leaves))).alias("place"), "pair", "n")
    dealt = dealt.repartition(shards * leaves, "place").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shard = vector = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([place // leaves]), "leaf": pa.array([place % leaves]), "counts": pa.array([vector.tobytes()])})

        for batch in batches:
            for now, (pairs, n) in by_shard(iter([batch])):
                if now != place:
                    if place is not None:
                        yield row()
                    if place is None or now // leaves != place // leaves:
                        shard = Shard.load(read_file(folder, keys_file(now // leaves)))
                    place, vector = now, np.zeros(len(shard.keys), dtype="<i8")
                np.add.at(vector, shard.index(pairs), n)
        if place is not None:
            yield row()
        release_memory()

    return dealt.mapInArrow(run, VECTORS)


VECTORS = "shard long, leaf long, counts binary"


def summed(vectors: DataFrame, leaves: int) -> DataFrame:
    """One vector for each shard, summed up a tree."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), "<i8") for v in group.column("counts"))
        return pa.table({"shard": group.column("shard")[:1], "leaf": group.column("leaf")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    while leaves > 1:
        up = vectors.withColumn("leaf", F.floor(F.col("leaf") / FAN))
        vectors = written(up.groupBy("shard", "leaf").applyInArrow(add, VECTORS), "vectors")
        leaves = -(-leaves // FAN)
    return vectors


def count_pairs(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", shard_pairs: int = SHARD_PAIRS, leaf_rows: int = LEAF_ROWS) -> PairCounts:
    """The counts of all pairs linked in ``docs``."""
    spark = docs.sparkSession
    folder = work_folder(spark, "pair-counts")
    rows = written(task_pairs(docs, byte_path, piece_path, text_col), "task-pairs")
    distinct = written(rows.select("slot", "pair").distinct(), "distinct-pairs")
    shards = min(MOST_SHARDS, -(-distinct.count() // shard_pairs)) or 1
    write_hashes(distinct, shards, folder)
    leaves = max(1, -(-rows.count() // (shards * leaf_rows)), min(FAN, rows.select("node").distinct().count()))
    totals = summed(leaf_vectors(rows, shards, leaves, folder), leaves)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts")):
                write_file(folder, counts_file(shard), counts.as_py())
                vector = np.frombuffer(counts.as_buffer(), "<i8")
                ids = Shard.load(read_file(folder, keys_file(shard))).keys & LOW_ID
                top = np.zeros(int(ids.max()) + 1, dtype=np.int64)
                np.maximum.at(top, ids, vector)
                met = np.flatnonzero(top)
                yield pa.RecordBatch.from_pydict({"b": met, "top": top[met]})
        release_memory()

    tops = written(totals.mapInArrow(store, "b long, top long"), "highest").groupBy("b").agg(F.max("top").alias("top"))
    best = tops.collect()  # a row for each id of the second vocabulary at most
    highest = np.zeros(max((r.b for r in best), default=-1) + 1, dtype=np.int64)
    for r in best:
        highest[r.b] = r.top
    return PairCounts(folder, shards, highest)


def align(docs: DataFrame, counts: PairCounts, byte_path: str, piece_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the token groups of each text as ``a1,a2|b1;a3|b2,b3``, and the
    numbers of tokens, groups, links, links with their second id's highest count, and the sum
    of the links' counts."""
    held = docs.sparkSession.sparkContext.broadcast(counts)  # a folder's name, and a number for each id of a vocabulary
    new = {"groups": ("string", pa.string()), **{name: ("bigint", pa.int64()) for name in COUNTS}}

    def start():
        units = aligner(byte_path, piece_path, True)
        if units.lookup is None or units.lookup.counts.folder != held.value.folder:
            units.judge_by(held.value)

        def work(texts: pa.Array) -> list:
            found, ends = units.places(texts)
            units.judge(found)
            begins = np.concatenate(([0], ends[:-1]))
            total = np.concatenate((np.zeros((1, len(COUNTS)), np.int64), np.cumsum(units.facts[found], axis=0)))
            spelled = list(map(units.groups.__getitem__, found.tolist()))
            groups = [";".join(spelled[i:j]) for i, j in zip(begins.tolist(), ends.tolist())]
            if units.full():
                units.forget()
            return [groups, *(total[ends] - total[begins]).T]

        return work

    return map_columns(docs, text_col, keep, new, start, AT_ONCE)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` with the counts of ``docs`` themselves."""
    return align(docs, count_pairs(docs, byte_path, piece_path, text_col), byte_path, piece_path, text_col, (id_col,))
