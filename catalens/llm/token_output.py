"""Token ids in binary shards, with document boundaries in Elias-Fano code.

A shard holds the documents of one range of ids, in ascending order, as one concatenated
id array; a range of more than ``SHARD_BYTES`` goes on in further shards.  Its boundaries are an Elias-Fano sequence: the low bits of every end packed
side by side, the high bits in unary, and the place of every ``STEP``-th set bit as a
select directory.  ``ends[i]`` is found without a table of 64-bit offsets.

Shard layout, little-endian: header (``HEADER``), two Elias-Fano sequences (ends of
documents, and their ids less the first one), then the token ids (16 bits each if the vocabulary
allows, else 32).  A sequence is its low bits, high bits and select directory; documents
without an id come first and are only counted.  A shard is written under a temporary name and renamed, so a
task that is run again, or twice at a time, leaves one whole file.  Spark's range
partitioning makes the ranges; the driver sees one short row for each shard.  What a task
holds is bounded by a shard and a batch of texts, however large the ranges.

Defined cases: a null text is empty and has the end id alone.  A null document id comes
first and is read back as null.  Rows of one id are ordered by their text's hash and are
spread over shards by it if they are many.  A very long text is encoded whole and may fill a
shard by itself.  An empty table writes no shard.  Columns but the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.shared import releasing, sliced, work_folder, written

END_ID = 1
MAGIC = b"EFIDS02\0"
#: magic, documents, tokens, bytes per token id, documents without an id, first id.
HEADER = struct.Struct("<8sQQIQq")
#: Of a sequence: low bits per number, words of high bits.
SEQUENCE = struct.Struct("<IQ")
STEP = 256
#: Bytes of ids at which a shard ends.
SHARD_BYTES = 64 << 20
#: Words whose ids a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Characters of a word beyond which it is encoded by itself, in time that grows less with them.
LONG_WORD = 500
#: Bytes of texts that are encoded at a time, about.
AT_ONCE = 4 << 20
#: Words whose ids are put together at a time.
PLACED = 1 << 17


class EliasFano:
    """A non-decreasing sequence of numbers in near-minimal space."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.width, self.low, self.high, self.directory = n, width, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(-(-(int(ones[-1]) + 1) // 64) * 64 if n else 0, dtype=np.uint8)
        bits[ones.astype(np.int64)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8") if n else np.empty(0, "<u8")
        return cls(n, width, low, high, ones[::STEP].astype("<u8"))

    def __getitem__(self, i: int) -> int:
        """The i-th number: from the directory's bit onwards, count ones word by word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.directory[i // STEP]), i % STEP
        word_no = at // 64
        word = int(self.high[word_no]) >> (at % 64) << (at % 64)
        while (ones := word.bit_count()) <= left:
            left -= ones
            word_no += 1
            word = int(self.high[word_no])
        for _ in range(left):
            word &= word - 1
        place = word_no * 64 + (word & -word).bit_length() - 1
        return (place - i) << self.width | self._low(i)

    def _low(self, i: int) -> int:
        start, stop = i * self.width, (i + 1) * self.width
        piece = int.from_bytes(self.low[start // 8 : -(-stop // 8)].tobytes(), "little")
        return piece >> (start % 8) & ((1 << self.width) - 1)

    def parts(self) -> list[bytes]:
        return [SEQUENCE.pack(self.width, len(self.high)), *(a.tobytes() for a in (self.low, self.high, self.directory))]

    @classmethod
    def read(cls, n: int, data: bytes, at: int) -> tuple[EliasFano, int]:
        """A sequence of ``n`` numbers at a place of ``data``, and the place after it."""
        width, words = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        arrays = []
        for kind, count in (("u1", -(-n * width // 8)), ("<u8", words), ("<u8", -(-n // STEP))):
            arrays.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += arrays[-1].nbytes
        return cls(n, width, *arrays), at

    def all(self) -> np.ndarray:
        """All numbers, without select."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n].astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        low = (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.width)) | low


def shard_parts(doc_ids: list[int | None], ends: np.ndarray, id_bytes: int) -> list[bytes]:
    """Everything of a shard before its token ids; ``doc_ids`` ascend, nulls first."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    # Ids lie within 64 bits, so the differences do as unsigned numbers.
    above = np.array(known, dtype=np.int64).astype(np.uint64) - np.uint64(first & (1 << 64) - 1)
    total = int(ends[-1]) if len(ends) else 0
    header = HEADER.pack(MAGIC, len(doc_ids), total, id_bytes, len(doc_ids) - len(known), first)
    return [header, *EliasFano.encode(ends).parts(), *EliasFano.encode(above).parts()]


class Shard:
    """A shard read back from its bytes."""

    def __init__(self, data: bytes):
        magic, self.n, self.total, id_bytes, self.unnamed, self.first = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.ends, at = EliasFano.read(self.n, data, HEADER.size)
        self.named, at = EliasFano.read(self.n - self.unnamed, data, at)
        self.ids = np.frombuffer(data, dtype=f"<u{id_bytes}", count=self.total, offset=at)

    def __len__(self) -> int:
        return self.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.first + self.named[i - self.unnamed]

    def span(self, i: int) -> tuple[int, int]:
        """Where a document's token ids begin and end."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        begin, end = self.span(i)
        return self.ids[begin:end]


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones as
    they are, the others numbered from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Encoder:
    """The ids of texts, put together from those of their words; words met lately are not
    encoded again.

    For byte-level tokenizers with word ends that lower-case, split at white space and between
    letters and other marks, and drop white space, as that of ``word_bpe_49k.json`` does: a
    text's ids are then those of its words one after the other, and a word's those of its
    letters and of the marks after them.  Texts are cut at blanks and line breaks only.

    Words of Latin letters are encoded all in one call: a blank stands for the word's end, so
    that the vocabulary is one of plain bytes, whose merges go by ascending id.  All others
    go through the whole of the tokenizer.
    """

    def __init__(self, path: str):
        # Spark runs a worker per core; more threads in each would only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = word_ranks(path)
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends_word = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in ranks.items() if len(token) > 1 and token.endswith(b" ")]] = True
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.id_bytes}")
        self.tails: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """No words, but one that stands for a document's end, and the empty one."""
        self.place = {"": 1}
        self.ids = np.array([END_ID], dtype=self.kind)
        self.starts, self.sizes = np.array([0, 1]), np.array([1, 0])

    def _stem(self, word: str) -> str | None:
        """The letters before the last marks, if the fast way holds for them."""
        stem = word.rstrip(",.!?")
        if len(stem) > LONG_WORD:
            return None
        low = stem.lower()
        # Letters that change their number in lower case are left to the tokenizer.
        return low if len(low) == len(stem) and low.isalpha() and max(low) < "\u0250" else None

    def _bytes(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def add(self, words: list[str]) -> None:
        stems = list(map(self._stem, words))
        letters = [s for s in stems if s is not None]
        ids = self.fast.encode_to_numpy(" ".join(letters) + " ", disallowed_special=()).astype(self.kind) if letters else np.zeros(0, self.kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(letters):
            raise ValueError("a word's letters have not one end")
        # Each word's ids: those of its letters and of the marks after them, or of the whole.
        spelled, bounds, k = ids.tobytes(), [0, *(ends * self.id_bytes).tolist()], 0
        parts = []
        for word, stem in zip(words, stems):
            if stem is None:
                parts.append(self._bytes(word))
                continue
            own = spelled[bounds[k] : bounds[k + 1]]
            k += 1
            if tail := word[len(stem) :] if len(word) != len(stem) else "":
                if tail not in self.tails:
                    self.tails[tail] = self._bytes(tail)
                own += self.tails[tail]
            parts.append(own)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.id_bytes
        base = len(self.place) + 1
        self.place.update(zip(words, range(base, base + len(words))))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(parts), dtype=self.kind)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end id, and where each text's end."""
        if len(self.place) > REMEMBERED:
            self.forget()
        listed = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        n = pc.list_value_length(listed).to_numpy().astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        del listed
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.place]:
            self.add(new)
        own = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))[coded.indices.to_numpy()]
        del words, new, coded
        own = np.insert(own, np.cumsum(n), 0)  # the document's end, after its words
        stops = np.cumsum(self.sizes[own])
        return self._joined(own, int(stops[-1]) if len(stops) else 0), stops[np.cumsum(n + 1) - 1]

    def _joined(self, own: np.ndarray, total: int) -> np.ndarray:
        """The ids of words by their places, a part of the words at a time: what says where each
        id is from takes many times the room of the ids."""
        out, at = np.empty(total, dtype=self.kind), 0
        for first in range(0, len(own), PLACED):
            part = own[first : first + PLACED]
            sizes = self.sizes[part]
            stops = np.cumsum(sizes)
            end = at + int(stops[-1])
            out[at:end] = self.ids[np.repeat(self.starts[part] - (stops - sizes), sizes) + np.arange(end - at)]
            at = end
        return out


def word_ranks(path: str) -> dict[bytes, int]:
    """The ids of a byte-level vocabulary with word ends, by the bytes they stand for and a
    blank for the word's end; merges must go by ascending id."""
    with open(path, encoding="utf-8") as source:
        model = json.load(source)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    value = {letter: byte for byte, letter in enumerate(byte_letters())}
    if (np.diff([vocab[a + b] for a, b in pairs]) <= 0).any() or not {*value, *(v + end for v in value)} <= set(vocab):
        raise ValueError("not a byte-level vocabulary with word ends, in the order of its merges")
    ranks = {}
    for token, i in vocab.items():
        spelled = token.removesuffix(end) if token != end else token
        if set(spelled) <= set(value):
            ranks[bytes(map(value.__getitem__, spelled)) + b" " * token.endswith(end)] = i
    return ranks


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SHARDS = "shard int, part int, docs long, tokens long"
READ_NAMES = ["doc_id", "start", "n_tokens", "ids_crc32"]


def write_shards(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; (shard, part, docs, tokens) for each, in the order of ids.

    ``folder`` must be one that all executors share.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ranges = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, coder = TaskContext.get(), encoder(vocabulary)
        shard, part_no = context.partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def finished() -> pa.RecordBatch:
            sizes = [len(c) // coder.id_bytes for c in ids]
            store, root = pafs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            final = shard_path(root, shard, part_no)
            own = f"{final}.{context.taskAttemptId()}.tmp"
            with store.open_output_stream(own) as out:
                for piece in (*shard_parts(doc_ids, np.cumsum(sizes), coder.id_bytes), *ids):
                    out.write(piece)
            store.move(own, final)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "part": pa.array([part_no], pa.int32()), "docs": [len(doc_ids)], "tokens": [sum(sizes)]}
            )

        for batch in (part for whole in batches for part in sliced(whole, whole.column("text"), AT_ONCE)):
            flat, ends = coder.encode(batch.column("text"))
            data, begin = flat.tobytes(), 0
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), (ends * coder.id_bytes).tolist()):
                coded = data[begin:end]
                begin = end
                if ids and held + len(coded) > shard_bytes:
                    yield finished()
                    doc_ids, ids, held, part_no = [], [], 0, part_no + 1
                doc_ids.append(doc_id)
                ids.append(coded)
                held += len(coded)
        if ids:
            yield finished()
        # The words of this range of documents are not kept for other tasks of the worker.
        coder.forget()

    # Written at once: the files and the list of them belong together.
    return written(ranges.mapInArrow(releasing(run), SHARDS), "shards")


def shard_path(root: str, shard: int, part: int) -> str:
    return f"{root}/shard-{shard:06d}-{part:06d}.bin"


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    listed, before = [], 0
    for row in shards.orderBy("shard", "part").collect():  # one short row per file
        listed.append((row.shard, row.part, before))
        before += row.tokens
    frame = shards.sparkSession.createDataFrame(listed, "shard int, part int, base long")
    frame = frame.repartition(max(1, len(listed)), "shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            with store.open_input_stream(shard_path(root, row["shard"], row["part"])) as source:
                shard = Shard(source.read())
            spans = list(map(shard.span, range(len(shard))))
            crc = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in spans]
            columns = [list(map(shard.doc_id, range(len(shard)))), [a + row["base"] for a, _ in spans], [b - a for a, b in spans], crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=READ_NAMES)

    return frame.mapInArrow(releasing(run), ", ".join(f"{name} long" for name in READ_NAMES))


def encode_corpus(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to a new shared folder and read them back."""
    folder = work_folder(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, vocabulary, folder, id_col, text_col), folder)
