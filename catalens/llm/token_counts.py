"""Token counts of texts under a unigram model, by dynamic programming over a trie.

A pre-token is a word with a mark in front.  The best segmentation of a pre-token is the
one with the highest sum of piece scores, and among those the fewest pieces.  The forward
score of a prefix does not depend on what follows, so the distinct pre-tokens of a batch
are put in a trie (in sorted order, which is its depth-first order, so that only the path
to the current node is held) and each node's score is computed once, however many words
share the prefix.  The end of a word stores its count; texts add up the counts.

Pieces come from a public vocabulary file whose path is a parameter.  It ranks its pieces;
their log probability is taken by Zipf's law from the rank.  Characters that no piece
covers fall back to their UTF-8 bytes, one token each, scored below every piece.

Nothing is shuffled: a worker remembers the counts of words it has met (at most
``REMEMBERED``), so common words cost one lookup wherever they are.

Defined cases: null, empty and white-space texts have 0 words and 0 tokens.  Very long
words are handled in time linear in their length.  Repeated rows get equal rows.  An empty table
gives an empty result.  Only the kept columns and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from catalens.llm.shared import map_texts

MARK = "▁"
REMEMBERED = 400_000
#: Characters of texts that are split into words at a time.
AT_ONCE = 4_000_000


def piece_scores(path: str) -> dict[str, float]:
    """Log probabilities of the pieces, from their rank in the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = math.log(sum(1.0 / rank for rank in range(1, len(pieces) + 1)))
    return {piece: -math.log(rank) - total for rank, piece in enumerate(pieces, 1)}


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        #: Of one byte of a character that no piece covers.
        self.byte_score = min(scores.values(), default=0.0) - 1.0

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens in the best segmentation of each distinct word."""
        out = {}
        # path[i]: (score, -tokens) of the first i characters of the current word.
        path: list[tuple[float, int]] = [(0.0, 0)]
        last = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                path.append(self._forward(word, end, path))
            out[word] = -path[len(word)][1]
            last = word
        return out

    def _forward(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        score, tokens = path[end - 1]
        best = (score + size * self.byte_score, tokens - size)
        scores = self.scores
        for start in range(max(0, end - self.longest), end):
            piece = scores.get(word[start:end])
            if piece is not None:
                score, tokens = path[start]
                here = (score + piece, tokens - 1)
                if here > best:
                    best = here
        return best


class Counter:
    """A model with the counts of the words it has met lately."""

    def __init__(self, model: Unigram):
        self.model, self.known = model, {}

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        words, tokens, first, held = [], [], 0, 0
        for i, text in enumerate(texts, 1):
            held += len(text or "")
            if held >= AT_ONCE or i == len(texts):
                more_words, more_tokens = self._count(texts[first:i])
                words += more_words
                tokens += more_tokens
                first, held = i, 0
        return words, tokens

    def _count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        split = [_words(t) if isinstance(t, str) else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = set().union(*split).difference(self.known)
        marked = self.model.counts(MARK + w for w in new)
        self.known.update((w[1:], n) for w, n in marked.items())
        return [len(w) for w in split], [sum(map(self.known.__getitem__, w)) for w in split]


def _words(text: str) -> list[str]:
    """Runs of other characters than ASCII white space."""
    if text.isascii():
        # str.split also cuts at the separators 1C to 1F.
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else _bytes_split(text)
    return _bytes_split(text)


def _bytes_split(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Unigram(piece_scores(path)))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_words and n_tokens of every whole text."""
    new = {"n_words": ("bigint", pa.int64()), "n_tokens": ("bigint", pa.int64())}
    return map_texts(docs, text_col, keep, new, lambda: counter(vocabulary).count)
