"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re

import xxhash

WHITE = re.compile("[^\x20\x09-\x0d]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text):
    words = WHITE.findall(ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """Smallest reachable index of each item."""
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(i):
                if label[i] != label[j] and linked(items[i], items[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def duplicated_bytes(texts, width=400):
    """Per text: which bytes a repeated string of ``width`` bytes covers."""
    where = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - width + 1):
            where.setdefault(b[i : i + width], []).append((d, i))
    marks = [bytearray(len(b)) for b in data]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i : i + width] = b"\1" * width
    return data, marks


def unigram_tokens(word, scores, byte_score):
    """Tokens of the best segmentation, trying every one that ends in a piece or in bytes."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, best[end - 1][1] - size)]
        for start in range(end):
            if word[start:end] in scores:
                options.append((best[start][0] + scores[word[start:end]], best[start][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def prose(rng, words, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
