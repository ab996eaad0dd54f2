from __future__ import annotations

import hashlib
import random
import re

import pytest

from catalens.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    ]


def random_text(rng):
    pieces = ["a", "b.c", "@", "@x.y", ".", "-", "+", "+1 ", "1", "255", "256", "00000012", " ", "\n", "é", "(555) ", "4111 1111 1111 1111", "1.2.3.4", "-7"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = random_text(rng)
        got = [f"{k}:{s}:{e}" for k, spans in pii.base_spans(text).items() for s, e in spans]
        assert got == plain(text), text


@pytest.mark.parametrize(
    ("text", "kind", "covered"),
    [
        ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
        ("mail jane at example dot com now", "email", "jane at example dot com"),
        ("j.d[at]mail.example.org", "email", "j.d[at]mail.example.org"),
        ("x jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("ｊ＠ｅｘ．ｃｏｍ", "email", "ｊ＠ｅｘ．ｃｏｍ"),
        ("host 10\u200b.0.0.1!", "ip", "10\u200b.0.0.1"),
        ("ring plus one five five five two one two three four", "phone", "plus one five five five two one two three four"),
        ("ring +1 five five five two one two three four now", "phone", "+1 five five five two one two three four"),
        ("four one one one 1111 1111 1111 1", None, None),
        ("look at example.com or dot it", None, None),
        ("one two three dot", None, None),
        ("at dot at dot", None, None),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, covered):
    added = [s for s in pii.spans_of(text) if not s[3]]
    if kind is None:
        assert added == []
    else:
        ((k, start, end, _),) = added
        assert (k, text[start:end]) == (kind, covered)


def test_base_spans_stay_and_nothing_is_added_over_them():
    rng = random.Random(2)
    disguises = [" (at) ", " dot ", "а", " at ", " one two three ", "\u200b", " five "]
    for _ in range(2000):
        text = "".join(rng.choice([random_text(rng)[:6], rng.choice(disguises)]) for _ in range(12))
        spans = pii.spans_of(text)
        assert [f"{k}:{s}:{e}" for k, s, e, base in spans if base] == plain(text)
        for kind in pii.KINDS:
            base = [(s, e) for k, s, e, b in spans if k == kind and b]
            assert not [1 for k, s, e, b in spans if k == kind and not b for x, y in base if s < y and x < e]
        assert all(0 <= s < e <= len(text) for _, s, e, _ in spans)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "a@", "1.", "+1", "one ", " at ", "а", "(at)", "1 ", "-"):
        pii.spans_of(unit * 200_000)


def test_query_digests(spark, documents, table_dir):
    rows = [(1, "a@b.c and 1.2.3.4"), (2, None), (3, ""), (4, "jane at example dot com x@y.zz"), (4, "jane at example dot com x@y.zz")]
    folder = table_dir(documents=documents(rows))
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in queries.op5_pii(spark, folder).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == (1, 1, 1, 0, 0, sha("email:0:5,ip:10:17"), "email:0:5,ip:10:17")
    assert got[1] == (2, 0, 0, 0, 0, sha(""), "") and got[2] == (3, 0, 0, 0, 0, sha(""), "")
    assert got[3] == got[4] == (4, 2, 0, 0, 0, sha("email:24:30"), "email:0:23,email:24:30")


def test_empty_table(spark, documents):
    assert pii.find(documents([(1, "a")]).limit(0)).collect() == []
