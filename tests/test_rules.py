"""Single rules on hand-made rows: percentages, similarity, risk, scores."""

from __future__ import annotations

from decimal import Decimal

import pytest
from oracle_tools import rows_of
from pyspark.sql import functions as F

from catalens.functions.numeric import mean_milli, pct
from catalens.operators import duplicates as dup
from catalens.operators.confidence import confidence, scored
from catalens.operators.evidence import Evidence, observe
from catalens.operators.identifiers import join_rows
from catalens.plans import reports
from catalens.plans.kpis import CONFIDENCE


@pytest.mark.parametrize(
    ("num", "den", "expected"),
    [
        (0, 0, None),
        (1, 0, None),
        (1, None, None),
        (None, 4, None),
        (1, 3, 33.33),
        (2, 3, 66.67),
        (1, 32, 3.13),  # 3.125 exactly: away from zero
        (-1, 32, -3.13),
        (1, -32, -3.13),
        (5, 4, 125.0),
        (0, 7, 0.0),
        (10**15, 3 * 10**15, 33.33),
    ],
)
def test_pct(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "num bigint, den bigint")
    assert df.select(pct("num", "den")).first()[0] == expected


def test_pct_of_fractions(spark):
    df = spark.sql("select 0.5 as num, cast(1.5 as decimal(3,1)) as den")
    assert df.select(pct("num", "den")).first()[0] == 33.33


def test_mean_milli(spark):
    df = spark.createDataFrame([(1001, 2), (1, 0)], "s bigint, n bigint")
    assert [r[0] for r in df.select(mean_milli("s", "n")).collect()] == [0.501, None]


PAIRS = [
    ("Song", "SONG", 2, "Exact Match", "Same Artist"),
    ("Song", "My song (live)", 2, "Partial Match", "Similar Artist"),
    ("My song (live)", "Song", 2, "Partial Match", "Similar Artist"),
    ("Song", "Tune", 2, "Different Names", "Different Artists"),
    ("", "Tune", 2, "Partial Match", "Similar Artist"),
    (None, "Tune", 2, "Different Names", "Different Artists"),
    (None, None, 2, "Different Names", "Different Artists"),
    # Pattern characters are plain text.
    ("100%", "100 hits", 2, "Different Names", "Different Artists"),
    ("a_b", "axb", 2, "Different Names", "Different Artists"),
    ("back\\slash", "my back\\slash", 2, "Partial Match", "Similar Artist"),
    ("Song", "Song", 3, "Multiple Duplicates", "Multiple Artists"),
]


def test_text_similarity(spark):
    df = spark.createDataFrame([p[:3] for p in PAIRS], "a string, b string, size bigint")
    a, b, size = F.col("a"), F.col("b"), F.col("size")
    got = df.select(
        dup.name_similarity(a, b, size), dup.credit_similarity(a, b, size)
    ).collect()
    assert [tuple(r) for r in got] == [p[3:] for p in PAIRS]


def test_length_similarity(spark):
    cases = [
        (10000, 15000, 2, "Similar Length"),
        (10000, 15001, 2, "Different Length"),
        (15001, 10000, 2, "Different Length"),
        (None, 10000, 2, "Unknown Length"),
        (10000, None, 2, "Unknown Length"),
        (None, None, 3, "Multiple Lengths"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "a bigint, b bigint, size bigint")
    got = df.select(dup.length_similarity(F.col("a"), F.col("b"), F.col("size"))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]


def test_every_risk_score(spark):
    """Each subset of the four agreements, and its level."""
    base = ("n", "c", 1000, "x")
    other = ("other", "else", 9000, "y")
    rows, expected = [], []
    for subset in range(16):
        agree = [bool(subset & bit) for bit in (1, 2, 4, 8)]
        rows.append((base, tuple(p if same else q for p, q, same in zip(base, other, agree)), 2))
        expected.append(sum(w for w, same in zip((40, 30, 20, 10), agree) if same))
    rows.append((base, base, 3))
    expected.append(50)
    rows.append(((None,) * 4, (None,) * 4, 2))
    expected.append(0)
    rows.append((("n", "c", 1, ""), ("m", "d", 9000, ""), 2))
    expected.append(10)
    entry = "struct<name: string, credit: string, length: bigint, comment: string>"
    df = spark.createDataFrame(rows, f"a {entry}, b {entry}, size bigint")
    score = dup.risk_score(F.col("a"), F.col("b"), F.col("size"))
    got = df.select(score.alias("score"), dup.risk_level(score).alias("level")).collect()
    assert [r.score for r in got] == expected
    for r in got:
        level = "High Risk" if r.score >= 80 else "Medium Risk" if r.score >= 50 else "Low Risk"
        assert r.level == level


def test_join_rows_of_a_heavy_artist(spark):
    """The product outgrows a bigint long before the counts do."""
    df = spark.createDataFrame([(2, 0, 3), (1, 1, 10**7)], "a bigint, b bigint, c bigint")
    got = df.selectExpr(f"{join_rows({'a': 1, 'b': 1, 'c': 3})} as n").collect()
    assert [r.n for r in got] == [54, Decimal(10**21)]


@pytest.mark.parametrize("entity", list(CONFIDENCE))
def test_confidence_of_every_flag_combination(spark, entity):
    rules = CONFIDENCE[entity]
    names = list(rules.flags)
    rows = [tuple(i >> b & 1 for b in range(len(names))) for i in range(2 ** len(names))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    total = Decimal(0)
    for r in rows_of(scored(df, rules)):
        score = sum(Decimal(w) * r[name] for name, w in rules.weights.items())
        total += score
        if all(r[n] for n in names):
            phase1 = "High"
        elif any(all(r[n] for n in combo) for combo in rules.medium):
            phase1 = "Medium"
        else:
            phase1 = "Low"
        assert r["phase1_confidence_level"] == phase1
        assert r["phase2_confidence_score"] == score
        phase2 = "High" if score >= Decimal("0.8") else "Medium" if score >= Decimal("0.4") else "Low"
        assert r["phase2_confidence_level"] == phase2
    (summary,) = rows_of(confidence(df, rules))
    assert summary[f"total_{rules.entities}"] == len(rows)
    assert summary["average_phase2_score"] == float(total / len(rows))
    assert summary["overall_confidence_level"] == "Medium Confidence"
    for column in rules.counted.values():
        assert summary[column] == len(rows) // 2


def test_confidence_of_nothing(spark):
    rules = CONFIDENCE["artist"]
    df = spark.createDataFrame([], ", ".join(f"{n} int" for n in rules.flags))
    (row,) = rows_of(confidence(df, rules))
    assert row["total_artists"] == 0 and row["phase1_high_count"] == 0
    assert row["phase1_high_pct"] is None and row["average_phase2_score"] is None
    assert row["overall_confidence_level"] == "Low Confidence"


def test_overall_level_uses_the_exact_mean(spark):
    """A mean just under 0.4 rounds to 0.400 and is still Low."""
    rules = CONFIDENCE["artist"]
    names = list(rules.flags)
    medium, lower = (0, 1, 0, 1), (0, 0, 1, 0)
    df = spark.createDataFrame([medium] * 2999 + [lower], ", ".join(f"{n} int" for n in names))
    (row,) = rows_of(confidence(df, rules))
    assert row["average_phase2_score"] == 0.4
    assert row["overall_confidence_level"] == "Low Confidence"


def test_observe(spark):
    people = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id bigint, area int")
    links = spark.createDataFrame(
        [(1, "a"), (1, None), (2, None), (9, "x"), (None, "z")], "who bigint, code string"
    )
    linked = Evidence(
        links, "who", {"linked": None, "coded": "code is not null"}, counts={"n": "1"}
    )
    got = observe(people, [linked], flags={"north": "area > 6"}, carry=["area"])
    rows = {r["id"]: r for r in rows_of(got)}
    assert set(rows) == {1, 2, 3}
    assert rows[1] == {"id": 1, "north": 0, "linked": 1, "coded": 1, "n": 2, "area": 5}
    assert rows[2] == {"id": 2, "north": 0, "linked": 1, "coded": 0, "n": 1, "area": None}
    assert rows[3] == {"id": 3, "north": 1, "linked": 0, "coded": 0, "n": 0, "area": 9}



def test_score_histogram_bins(spark):
    scores = ["0.0", "0.199", "0.2", "0.399", "0.4", "0.6", "0.799", "0.8", "1.0"]
    df = spark.createDataFrame([(Decimal(s),) for s in scores], "phase2_confidence_score decimal(4,3)")
    got = {r["score_range"]: r["count"] for r in rows_of(reports.score_histogram(df))}
    assert got == {
        "0.0-0.2 (Low)": 2,
        "0.2-0.4": 2,
        "0.4-0.6 (Medium)": 1,
        "0.6-0.8": 2,
        "0.8-1.0 (High)": 2,
    }
