"""Operators against brute force, with one key holding a large part of the rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lamina.operators.cells import hiding, share_within
from lamina.operators.rules import Rule, judge, kept, rejects
from lamina.operators.versions import latest_version, superseded_versions
from lamina.operators.windows import pairs_within, presence_by_day, returns_within

from conftest import day, rows

START = datetime(2026, 1, 1)


def stays(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        who = "hot" if rng.random() < 0.4 else f"p{rng.randrange(40)}"
        begin = START + timedelta(minutes=rng.randrange(400 * 1440), microseconds=rng.randrange(5))
        end = None if rng.random() < 0.15 else begin + timedelta(minutes=rng.randrange(20 * 1440))
        out.append((f"s{i}", who, begin, end, rng.random() < 0.2))
    # Exactly 30 days later, and one microsecond more.
    for i, gap in enumerate((timedelta(0), timedelta(microseconds=1))):
        out.append((f"x{i}a", f"edge{i}", START, START + timedelta(days=1), False))
        out.append((f"x{i}b", f"edge{i}", START + timedelta(days=31) + gap, None, False))
    # Back the very minute of the discharge: not a return.
    out.append(("y_a", "same", START, START + timedelta(days=1), False))
    out.append(("y_b", "same", START + timedelta(days=1), None, False))
    return out


SCHEMA = "stay_id string, who string, a timestamp_ntz, d timestamp_ntz, dead boolean"


def test_returns_within_matches_brute_force(spark):
    data = stays()
    expected = {
        s: int(d is not None and any(w2 == w and s2 != s and d < a2 <= d + timedelta(days=30) for s2, w2, a2, _, _ in data))
        for s, w, a, d, _ in data
    }
    df = returns_within(spark.createDataFrame(data, SCHEMA), "who", "a", "d", 30, "back")
    got = {r.stay_id: r.back for r in df.collect()}
    assert got == expected and len(got) == len(data)
    assert got["x0a"] == 1 and got["x1a"] == 0 and got["y_a"] == 0
    assert 0 < sum(got.values()) < len(got)


def test_returns_within_plans_no_pairs(spark):
    df = returns_within(spark.createDataFrame(stays(), SCHEMA), "who", "a", "d", 30)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pairs_within_matches_brute_force(spark):
    data = stays(seed=2)
    delays, marked = [], 0
    for s, w, _, d, dead in data:
        for s2, w2, a2, _, _ in data:
            if d is not None and w2 == w and a2 > d and (a2.date() - d.date()).days <= 30:
                delays.append((a2.date() - d.date()).days)
                marked += dead
    got = pairs_within(spark.createDataFrame(data, SCHEMA), "who", "a", "d", 30, F.col("dead")).first()
    assert tuple(got) == (len(delays), marked, min(delays), max(delays))


def test_pairs_within_on_nothing(spark):
    got = pairs_within(spark.createDataFrame([], SCHEMA), "who", "a", "d", 30, F.col("dead")).first()
    assert tuple(got) == (0, 0, None, None)


def test_presence_matches_day_by_day(spark):
    rng = random.Random(3)
    data = []
    for _ in range(300):
        group = "hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}"
        first = day("1-1") + timedelta(days=rng.randrange(60))
        last = None if rng.random() < 0.2 else first + timedelta(days=rng.randrange(30))
        data.append((group, first, last))
    data.append(("alone", day("1-3"), day("1-3")))
    horizon = max(first for _, first, _ in data)
    present, arrived, left = Counter(), Counter(), Counter()
    for group, first, last in data:
        at, stop = first, min(last or horizon, horizon)
        while at <= stop:
            present[group, at] += 1
            arrived[group, at] += at == first
            left[group, at] += at == last
            at += timedelta(days=1)
    df = presence_by_day(spark.createDataFrame(data, "g string, a date, b date"), "g", "a", "b")
    assert rows(df) == sorted(
        ((g, j, n, arrived[g, j], left[g, j]) for (g, j), n in present.items()), key=lambda r: tuple(map(str, r))
    )
    assert max(j for _, j in present) == horizon


def test_latest_version_keeps_nulls_and_is_total(spark):
    data = [("k", 1, "old"), ("k", 2, None), ("t", 5, "a"), ("t", 5, "b")]
    df = latest_version(spark.createDataFrame(data, "k string, v int, x string"), ["k"], ["v", "x"])
    assert rows(df) == [("k", 2, None), ("t", 5, "b")]


def test_latest_version_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = latest_version(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_superseded_versions_count_copies(spark):
    data = [("k", 1, "old")] * 3 + [("k", 2, "new")] * 2 + [("one", 1, "x")]
    df = spark.createDataFrame(data, "k string, v int, x string")
    assert rows(superseded_versions(df, ["k"], ["v", "x"])) == [("k", 1, "old", 3), ("k", 2, "new", 1)]
    assert latest_version(df, ["k"], ["v", "x"]).count() + 4 == len(data)


def test_rules_are_ordered_and_exclusive(spark):
    data = [(1, 5), (2, None), (3, -1), (4, 50)]
    df = spark.createDataFrame(data, "i int, v int").selectExpr("*", "DATE'2026-08-01' AS _jour_depot", "'f' AS _fichier_source")
    rules = [
        Rule("negatif", F.col("v") < 0, F.lit("v < 0")),
        Rule("petit", F.col("v") < 10, F.concat(F.lit("v="), F.col("v"))),
    ]
    judged = judge(df, rules)
    assert rows(kept(judged), "i") == [(2,), (4,)]
    assert rows(rejects(judged, "src", F.col("i").cast("string")), "cle", "motif", "action", "detail") == [
        ("1", "petit", "ecarte", "v=5"), ("3", "negatif", "ecarte", "v < 0"),
    ]


def test_shares_sum_to_a_hundred(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 7)], "g string, n bigint")
    assert rows(share_within(df, "g", "n", "p")) == [("a", 1, 25.0), ("a", 3, 75.0), ("b", 7, 100.0)]


def test_k_profile_classes(spark):
    data = [("x",)] * 5 + [("y",)] * 4 + [("z",)]
    got = hiding(spark.createDataFrame(data, "q string"), [F.col("q")])
    assert rows(got) == [(10, 3, 1, 1, 5, 50.0)]
    assert rows(hiding(spark.createDataFrame([], "q string"), [F.col("q")])) == [(0, 0, None, 0, 0, 0.0)]
