"""Orphan references against brute force, with hot keys, nulls, ties and empty tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spectrail.operators.orphans import References, find_orphans, orphan_report, tidy_key

CHILD, PARENT = "id long, key string, t timestamp_ntz, clash string", "key string, since timestamp_ntz, until timestamp_ntz, clash string"


def _data(seed, n):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    when = lambda: start + timedelta(hours=rng.randrange(24 * 60))
    key = lambda: rng.choice(["hot"] * 5 + [f"k{rng.randrange(9)}", None])
    child = [(i, key(), None if rng.random() < 0.03 else when(), "x") for i in range(n)]
    parent = []
    for _ in range(n // 8):
        a = None if rng.random() < 0.05 else when()
        parent.append((key(), a, None if a is None or rng.random() < 0.4 else a + timedelta(hours=rng.randrange(-5, 200)), "y"))
    return child, parent


def _brute(child, parent):
    return sorted(i for i, k, t, _ in child if k is not None and not any(k == p and a is not None and t is not None and a <= t and (u is None or u > t) for p, a, u, _ in parent))


def test_orphans_equal_brute_force_on_hot_and_cold_ways(spark):
    child, parent = _data(1, 400)
    for hot in (10, 10_000):
        found, _ = find_orphans(References("c", spark.createDataFrame(child, CHILD)), spark.createDataFrame(parent, PARENT), hot_rows=hot)
        assert sorted(r.child_id for r in found.collect()) == _brute(child, parent)


def test_report_counts_what_is_found(spark):
    child, parent = _data(2, 300)
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parent, PARENT)
    report = {r.period: (r.n_refs, r.n_orphans) for r in orphan_report(References("c", c), p, hot_rows=20).collect()}
    found = find_orphans(References("c", c), p)[0].groupBy("period").count().collect()
    assert {r.period: r["count"] for r in found} == {k: v[1] for k, v in report.items() if v[1]}
    assert sum(v[0] for v in report.values()) == sum(k is not None for _, k, _, _ in child)


def test_moments_of_opening_and_closing(spark):
    t = datetime(2024, 5, 1, 12)
    child = [(1, "a", t, ""), (2, "a", t + timedelta(hours=1), ""), (3, "a", t - timedelta(seconds=1), "")]
    parent = [("a", t, t + timedelta(hours=1), "")]
    found, _ = find_orphans(References("c", spark.createDataFrame(child, CHILD)), spark.createDataFrame(parent, PARENT))
    assert sorted(r.child_id for r in found.collect()) == [2, 3]


def test_empty_tables(spark):
    child, parent = _data(3, 20)
    none = spark.createDataFrame([], PARENT)
    assert find_orphans(References("c", spark.createDataFrame([], CHILD)), none)[0].count() == 0
    assert find_orphans(References("c", spark.createDataFrame(child, CHILD)), none)[0].count() == sum(k is not None for _, k, _, _ in child)


def test_tidy_key(spark):
    got = spark.createDataFrame([("\t abc-d  ",), (None,), ("",)], "k string").select(tidy_key(F.col("k"))).collect()
    assert [r[0] for r in got] == ["ABC-D", None, ""]
