"""Copies by formatting, linked groups, survivorship, ranking and top items, against brute force."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spectrail.llm.components import in_cells, linked_groups, union_find
from spectrail.llm.duplicates import canonical_text, collapse_formatting, find_copies
from spectrail.llm.rank_fusion import order_statistic, rank_items, undisputed_firsts
from spectrail.llm.survivorship import surviving_values
from spectrail.llm.top_items import top_items

NAMES = "name_id long, key string, name string, clash string"


def _names():
    forms = ["9-oxo-Alpha", "9 oxo alpha", "９-OXO–alpha", "b | a", "a$B;", "a;b;a", "é", "e", "é", "", " ", "-;-", None, "x" * 5_000, "X" * 5_000]
    rng = random.Random(1)
    return [(i, rng.choice(["K1", "K1", "K1", "K2", None]), rng.choice(forms), "c") for i in range(300)]


def test_canonical_text():
    assert canonical_text("a$B;") == canonical_text("b | a") == canonical_text("a;b;a")
    assert canonical_text("é") == canonical_text("é") != canonical_text("e")
    assert canonical_text(" - ; . ") == "" and canonical_text("９-OXO") == "9oxo"


def test_copies_equal_brute_force(spark):
    data = _names()
    first, want = {}, []
    for i, key, name, _ in data:
        if key and name and (c := canonical_text(name)):
            if (key, c) in first:
                want.append((first[key, c], i))
            else:
                first[key, c] = i
    for hot in (3, 10_000):
        got = find_copies(spark.createDataFrame(data, NAMES), "key", "name", "name_id", hot_rows=hot)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    groups = collapse_formatting(spark.createDataFrame(data, NAMES), "key", "name", "name_id").collect()
    assert sum(r.n_copies for r in groups) == len(want) + len(first) and {r.first_id for r in groups} == set(first.values())
    assert find_copies(spark.createDataFrame([], NAMES), "key", "name", "name_id").count() == 0


def test_union_find():
    assert union_find([("c", "b"), ("a", "c"), ("x", "y")]) == {"c": "a", "b": "a", "a": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize("cell_edges", [3, 40, 10_000])
def test_linked_groups(spark, cell_edges):
    rng = random.Random(2)
    pairs = [(f"{rng.randrange(150):03}", f"{rng.randrange(150):03}") for _ in range(90)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)]
    pairs += [("solo", None), (None, "other"), ("self", "self"), (None, None), ("", "zz")] + pairs[:10]
    roots = union_find((a, b) for a, b in pairs if a is not None and b is not None)
    want = {x: roots.get(x, x) for p in pairs for x in p if x is not None}
    got = linked_groups(spark.createDataFrame([(*p, "x") for p in pairs], "a string, b string, v string"), "a", "b", cell_edges=cell_edges)
    assert {r.member: r.group_id for r in got.collect()} == want and got.count() == len(want)


def test_a_long_ascending_chain_takes_few_rounds(spark):
    """100,000 edges along ascending names, in more than 100 cells."""
    n, watch = 100_000, []
    chain = spark.range(n).select(F.format_string("n%07d", "id").alias("a"), F.format_string("n%07d", F.col("id") + 1).alias("b"))
    cells = in_cells(chain, n, 1_000).groupBy("row", "column", "part").count()
    got = linked_groups(chain, "a", "b", cell_edges=1_000, watch=watch)
    assert got.select("group_id").distinct().collect() == [("n0000000",)] and got.count() == n + 1
    assert cells.count() >= 100 and len(watch) <= 12 and all(y < 0.75 * x for x, y in zip(watch, watch[1:], strict=False))


def test_a_hub_is_spread_over_cells(spark):
    """A third of 60,000 edges have one end in common; no cell holds twice its share."""
    n = 60_000
    edges = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.format_string("x%06d", F.col("id") % 9_000)).alias("a"), F.format_string("y%06d", "id").alias("b"))
    cells = in_cells(edges, n, 500).groupBy("row", "column", "part").count()
    assert cells.agg(F.max("count")).first()[0] <= 1_000 and cells.agg(F.sum("count")).first()[0] == n
    got = linked_groups(edges, "a", "b", cell_edges=500, hot_rows=1_000)
    assert got.where("group_id = 'hub'").count() == n // 3 + 1 and got.count() == n + 1 + 6_000


def test_linked_groups_of_nothing(spark):
    assert linked_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_survivorship(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [
        (1, "k", "good", t1, float("nan"), " n/a "), (2, "k", "bad", t2, 1.0, "x"), (3, "k", "good", t1, None, "-"), (4, "k", "bad", t2, 2.0, "y"), (5, "k", "unlisted", t2, 9.0, "z"),
        (6, "one", "good", t1, 1.0, "x"), (7, "nil", "good", t1, None, None), (8, "nil", None, None, None, "unknown"), (9, None, "good", t1, 1.0, "x"), (10, None, "good", t1, 1.0, "x"),
    ]
    df = spark.createDataFrame(rows, "id long, key string, library string, at timestamp_ntz, logp double, name string")
    trust = spark.createDataFrame([("good", 1), ("bad", 2)], "library string, trust_rank int")
    got = {r.key: r for r in surviving_values(df, F.col("key"), "id", "at", "library", trust, ["logp", "name"]).collect()}
    assert set(got) == {"k", "nil"}
    assert (got["k"]["logp"], got["k"]["logp__from"], got["k"]["name"], got["k"]["name__from"], got["k"]["n_records"]) == (1.0, 2, "x", 2, 5)
    assert (got["nil"]["logp__from"], got["nil"]["name__from"], got["nil"]["name"]) == (-1, -1, None)
    assert surviving_values(df.limit(0), F.col("key"), "id", "at", "library", trust.limit(0), ["logp"]).count() == 0


def _items(seed, n):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), *[rng.randrange(6) * 1.0] * 4])
    return [("hot" if i % 3 else f"g{i % 5}", f"i{i}", value(), value() if rng.random() < 0.9 else 1e6, value()) for i in range(n)]


ITEMS, SCORES = "g string, item string, a double, b double, c double", ["a", "b", "c"]


def test_undisputed_firsts_equal_brute_force(spark):
    found = 0
    for seed in range(6):
        data = _items(seed, 60) + [("win", "w", 9.0, 9.0, None), ("win", "v", 1.0, 2.0, 9.0), ("single", "s", 1.0, 1.0, 1.0)]
        low = lambda v: float("-inf") if v is None or v != v else v
        want = []
        for g, i, *s in data:
            others = [o for h, j, *o in data if h == g and j != i]
            if others and all(sum(low(x) > low(y) for x, y in zip(s, o, strict=True)) >= 2 for o in others):
                want.append((g, i))
        df = spark.createDataFrame(data, ITEMS)
        for hot in (8, 10_000) if seed < 2 else (10_000,):
            assert sorted(map(tuple, undisputed_firsts(df, SCORES, hot).collect())) == sorted(want)
        found += len(want)
    assert found >= 6
    assert undisputed_firsts(spark.createDataFrame([], ITEMS), SCORES).count() == 0


def test_ranking_is_the_same_for_hot_groups(spark, rows):
    df = spark.createDataFrame(_items(3, 90), ITEMS)
    columns = ("g", "item", "rho", "rank")
    assert rows(rank_items(df, SCORES, 8)[0], *columns) == rows(rank_items(df, SCORES, 10_000)[0], *columns)


def test_no_score_dominates(spark):
    df = spark.createDataFrame([("g", "steady", 0.9, 0.9, 10.0), ("g", "loud", 0.1, 0.2, 1e9), ("g", "low", 0.2, 0.1, 5.0), ("g", "mid", 0.5, 0.4, 7.0)], ITEMS)
    assert [r.item for r in rank_items(df, SCORES)[0].orderBy("rank").collect()][0] == "steady"


def test_order_statistics(spark):
    row = spark.range(1).select(*[order_statistic(F.lit(0.3), k, 3) for k in (1, 2, 3)]).first()
    assert list(row) == pytest.approx([1 - 0.7**3, 3 * 0.09 - 2 * 0.027, 0.027])


@pytest.mark.parametrize("hot", [4, 20, 10_000])
def test_top_items(spark, hot):
    rng = random.Random(4)
    data = [(rng.choice(["h", "h", "h", "a", "b", None]), rng.choice([None, float("nan"), float("inf"), *[rng.randrange(4) * 1.0] * 6]), i, "x") for i in range(400)]
    best: dict = {}
    for g, s, i, _ in sorted((x for x in data if x[0] is not None and x[1] is not None and x[1] == x[1]), key=lambda x: (-x[1], x[2])):
        best.setdefault(g, []).append(i)
    df = spark.createDataFrame(data, "g string, s double, i long, position string")
    got = sorted((r.g, r.i) for r in top_items(df, "g", "s", "i", 5, hot_rows=hot).collect())
    assert got == sorted((g, i) for g, ids in best.items() for i in ids[:5])
    assert top_items(df.limit(0), "g", "s", "i", 5).count() == 0
