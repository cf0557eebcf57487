"""Core operators: small hand-made cases, and brute force where the plan is not the plain one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from spectrail.functions.scalars import chemont_id, collapse_names, pseudo_initial, reliability_to_score, sigmoid, weighted_sum
from spectrail.functions.special import incomplete_beta
from spectrail.operators.features import intensity_columns, normalize_rt, top_samples
from spectrail.operators.graph import assigned_states, communities, connected_components, consistent_pairs, edges_in_state, peer_support, pruned_communities
from spectrail.operators.intervals import Tolerance, gap_cluster, nearest_join, range_join
from spectrail.operators.keys import conform, first_row, null_safe_join
from spectrail.operators.scoring import cap_ties, cluster_consensus, filter_ms1, high_evidence, rank_candidates
from spectrail.operators.skew import counts_above, hot_keys, salted_join


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("ab"), rng.uniform(0, 50)) for i in range(200)] + [(999, "a", None)]
    ranges = [(j, rng.choice("ab"), lo := rng.uniform(0, 50), lo + rng.uniform(-1, 6)) for j in range(80)]
    p, r = spark.createDataFrame(points, "i int, s string, v double"), spark.createDataFrame(ranges, "j int, s string, lo double, hi double")
    for width in (0.5, 7.0):
        got = sorted((x.i, x.j) for x in range_join(p, r, "v", "lo", "hi", width, ["s"]).collect())
        assert got == sorted((i, j) for i, s, v in points for j, t, lo, hi in ranges if s == t and v is not None and lo <= v <= hi)
        semi = sorted(x.i for x in range_join(p, r, "v", "lo", "hi", width, ["s"], "left_semi").collect())
        assert semi == sorted({i for i, _ in got})


def test_nearest_join_prefers_lower_of_equals(spark):
    rng = random.Random(2)
    targets = [rng.randrange(0, 60) + 0.5 for _ in range(12)] + [200.0, None]
    points = [(i, rng.randrange(0, 80) * 1.0) for i in range(60)] + [(900, None), (901, -50.0), (902, 500.0)]
    known = [t for t in targets if t is not None]
    for few, hot in ((100, 50), (0, 50), (0, 3)):
        got = {r.i: r.nearest for r in nearest_join(spark.createDataFrame(points, "i int, v double"), spark.createDataFrame([(t,) for t in targets], "t double"), "v", "t", 4.0, few=few, hot_rows=hot).collect()}
        assert got == {i: None if v is None else min(known, key=lambda t: (abs(t - v), t)) for i, v in points}
    far = {r.i: r.nearest for r in nearest_join(spark.createDataFrame(points, "i int, v double"), spark.createDataFrame([(-9e5,), (9e5,)], "t double"), "v", "t", 0.01, few=0).collect()}
    assert far == {i: None if v is None else (-9e5 if v <= 0 else 9e5) for i, v in points}
    keyed = [(i, "ab"[i % 2], v) for i, v in points]
    own = spark.createDataFrame([("ab"[k % 2], t) for k, t in enumerate(known)], "s string, t double")
    got = {r.i: r.nearest for r in nearest_join(spark.createDataFrame(keyed, "i int, s string, v double"), own, "v", "t", 4.0, on=["s"], hot_rows=3).collect()}
    assert got == {i: None if v is None else min((t for k, t in enumerate(known) if "ab"[k % 2] == s), key=lambda t: (abs(t - v), t)) for i, s, v in keyed}
    none = nearest_join(spark.createDataFrame(points[:2], "i int, v double"), spark.createDataFrame([], "t double"), "v", "t")
    assert [r.nearest for r in none.collect()] == [None, None]


def test_gap_cluster_and_null_axis(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.5), (3, "a", 9.0), (4, "a", None), (5, "b", 2.0)], "i int, s string, t double")
    assert {r.i: r.cluster for r in gap_cluster(df, ["s"], "t", 1.0, ["i"]).collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1}


def test_null_safe_join_and_first_row(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "i int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    assert rows(null_safe_join(a, b, ["k"]), "i", "v") == [(1, 10), (2, 20), (3, None)]
    twice = spark.createDataFrame([(None, 2), (None, 1), ("x", 3)], "k string, v int")
    assert rows(first_row(twice, ["k"], [F.asc("v")])) == rows(spark.createDataFrame([(None, 1), ("x", 3)], "k string, v int"))


def test_conform_casts_and_fills(spark):
    schema = StructType([StructField("b", DoubleType()), StructField("a", LongType()), StructField("c", StringType())])
    got = conform(spark.createDataFrame([("7", "x"), ("q", "1.5")], "a string, b string"), schema)
    assert got.schema == schema and [tuple(r) for r in got.collect()] == [(None, 7, None), (1.5, None, None)]


def test_salted_join_with_hot_keys(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 5)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        assert rows(salted_join(left, right, ["k"], hot, F.col("i"), how), "i", "k", "v") == rows(left.join(right, "k", how), "i", "k", "v")


def test_counts_above_is_the_same_for_hot_keys(spark, rows):
    rng = random.Random(4)
    values = spark.createDataFrame([(k, float(v), rng.randrange(1, 9)) for k in "ab" for v in rng.sample(range(500), 200)], "g string, v double, n long")
    none, all_ = values.select("g").limit(0), values.select("g").distinct()
    assert rows(counts_above(values, ["g"], "v", "n", none)) == rows(counts_above(values, ["g"], "v", "n", all_))


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)] + [("n001", None), ("zz", "zz")]
    parent = {x: x for e in edges for x in e if x}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    for few in (0, 5, 1_000):
        got = {r.feature_id: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b", few).collect()}
        assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([("a", None), (None, None)], "a string, b string"), "a", "b").collect() == [("a", "a")]


def test_a_chain_of_names_in_order_is_one_component(spark):
    chain = spark.range(5_000).select(F.format_string("n%05d", "id").alias("a"), F.format_string("n%05d", F.col("id") + 1).alias("b"))
    assert connected_components(chain, "a", "b", 100).select("component").distinct().collect() == [("n00000",)]


def test_support_and_consistency(spark, rows):
    e = spark.createDataFrame([("1", "H", "2", "Na"), ("1", "H", "3", "K"), ("1", "NH4", "2", "H")], "feature_id string, adduct string, feature_id_dest string, adduct_dest string")
    assert ("1", "H", 2) in rows(peer_support(e))
    assert rows(consistent_pairs(e), "feature_id", "adduct", "adduct_dest") == [("1", "H", "K"), ("1", "H", "Na")]


def test_states_agree_as_far_as_they_can(spark):
    rng = random.Random(8)
    edges = [(f"f{rng.randrange(8)}", rng.choice("HNK"), f"f{rng.randrange(8)}", rng.choice("HNK"), float(rng.randrange(1, 5))) for _ in range(40)] + [("f0", None, "f1", "H", 1.0)]
    df = spark.createDataFrame(edges, "feature_id string, adduct string, feature_id_dest string, adduct_dest string, weight double")
    state = {r.feature: r.state for r in assigned_states(df).collect()}
    full = [e for e in edges if e[1] and e[0] != e[2]]

    def score(s, n):
        mine = [(a, m, b, w) for x, a, m, b, w in full if x == n] + [(b, x, a, w) for x, a, m, b, w in full if m == n]
        return sum(w * (a == s and state[m] == b) + 0.01 * (a == s) for a, m, b, w in mine)

    for n in state:
        assert score(state[n], n) >= max(score(s, n) for s in "HNK") - 1e-6
    kept = edges_in_state(df, assigned_states(df)).collect()
    assert all(state[r.feature_id] == r.adduct and state[r.feature_id_dest] == r.adduct_dest for r in kept)


def test_stable_mass_consistency_equals_brute_force(spark, rows, tmp_path):
    from statistics import median

    from spectrail.catalog import collect

    rng = random.Random(9)
    data = [(i, f"f{rng.randrange(25)}", "H", f"f{rng.randrange(25)}", float(1 + rng.randrange(200))) for i in range(90)] + [(900, None, "H", "f1", 5.0), (901, "f1", "H", "f2", None)]
    spark.createDataFrame(data, "hypothesis_id long, feature_id string, adduct string, feature_id_dest string, delta double").write.parquet(f"{tmp_path}/annotate_masses_hypothesis.parquet")
    left = [e for e in data if e[1] and e[4] is not None]
    sizes = [len(left)]
    for _ in range(10):
        held: dict = {}
        for _, a, _, b, d in left:
            held.setdefault(a, []).append(d)
            held.setdefault(b, []).append(d)
        left = [e for e in left if abs(e[4] - median(held[e[1]])) <= 60 and abs(e[4] - median(held[e[3]])) <= 60]
        sizes.append(len(left))
    queries = collect()[0]
    assert sizes[-1] == sizes[-2] < sizes[2] < sizes[1]
    assert rows(queries["mass_consistency_stable"](spark, str(tmp_path))) == sorted(((e[0],) for e in left), key=repr)
    assert queries["mass_consistency"](spark, str(tmp_path)).count() == sizes[1]


def test_communities_split_cliques_and_keep_isolated(spark, rows):
    pairs = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1), ("lone", "lone", 1.0), ("a", None, 1.0), ("b", "a", None)]
    df = spark.createDataFrame(pairs, "s string, t string, w double")
    found = {r.feature_id: (r.component, r.community) for r in communities(df, "s", "t", "w", resolutions=(0.4, 1.0)).collect()}
    assert found == {**dict.fromkeys("abcd", ("a", "a")), **dict.fromkeys("wxyz", ("a", "w")), "lone": ("lone", "lone")}
    assert communities(df.limit(0), "s", "t", "w").count() == 0
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.2), ("c", "d", 0.4), ("d", "w", 1.0), ("w", "x", 0.01)], "feature_source string, feature_target string, weight double")
    members = spark.createDataFrame([(k, v[1]) for k, v in found.items()], "feature_id string, community string")
    assert rows(pruned_communities(edges, members, "weight"), "feature_source", "feature_target") == [("a", "b")]


def test_communities_have_good_modularity(spark):
    """On planted groups the modularity is near that of the planted ones."""
    rng = random.Random(11)
    group = {f"n{i:03}": i % 4 for i in range(48)}
    names = sorted(group)
    pairs = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.5 if group[a] == group[b] else 0.02)}
    found = {r.feature_id: r.community for r in communities(spark.createDataFrame([(*p, 1.0) for p in sorted(pairs)], "s string, t string, w double"), "s", "t", "w", resolutions=(0.5, 1.0), rounds=4).collect()}

    def quality(of):
        degree = {n: sum(n in p for p in pairs) for n in names}
        return sum(of[a] == of[b] for a, b in pairs) / len(pairs) - sum((sum(d for n, d in degree.items() if of[n] == c) / (2 * len(pairs))) ** 2 for c in set(of.values()))

    assert quality(found) >= 0.93 * quality(group)


def test_rt_units(spark):
    seconds = spark.createDataFrame([(30.0,), (600.0,), (None,)], "rt double")
    assert [r.rt for r in normalize_rt(seconds, "rt").collect()] == [0.5, 10.0, None]
    assert [r.rt for r in normalize_rt(spark.createDataFrame([(0.5,), (12.0,)], "rt double"), "rt").collect()] == [0.5, 12.0]


def test_intensities(spark, rows):
    assert intensity_columns(["id", "a Peak area", "a Peak height"]) == {"a Peak area": "a"}
    wide = spark.createDataFrame([(1, 5.0, 5.0, 0.0), (2, None, 1.0, 3.0)], "id int, a double, b double, c double")
    assert rows(top_samples(wide, ["id"], ["a", "b", "c"], 1), "id", "sample") == [(1, "a"), (2, "c")]


def test_scores(spark):
    df = spark.createDataFrame([(0.5, None, 0.2)], "a double, b double, c double")
    got = df.select(weighted_sum([F.col("a"), F.col("b")], [0.4, 0.2]), pseudo_initial(F.col("a"), F.col("b")), pseudo_initial(F.col("a"), F.col("c")), sigmoid(F.lit(-100.0))).first()
    assert got[0] == pytest.approx(0.2 / 0.6) and got[1] == 0.5 and got[2] == pytest.approx(0.35) and got[3] == 0.5


def test_text_functions(spark):
    df = spark.createDataFrame([("CHEMONTID:57", "2"), (None, "0.9")], "a string, b string")
    assert [tuple(r) for r in df.select(chemont_id(F.col("a")), reliability_to_score(F.col("b"))).collect()] == [("CHEMONTID:0000057", 0.75), (None, 0.9)]
    names = spark.createDataFrame([("B",), ("a",), ("A",), (None,), (" ",)], "n string")
    assert names.agg(collapse_names(F.col("n"))).first()[0] == "A $ B"


def test_incomplete_beta():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)


def test_ranks_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "f", 0.9, 1.0), (2, "f", 0.9, 2.0), (3, "f", -1.0, None), (4, "f", None, 0.5), (5, "f", float("nan"), 0.5)], "candidate_id int, feature_id string, score_weighted_chemo double, candidate_score_pseudo_initial double")
    got = {r.candidate_id: (r.rank_final, r.rank_initial) for r in rank_candidates(df).collect()}
    assert got[1] == (1, 2) and got[2] == (1, 1) and got[3] == (3, None) and got[4] == (None, 3)


def test_filters(spark):
    base = "candidate_id int, score_biological double, score_chemical double, candidate_score_similarity double, candidate_score_pseudo_initial double, score_weighted_chemo double"
    df = spark.createDataFrame([(1, 0.9, None, None, None, None), (2, None, 0.9, None, None, 0.8), (3, None, None, 0.1, None, 0.9), (4, 0.1, 0.1, None, None, None)], base)
    assert sorted(r[0] for r in filter_ms1(df, 0.5, 0.5, "OR").collect()) == [1, 2, 3]
    assert sorted(r[0] for r in filter_ms1(df, 0.5, 0.5, "AND").collect()) == [3]
    assert sorted(r[0] for r in high_evidence(df).collect()) == [1, 2]


def test_tie_cap_notes(spark):
    df = spark.createDataFrame([(i, "f", "[M+H]+", 1, float(i)) for i in range(10)], "candidate_id int, feature_id string, candidate_adduct string, rank_final int, s double")
    got = cap_ties(df, 7, [F.desc("s")], "candidate_id").collect()
    assert sorted(r.candidate_id for r in got) == list(range(3, 10)) and {r.annotation_note for r in got} == {"Sampled 7 of 10 tied candidates"}


def test_consensus_promotes_anchor(spark):
    rows = [("c", 100.00001, "f1", "S", 1, 0.9, True), ("c", 100.00002, "f2", "T", 1, 0.8, False), ("c", 100.00002, "f2", "S", 2, 0.5, False)]
    df = spark.createDataFrame(rows, "component_id string, mass double, feature_id string, structure string, rank_final int, score double, ms2 boolean")
    got = {(r.feature_id, r.structure): (r.promoted, r.rank_consensus) for r in cluster_consensus(df).collect()}
    assert got == {("f1", "S"): (False, 1), ("f2", "S"): (True, 1), ("f2", "T"): (False, 2)}


def test_tolerance_modes(spark):
    df = spark.createDataFrame([(100.0, 100.004)], "a double, b double")
    holds = lambda mode: df.select(Tolerance(10.0, 0.005, mode).holds(F.col("a"), F.col("b"))).first()[0]
    assert [holds(m) for m in ("max", "and", "sum")] == [True, False, True]
