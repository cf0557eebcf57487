"""Queries on networks of features and on the scoring of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.scalars import pseudo_initial, score_to_reliability, sigmoid, weighted_sum
from spectrail.operators.graph import assigned_states, communities, connected_components, consistent_masses, consistent_pairs, edge_weights, edges_in_state, peer_support, top_neighbours
from spectrail.operators.masses import agreeing_annotations, competing_labels, component_masses, node_hypotheses, output_edges, propagate_in_components, prune_by_support, with_support
from spectrail.operators.intervals import Tolerance
from spectrail.operators.scoring import (
    LAYER, adduct_semantics, best_per_structure, best_rt_match, cap_ties, cluster_consensus, combine_scores, coverage_report, evaluate_predictions, filter_ms1,
    high_evidence, merge_sources, percentile_keep, rank_candidates, summarize, without_redundant_ms1,
)
from spectrail.session import table

# networks


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotate_masses_hypothesis").select("feature_id", "adduct", "feature_id_dest", "adduct_dest")


def _mass_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotate_masses_hypothesis").where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL").select("hypothesis_id", "feature_id", "feature_id_dest", "delta")


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer_support(_edges(spark, sf_dir))


def pair_consistency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_pairs(_edges(spark, sf_dir))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_edges(spark, sf_dir), "feature_id", "feature_id_dest")


def mass_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose mass agrees with both features' medians over all edges: the first round alone, as its SQL has it."""
    return consistent_masses(_mass_edges(spark, sf_dir), "delta", 0.0, 60.0, rounds=1).select("hypothesis_id")


def mass_consistency_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose mass agrees with both features' medians over the edges that are left, in as many rounds as the operator has."""
    return consistent_masses(_mass_edges(spark, sf_dir), "delta", 0.0, 60.0).select("hypothesis_id")


def mass_of_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = component_masses(_mass_edges(spark, sf_dir), "delta")
    return found.select("component", F.round("mass", 6).alias("mass"))


def best_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_neighbours(_mass_edges(spark, sf_dir).groupBy("feature_id", "feature_id_dest").agg(F.max("delta").alias("delta")), "feature_id", "feature_id_dest", "delta", 2)


def weights_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("s"), F.col("l_quantity").alias("m"), F.lit(50.0).alias("p"))
    return edge_weights(rows, "s", "m", "p").select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


def community_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by the weights of the edges, of the resolution with the best modularity."""
    edges = edge_weights(_mass_edges(spark, sf_dir).select("feature_id", "feature_id_dest", (1 / (1 + F.col("delta"))).alias("s"), F.lit(1.0).alias("m"), F.lit(1.0).alias("p")), "s", "m", "p")
    return communities(edges, "feature_id", "feature_id_dest", "weight")


def state_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that agree once each feature has one adduct."""
    rows = table(spark, sf_dir, "annotate_masses_hypothesis").select("hypothesis_id", "feature_id", "adduct", "feature_id_dest", "adduct_dest", (1 / (1 + F.col("delta"))).alias("weight"))
    return edges_in_state(rows, assigned_states(rows)).select("hypothesis_id", "feature_id", "feature_id_dest")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothesis per feature and adduct with its support, unsupported ones dropped beside supported ones."""
    rows = table(spark, sf_dir, "annotate_masses_hypothesis").where("feature_id IS NOT NULL AND adduct IS NOT NULL")
    pair = rows.select("feature_id", "adduct", F.col("delta").alias("mass"), F.lit("pair").alias("source"), F.lit(None).cast("long").alias("adduct_support"))
    multi = rows.where("adduct LIKE '[2M%'").select("feature_id", F.col("adduct_dest").alias("adduct"), F.col("delta").alias("mass"), F.lit("multi").alias("source"), F.lit(None).cast("long").alias("adduct_support")).where("adduct IS NOT NULL")
    found = with_support(node_hypotheses(pair, multi), _edges(spark, sf_dir))
    return prune_by_support(found).select("feature_id", "adduct", "mass", "source", "adduct_support")


def competing_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotate_masses_hypothesis").where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL AND adduct IS NOT NULL")
    clusters = rows.where("adduct LIKE '%Na%' OR adduct LIKE '%K%' OR adduct LIKE '%NH4%'").select("feature_id", "feature_id_dest", F.col("adduct").alias("label")).distinct()
    losses = rows.where("adduct LIKE '%-H2O%' OR adduct LIKE '%-H]%'").select("feature_id", "feature_id_dest", F.col("adduct").alias("label")).distinct()
    scores = peer_support(_edges(spark, sf_dir)).where("feature_id IS NOT NULL AND adduct IS NOT NULL").select("feature_id", F.col("adduct").alias("label"), F.col("adduct_support").alias("score"))
    return competing_labels(clusters, losses, scores).select("feature_id", "feature_id_dest", "label", "kind")


def edge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clean_chemo").where("feature_id IS NOT NULL").select("candidate_id", "feature_id", F.col("candidate_adduct").alias("adduct"), F.when(F.col("candidate_score_similarity") >= 0.9, "preassigned").otherwise("pair").alias("source"))
    edges = _edges(spark, sf_dir).where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL")
    return agreeing_annotations(rows, edges, ["preassigned"]).select("candidate_id")


def labelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL")
    pairs = edges.where("adduct IS NOT NULL AND adduct_dest IS NOT NULL").withColumn("label", F.concat_ws(" _ ", "adduct", "adduct_dest"))
    bare = edges.where("adduct IS NULL OR adduct_dest IS NULL").select("feature_id", "feature_id_dest")
    return output_edges([("pair", pairs), ("unknown", bare)], table(spark, sf_dir, "clean_chemo").where("feature_id IS NOT NULL"))


def clique_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of well-scored features for unannotated features of the same component and candidate error."""
    chemo = table(spark, sf_dir, "clean_chemo").where("feature_id IS NOT NULL")
    known = chemo.where("score_weighted_chemo >= 0.97").select("feature_id", F.col(LAYER).alias("structure"), F.col("candidate_structure_error_mz").alias("mass"))
    masses = chemo.select("feature_id", F.col("candidate_structure_error_mz").alias("mass")).distinct()
    parts = connected_components(_edges(spark, sf_dir), "feature_id", "feature_id_dest").select("feature_id", "component")
    return propagate_in_components(known, parts, masses, Tolerance(0.0, 0.005))


# scores


def _chemo(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("candidate_score_pseudo_initial", "score_weighted_chemo", "candidate_score_similarity", "candidate_structure_error_mz")]
    return table(spark, sf_dir, "clean_chemo").select("candidate_id", "feature_id", LAYER, "candidate_library", "candidate_adduct", *clean)


def _bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "weight_bio").where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL").groupBy("feature_id", LAYER).agg(F.max(F.when(~F.isnan("score_biological"), F.col("score_biological"))).alias("score_biological"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chemo(spark, sf_dir).join(_bio(spark, sf_dir), ["feature_id", LAYER], "left")
    return rows.withColumn("score_chemical", F.col("score_weighted_chemo"))


def weighted_sum_null_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = weighted_sum([F.col("score_biological"), F.col("score_weighted_chemo"), F.col("candidate_score_similarity")], [0.4, 0.2, 0.3])
    return _scored(spark, sf_dir).select("candidate_id", F.round(score, 6).alias("score"))


def sigmoid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(sigmoid(F.col("c_acctbal") / 100), 6).alias("score"))


def pseudo_initial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chemo(spark, sf_dir).select("candidate_id", pseudo_initial(F.col("candidate_score_similarity"), F.col("score_weighted_chemo")).alias("score"))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    chemo = _chemo(spark, sf_dir).where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL").groupBy("feature_id", LAYER).agg(F.max("score_weighted_chemo").alias("score_chemical"), F.max("candidate_score_similarity").alias("candidate_score_pseudo_initial"))
    found = combine_scores(_bio(spark, sf_dir), chemo)
    return found.select("feature_id", LAYER, F.round("score_final", 6).alias("score_final"))


def rank_min_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_candidates(_chemo(spark, sf_dir).where("feature_id IS NOT NULL"))
    return ranked.select("candidate_id", F.col("rank_initial").cast("long").alias("rank_initial"), F.col("rank_final").cast("long").alias("rank_final"))


def ranked_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_per_structure(_chemo(spark, sf_dir), "score_weighted_chemo", ["candidate_id"]).select("candidate_id")


def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank_candidates(_chemo(spark, sf_dir).where("feature_id IS NOT NULL"))
    return percentile_keep(rows, ["feature_id"], "score_weighted_chemo", 0.9).select("candidate_id")


def tie_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank_candidates(_chemo(spark, sf_dir).where("feature_id IS NOT NULL").withColumn("score_weighted_chemo", F.round("score_weighted_chemo", 1)))
    capped = cap_ties(rows, 7, [F.col("candidate_score_similarity").desc_nulls_last(), F.col("candidate_score_pseudo_initial").desc_nulls_last()], "candidate_id")
    return capped.select("candidate_id", "annotation_note")


def high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_evidence(_scored(spark, sf_dir).drop("candidate_score_pseudo_initial").withColumn("candidate_score_pseudo_initial", F.col("candidate_score_similarity"))).select("candidate_id")


def ms1_filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_ms1(_scored(spark, sf_dir), 0.6, 0.8, "OR").select("candidate_id")


def ms1_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_ms1(_scored(spark, sf_dir), 0.6, 0.8, "AND").select("candidate_id")


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank_candidates(_chemo(spark, sf_dir).where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL"))
    best = best_per_structure(rows, "score_weighted_chemo", ["candidate_id"])
    chemo = best.select(F.col("candidate_library").alias("component_id"), F.col("candidate_structure_error_mz").alias("mass"), "feature_id", F.col(LAYER).alias("structure"), "rank_final", F.col("score_weighted_chemo").alias("score"), F.col("candidate_score_similarity").isNotNull().alias("ms2"))
    return cluster_consensus(chemo, 1).select("feature_id", "structure", "anchor_structure", "promoted", F.col("rank_consensus").cast("long").alias("rank_consensus"))


def summarize_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank_candidates(_chemo(spark, sf_dir).where("feature_id IS NOT NULL"))
    one = summarize(rows, "feature_id", [F.col("rank_final").asc_nulls_last(), F.asc("candidate_id")], ["candidate_library", "candidate_adduct"], drop_ties="rank_final")
    return one.select("feature_id", "candidate_id", "candidate_library", "candidate_adduct")


def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chemo = _chemo(spark, sf_dir).where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL")
    spectral = chemo.where("candidate_score_similarity IS NOT NULL").select("feature_id", LAYER, "candidate_library", "candidate_score_similarity", F.col("candidate_adduct").alias("molecular_formula"))
    fingerprint = chemo.where("score_weighted_chemo IS NOT NULL").select("feature_id", LAYER, F.col("score_weighted_chemo").alias("candidate_score_sirius_csi"), F.col("candidate_adduct").alias("molecular_formula"))
    formula = chemo.select("feature_id", F.col("candidate_adduct").alias("molecular_formula"), F.col("candidate_structure_error_mz").alias("candidate_score_zodiac"))
    return merge_sources(spectral, fingerprint, formula)


def ms1_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    chemo = _chemo(spark, sf_dir)
    return without_redundant_ms1(chemo.where("candidate_score_similarity IS NULL"), chemo.where("candidate_score_similarity IS NOT NULL")).select("candidate_id")


def rt_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chemo(spark, sf_dir).withColumn("rt", F.col("candidate_structure_error_mz"))
    library = _bio(spark, sf_dir).select(LAYER, F.col("score_biological").alias("rt"))
    found = best_rt_match(rows, library, ["candidate_id"])
    return found.select("candidate_id", F.round("candidate_structure_error_rt", 6).alias("error_rt"))


def adduct_semantics_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chemo(spark, sf_dir).select("candidate_id", "feature_id", F.col("candidate_adduct").alias("state_key"), (F.col("candidate_structure_error_mz") + 100).alias("neutral_mass"))
    states = peer_support(_edges(spark, sf_dir)).where("adduct IS NOT NULL").select("feature_id", F.col("adduct").alias("state_key"), F.lit(100.0).alias("neutral_mass"), F.col("adduct_support").alias("support"))
    return adduct_semantics(rows, states, 0.0, 1.0).select("candidate_id", "adduct_match_mode")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chemo(spark, sf_dir).where("feature_id IS NOT NULL")
    return coverage_report(rows, "candidate_library", "feature_id", [F.col("score_weighted_chemo").desc_nulls_last(), F.asc("candidate_id")])


def benchmark_topk_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by score against the structure with the best biological score."""
    rows = rank_candidates(_chemo(spark, sf_dir).where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL"))
    predictions = rows.where("rank_final IS NOT NULL").select(F.col("feature_id").alias("query"), F.col(LAYER).alias("structure"), F.col("rank_final").alias("rank"))
    bio = _bio(spark, sf_dir)
    truth = bio.groupBy(F.col("feature_id").alias("query")).agg(F.max(F.when(F.col("score_biological") > 0.3, F.struct("score_biological", LAYER)))[LAYER].alias("structure"))
    found = evaluate_predictions(predictions, truth, [1, 3, 5])
    return found.select("k", "tp", "fp", "fn", "tn", F.round("hit_rate", 6).alias("hit_rate"), F.round("mcc", 6).alias("mcc"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chemo(spark, sf_dir).select("candidate_id", score_to_reliability(F.col("score_weighted_chemo")).alias("reliability"))


def annotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _chemo(spark, sf_dir).groupBy("candidate_library")
    return g.agg(F.count("*").alias("n"), F.countDistinct("feature_id").alias("n_features"), F.countDistinct(LAYER).alias("n_structures"), F.round(F.median("score_weighted_chemo"), 6).alias("median_score"), F.max("candidate_score_similarity").alias("best"), F.bool_or(F.col("candidate_score_similarity") > 0.95).alias("any_high"))


QUERIES = {
    "peer_support": support,
    "pair_consistency_filter": pair_consistency_filter,
    "connected_components": components,
    "mass_consistency": mass_consistency,
    "mass_consistency_stable": mass_consistency_stable,
    "component_masses": mass_of_components,
    "top_neighbours": best_neighbours,
    "edge_weights": weights_of_edges,
    "communities": community_detection,
    "state_assignment": state_assignment,
    "node_hypotheses": hypotheses,
    "competing_modifiers": competing_modifiers,
    "edge_agreement": edge_agreement,
    "labelled_edges": labelled_edges,
    "clique_propagation": clique_propagation,
    "weighted_sum_null_zero": weighted_sum_null_zero,
    "sigmoid_transform": sigmoid_transform,
    "pseudo_initial_score": pseudo_initial_score,
    "combine_scores": combined,
    "rank_min_dense": rank_min_dense,
    "ranked_structures": ranked_structures,
    "percentile_keep": percentile,
    "tie_cap": tie_cap,
    "high_evidence": high,
    "ms1_filter_or": ms1_filter_or,
    "ms1_filter_and": ms1_filter_and,
    "cluster_consensus": consensus,
    "summarize_one_row": summarize_one_row,
    "source_merge": source_merge,
    "ms1_redundancy": ms1_redundancy,
    "rt_best_match": rt_best_match,
    "adduct_semantics": adduct_semantics_filter,
    "coverage_report": coverage,
    "benchmark_topk_mcc": benchmark_topk_mcc,
    "reliability_levels": reliability,
    "annotation_stats": annotation_stats,
}

_E = "e AS (SELECT feature_id AS a, adduct AS x, feature_id_dest AS b, adduct_dest AS y FROM annotate_masses_hypothesis)"
_SUP = f"{_E}, sup AS (SELECT f, x, count(*) AS n FROM (SELECT DISTINCT a AS f, x, b AS o FROM e UNION SELECT b, y, a FROM e) GROUP BY 1, 2)"
_REACH = """v AS (SELECT a AS f FROM e WHERE a IS NOT NULL UNION SELECT b FROM e WHERE b IS NOT NULL),
d AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT f, f AS g FROM v UNION SELECT d.b, r.g FROM reach r JOIN d ON d.a = r.f WHERE r.g < d.b),
comp AS (SELECT f, min(g) AS c FROM reach GROUP BY f)"""
_M = "m AS (SELECT hypothesis_id, feature_id AS a, feature_id_dest AS b, delta FROM annotate_masses_hypothesis WHERE feature_id IS NOT NULL AND feature_id_dest IS NOT NULL AND delta IS NOT NULL)"


def _nan(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}"


_C = f"c AS (SELECT candidate_id, feature_id, {LAYER} AS l, candidate_library, candidate_adduct, {_nan('candidate_score_pseudo_initial')}, {_nan('score_weighted_chemo')}, {_nan('candidate_score_similarity')}, {_nan('candidate_structure_error_mz')} FROM clean_chemo)"
_B = f"b AS (SELECT feature_id, {LAYER} AS l, max(score_biological) FILTER (NOT isnan(score_biological)) AS bio FROM weight_bio WHERE feature_id IS NOT NULL AND {LAYER} IS NOT NULL GROUP BY 1, 2)"
_S = f"{_C}, {_B}, s AS (SELECT c.*, bio, score_weighted_chemo AS chem FROM c LEFT JOIN b USING (feature_id, l))"
_R = f"""{_C}, r AS (SELECT *, CASE WHEN score_weighted_chemo IS NOT NULL THEN rank() OVER (PARTITION BY feature_id ORDER BY greatest(score_weighted_chemo, 0) DESC NULLS LAST) END AS rank_final,
  CASE WHEN candidate_score_pseudo_initial IS NOT NULL THEN dense_rank() OVER (PARTITION BY feature_id ORDER BY greatest(candidate_score_pseudo_initial, 0) DESC NULLS LAST) END AS rank_initial FROM c WHERE feature_id IS NOT NULL)"""

SQL = {
    "peer_support": f"WITH {_SUP} SELECT f AS feature_id, x AS adduct, n AS adduct_support FROM sup",
    "pair_consistency_filter": f"""WITH {_SUP}, deg AS (SELECT a, count(*) AS n FROM (SELECT a, b FROM e UNION SELECT b, a FROM e) GROUP BY 1), h AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2)
SELECT DISTINCT e.a AS feature_id, e.x AS adduct, e.y AS adduct_dest, e.b AS feature_id_dest FROM e
JOIN h ON e.a IS NOT DISTINCT FROM h.a AND e.b IS NOT DISTINCT FROM h.b
JOIN sup s ON e.a IS NOT DISTINCT FROM s.f AND e.x IS NOT DISTINCT FROM s.x JOIN sup t ON e.b IS NOT DISTINCT FROM t.f AND e.y IS NOT DISTINCT FROM t.x
JOIN deg p ON e.a IS NOT DISTINCT FROM p.a JOIN deg q ON e.b IS NOT DISTINCT FROM q.a
WHERE NOT (h.n > 1 OR p.n >= 3 OR q.n >= 3) OR s.n >= 2 OR t.n >= 2""",
    "connected_components": f"WITH RECURSIVE {_E}, {_REACH} SELECT f AS feature_id, c AS component FROM comp",
    "mass_consistency": f"""WITH {_M}, med AS (SELECT f, quantile_cont(delta, 0.5) AS v FROM (SELECT a AS f, delta FROM m UNION ALL SELECT b, delta FROM m) GROUP BY f)
SELECT hypothesis_id FROM m JOIN med p ON m.a = p.f JOIN med q ON m.b = q.f WHERE abs(delta - p.v) <= 60 AND abs(delta - q.v) <= 60""",
    "component_masses": f"WITH RECURSIVE {_E}, {_REACH}, {_M} SELECT c AS component, round(quantile_cont(delta, 0.5), 6) AS mass FROM m JOIN comp ON m.a = comp.f GROUP BY c",
    "top_neighbours": "WITH g AS (SELECT feature_id, feature_id_dest, max(delta) AS delta FROM annotate_masses_hypothesis WHERE feature_id IS NOT NULL AND feature_id_dest IS NOT NULL GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY delta DESC NULLS LAST, feature_id_dest) <= 2",
    "edge_weights": "WITH w AS (SELECT l_orderkey, l_linenumber, pow(l_discount * l_quantity / 50.0, 2) AS r FROM lineitem), e AS (SELECT min(r) AS lo, max(r) AS hi FROM w) SELECT l_orderkey, l_linenumber, round(0.01 + 0.99 * (r - lo) / (hi - lo), 6) AS weight FROM w, e",
    "node_hypotheses": f"""WITH {_SUP}, h AS (SELECT a AS f, x, delta AS mass, 'pair' AS source, 1 AS o FROM (SELECT e.*, delta FROM (SELECT feature_id AS a, adduct AS x, feature_id_dest AS b, adduct_dest AS y, delta FROM annotate_masses_hypothesis) e) WHERE a IS NOT NULL AND x IS NOT NULL
  UNION ALL SELECT feature_id, adduct_dest, delta, 'multi', 2 FROM annotate_masses_hypothesis WHERE feature_id IS NOT NULL AND adduct LIKE '[2M%' AND adduct_dest IS NOT NULL),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY f, x ORDER BY o, mass NULLS LAST) = 1),
j AS (SELECT o.f, o.x, mass, source, coalesce(n, 0) AS n FROM o LEFT JOIN sup ON o.f = sup.f AND o.x = sup.x),
k AS (SELECT *, max(CAST(n > 0 AS INT)) OVER (PARTITION BY f) AS s, max(CAST(source <> 'multi' AS INT)) OVER (PARTITION BY f) AS t FROM j)
SELECT f AS feature_id, x AS adduct, mass, source, n AS adduct_support FROM k WHERE (s = 0 OR n > 0) AND (t = 0 OR source <> 'multi')""",
    "competing_modifiers": f"""WITH {_SUP}, u AS (SELECT DISTINCT a, b, x AS label, 'cluster' AS kind FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND (x LIKE '%Na%' OR x LIKE '%K%' OR x LIKE '%NH4%')
  UNION ALL SELECT DISTINCT a, b, x, 'loss' FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND (x LIKE '%-H2O%' OR x LIKE '%-H]%'))
SELECT a AS feature_id, b AS feature_id_dest, label, kind FROM u LEFT JOIN sup ON u.a = sup.f AND u.label = sup.x QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC NULLS LAST, kind DESC, label) = 1""",
    "edge_agreement": f"""WITH {_E}, k AS (SELECT * FROM e WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT a AS f, x FROM k UNION SELECT b, y FROM k)
SELECT candidate_id FROM clean_chemo c WHERE feature_id IS NOT NULL AND (candidate_score_similarity >= 0.9 AND NOT isnan(candidate_score_similarity) OR EXISTS (SELECT 1 FROM n WHERE f = feature_id AND x = candidate_adduct) OR NOT EXISTS (SELECT 1 FROM n WHERE f = feature_id))""",
    "labelled_edges": f"""WITH {_E}, k AS (SELECT DISTINCT a, b, CASE WHEN x IS NULL OR y IS NULL THEN 'unknown' ELSE x || ' _ ' || y END AS label FROM e WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT a AS feature_source, b AS feature_target, label FROM k UNION ALL SELECT DISTINCT feature_id, feature_id, NULL FROM clean_chemo WHERE feature_id IS NOT NULL AND feature_id NOT IN (SELECT a FROM k UNION SELECT b FROM k)""",
    "weighted_sum_null_zero": f"WITH {_S} SELECT candidate_id, round((coalesce(bio, 0) * 0.4 + coalesce(score_weighted_chemo, 0) * 0.2 + coalesce(candidate_score_similarity, 0) * 0.3) / 0.9, 6) AS score FROM s",
    "sigmoid_transform": "SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal / 100 + 100) / 20)), 6) AS score FROM customer",
    "pseudo_initial_score": f"WITH {_C} SELECT candidate_id, coalesce((candidate_score_similarity + score_weighted_chemo) / 2, candidate_score_similarity, score_weighted_chemo) AS score FROM c",
    "combine_scores": f"""WITH {_C}, {_B}, g AS (SELECT feature_id, l, max(score_weighted_chemo) AS chem, max(candidate_score_similarity) AS sim FROM c WHERE feature_id IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2)
SELECT feature_id, l AS {LAYER}, round((coalesce(bio, 0) * 0.4 + coalesce(chem, 0) * 0.2 + coalesce(sim, 0) * 0.3) / 0.9, 6) AS score_final FROM b JOIN g USING (feature_id, l)""",
    "rank_min_dense": f"WITH {_R} SELECT candidate_id, rank_initial, rank_final FROM r",
    "ranked_structures": f"WITH {_C} SELECT candidate_id FROM c QUALIFY row_number() OVER (PARTITION BY feature_id, l ORDER BY score_weighted_chemo DESC NULLS LAST, candidate_id) = 1",
    "percentile_keep": f"WITH {_R} SELECT candidate_id FROM r QUALIFY score_weighted_chemo >= 0.9 * max(score_weighted_chemo) OVER (PARTITION BY feature_id) OR rank_final = 1",
    "tie_cap": f"""WITH {_C}, q AS (SELECT * REPLACE (round(score_weighted_chemo, 1) AS score_weighted_chemo) FROM c WHERE feature_id IS NOT NULL),
r AS (SELECT *, CASE WHEN score_weighted_chemo IS NOT NULL THEN rank() OVER (PARTITION BY feature_id ORDER BY greatest(score_weighted_chemo, 0) DESC NULLS LAST) END AS k FROM q),
n AS (SELECT *, count(*) OVER (PARTITION BY feature_id, candidate_adduct, k) AS size, row_number() OVER (PARTITION BY feature_id, candidate_adduct, k ORDER BY candidate_score_similarity DESC NULLS LAST, candidate_score_pseudo_initial DESC NULLS LAST, candidate_id) AS i FROM r)
SELECT candidate_id, CASE WHEN size > 7 THEN 'Sampled 7 of ' || size || ' tied candidates' END AS annotation_note FROM n WHERE i <= 7""",
    "high_evidence": f"WITH {_S} SELECT candidate_id FROM s WHERE (bio >= 0.8 OR candidate_score_similarity >= 0.9 OR score_weighted_chemo >= 0.75) AND (candidate_score_similarity IS NULL OR candidate_score_similarity >= 0.4)",
    "ms1_filter_or": f"WITH {_S} SELECT candidate_id FROM s WHERE candidate_score_similarity IS NOT NULL OR bio >= 0.6 OR chem >= 0.8",
    "ms1_filter_and": f"WITH {_S} SELECT candidate_id FROM s WHERE candidate_score_similarity IS NOT NULL OR (bio >= 0.6 AND chem >= 0.8)",
    "cluster_consensus": f"""WITH {_R}, o AS (SELECT * FROM r WHERE l IS NOT NULL), p AS (SELECT *, CASE WHEN score_weighted_chemo IS NOT NULL THEN rank() OVER (PARTITION BY feature_id ORDER BY greatest(score_weighted_chemo, 0) DESC NULLS LAST) END AS k FROM o),
q AS (SELECT candidate_library AS g, round_even(candidate_structure_error_mz, 1) AS m, feature_id, l, k, score_weighted_chemo AS s, candidate_score_similarity IS NOT NULL AS ms2 FROM p QUALIFY row_number() OVER (PARTITION BY feature_id, l ORDER BY score_weighted_chemo DESC NULLS LAST, candidate_id) = 1),
a AS (SELECT g, m, l AS al, feature_id AS af FROM q WHERE k = 1 AND g IS NOT NULL AND m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, m ORDER BY ms2 DESC, s DESC NULLS LAST, feature_id, l) = 1),
j AS (SELECT q.*, al, coalesce(q.l = al AND q.feature_id <> af AND NOT bool_or(ms2) OVER (PARTITION BY q.feature_id), false) AS promoted FROM q LEFT JOIN a ON q.g = a.g AND q.m = a.m)
SELECT feature_id, l AS structure, al AS anchor_structure, promoted, row_number() OVER (PARTITION BY feature_id ORDER BY promoted DESC, k NULLS LAST, l) AS rank_consensus FROM j""",
    "summarize_one_row": f"""WITH {_R}, t AS (SELECT feature_id FROM r WHERE rank_final = 1 GROUP BY 1 HAVING count(*) > 1), u AS (SELECT * FROM r WHERE feature_id NOT IN (SELECT feature_id FROM t))
SELECT feature_id, arg_min(candidate_id, (coalesce(rank_final, 1000000000), candidate_id)) AS candidate_id, string_agg(DISTINCT trim(candidate_library), ' $ ' ORDER BY trim(candidate_library)) AS candidate_library,
  string_agg(DISTINCT trim(candidate_adduct), ' $ ' ORDER BY trim(candidate_adduct)) AS candidate_adduct FROM u GROUP BY 1""",
    "source_merge": f"""WITH {_C}, k AS (SELECT * FROM c WHERE feature_id IS NOT NULL AND l IS NOT NULL),
a AS (SELECT feature_id, l, candidate_library, candidate_score_similarity, candidate_adduct AS mf FROM k WHERE candidate_score_similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_id, l ORDER BY candidate_score_similarity DESC, candidate_library NULLS LAST, candidate_adduct NULLS LAST) = 1),
b AS (SELECT feature_id, l, score_weighted_chemo AS csi, candidate_adduct AS mf FROM k WHERE score_weighted_chemo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_id, l ORDER BY score_weighted_chemo DESC, candidate_adduct NULLS LAST) = 1),
j AS (SELECT feature_id, l, candidate_library, candidate_score_similarity, csi, coalesce(a.mf, b.mf) AS mf FROM a FULL JOIN b USING (feature_id, l)),
z AS (SELECT feature_id, candidate_adduct AS mf, max(candidate_structure_error_mz) AS zod FROM k GROUP BY 1, 2)
SELECT j.feature_id, l AS {LAYER}, candidate_library, candidate_score_similarity, csi AS candidate_score_sirius_csi, j.mf AS molecular_formula, zod AS candidate_score_zodiac FROM j LEFT JOIN z ON j.feature_id = z.feature_id AND j.mf = z.mf""",
    "ms1_redundancy": f"WITH {_C} SELECT candidate_id FROM c WHERE candidate_score_similarity IS NOT NULL OR NOT EXISTS (SELECT 1 FROM c d WHERE d.candidate_score_similarity >= 0.3 AND d.feature_id = c.feature_id AND d.l = c.l)",
    "rt_best_match": f"""WITH {_C}, {_B}, t AS (SELECT DISTINCT l, bio AS t FROM b WHERE bio IS NOT NULL), j AS (SELECT c.*, t, candidate_structure_error_mz - t AS e FROM c LEFT JOIN t USING (l))
SELECT candidate_id, round(e, 6) AS error_rt FROM j QUALIFY row_number() OVER (PARTITION BY feature_id, l, candidate_library ORDER BY abs(e) NULLS LAST, t NULLS LAST, candidate_id) = 1""",
    "adduct_semantics": f"""WITH {_SUP}, {_C}, s AS (SELECT f, x FROM sup WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, x) = 1),
j AS (SELECT candidate_id, CASE WHEN x IS NULL THEN 'precursor_mz' WHEN candidate_adduct = x THEN 'exact_adduct' WHEN abs(candidate_structure_error_mz + 100 - 100.0) <= 1 THEN 'm_delta_rescued' END AS adduct_match_mode FROM c LEFT JOIN s ON c.feature_id = s.f) SELECT * FROM j WHERE adduct_match_mode IS NOT NULL""",
    "coverage_report": f"""WITH {_C}, k AS (SELECT * FROM c WHERE feature_id IS NOT NULL), t AS (SELECT count(DISTINCT feature_id) AS n FROM k), a AS (SELECT candidate_library AS x, count(DISTINCT feature_id) AS n_any FROM k GROUP BY 1),
o AS (SELECT candidate_library AS x FROM k QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY score_weighted_chemo DESC NULLS LAST, candidate_id) = 1), b AS (SELECT x, count(*) AS best FROM o GROUP BY 1)
SELECT a.x AS class, n_any AS "any", coalesce(best, 0) AS best, round(100 * n_any / n, 1) AS any_percent, round(100 * coalesce(best, 0) / n, 1) AS best_percent FROM a LEFT JOIN b ON a.x IS NOT DISTINCT FROM b.x, t""",
    "benchmark_topk_mcc": f"""WITH {_C}, {_B}, p AS (SELECT feature_id AS q, l, rank() OVER (PARTITION BY feature_id ORDER BY greatest(score_weighted_chemo, 0) DESC) AS k FROM c WHERE feature_id IS NOT NULL AND l IS NOT NULL AND score_weighted_chemo IS NOT NULL),
t AS (SELECT feature_id AS q, arg_max(l, (bio, l)) FILTER (bio > 0.3) AS s FROM b GROUP BY 1), j AS (SELECT t.q, t.s, min(k) AS top, min(k) FILTER (l = s) AS own FROM t LEFT JOIN p USING (q) GROUP BY 1, 2),
x AS (SELECT k, s IS NOT NULL AS known, coalesce(own <= k, false) AS hit, coalesce(top <= k, false) AS got FROM j, (VALUES (1), (3), (5)) g(k)),
y AS (SELECT k, CAST(count(*) FILTER (known AND hit) AS BIGINT) AS tp, CAST(count(*) FILTER (got AND NOT (hit AND known)) AS BIGINT) AS fp, CAST(count(*) FILTER (known AND NOT got) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT known AND NOT got) AS BIGINT) AS tn, count(*) FILTER (known) AS m FROM x GROUP BY k)
SELECT k, tp, fp, fn, tn, round(tp / m, 6) AS hit_rate, round(CASE WHEN sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM y""",
    "reliability_levels": f"WITH {_C} SELECT candidate_id, CASE WHEN score_weighted_chemo >= 1 THEN '1' WHEN score_weighted_chemo >= 0.75 THEN '2' WHEN score_weighted_chemo >= 0.5 THEN '3' ELSE '4' END AS reliability FROM c",
    "annotation_stats": f"""WITH {_C} SELECT candidate_library, count(*) AS n, count(DISTINCT feature_id) AS n_features, count(DISTINCT l) AS n_structures, round(quantile_cont(score_weighted_chemo, 0.5), 6) AS median_score, max(candidate_score_similarity) AS best, bool_or(candidate_score_similarity > 0.95) AS any_high FROM c GROUP BY 1""",
}
_ROUNDS = ", ".join(
    f"""d{k} AS MATERIALIZED (SELECT f, quantile_cont(delta, 0.5) AS v FROM (SELECT a AS f, delta FROM m{k - 1} UNION ALL SELECT b, delta FROM m{k - 1}) GROUP BY f),
m{k} AS MATERIALIZED (SELECT m.* FROM m{k - 1} m JOIN d{k} p ON m.a = p.f JOIN d{k} q ON m.b = q.f WHERE abs(delta - p.v) <= 60 AND abs(delta - q.v) <= 60)"""
    for k in range(1, 11)
)
SQL["mass_consistency_stable"] = f"WITH {_M}, m0 AS MATERIALIZED (SELECT * FROM m), {_ROUNDS} SELECT hypothesis_id FROM m10"
SQL["clique_propagation"] = f"""WITH RECURSIVE {_E}, {_REACH}, k AS (SELECT feature_id, {LAYER} AS s, candidate_structure_error_mz AS m FROM clean_chemo WHERE feature_id IS NOT NULL AND score_weighted_chemo >= 0.97),
known AS (SELECT DISTINCT c, s, m FROM k JOIN comp ON k.feature_id = comp.f),
o AS (SELECT DISTINCT x.feature_id, candidate_structure_error_mz AS m, c FROM clean_chemo x JOIN comp ON x.feature_id = comp.f WHERE x.feature_id NOT IN (SELECT feature_id FROM k))
SELECT DISTINCT o.feature_id, known.s AS structure, o.m AS mass FROM o JOIN known USING (c) WHERE abs(o.m - known.m) <= 0.005"""
