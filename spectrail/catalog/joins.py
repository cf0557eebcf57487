"""Queries on range, nearest and null-safe joins, feature preparation and gap clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.scalars import collapse_sorted
from spectrail.operators.features import covariance_edges, feature_pairs, intensity_vectors, normalize_rt, numeric_like_columns, sample_taxa, top_samples
from spectrail.operators.intervals import Tolerance, gap_cluster, linked_to_next, nearest_join, range_join
from spectrail.operators.keys import first_row, join_new_columns, natural_join, union_all
from spectrail.operators.masses import delta_edges, has_library_mass, library_matches
from spectrail.operators.scoring import match_anchors
from spectrail.operators.spectra import reduce_library
from spectrail.session import table


def _event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features: users are samples, minutes of time are retention times, values masses."""
    events = table(spark, sf_dir, "events")
    minutes = F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000
    return events.select(F.col("event_id").alias("feature_id"), F.col("user_id").alias("sample"), minutes.alias("rt"), F.col("value").alias("mz"))


_EVENTS = "SELECT event_id AS feature_id, user_id AS sample, epoch_us(ts) / 60000000 AS rt, value AS mz FROM events"


def feature_pairs_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = feature_pairs(_event_features(spark, sf_dir), 240.0, 10.0)
    return pairs.select("feature_id", "feature_id_dest", "delta", "delta_min", "delta_max")


def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_cluster(_event_features(spark, sf_dir), ["sample"], "rt", 600.0, ["feature_id"]).select("feature_id", "sample", F.col("cluster").cast("long").alias("cluster"))


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_to_next(_event_features(spark, sf_dir), ["sample"], "rt", "mz", "feature_id", Tolerance(0.0, 5.0))


_MASSES = "SELECT DISTINCT structure_exact_mass AS m FROM structures_metadata WHERE structure_exact_mass > 0"
_PAIRS = "SELECT pair_id, structure_exact_mass AS mass FROM structure_organism_pairs WHERE structure_exact_mass > 0"


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "structures_metadata").select(F.col("structure_exact_mass").alias("exact_mass"))


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "structure_organism_pairs").select("pair_id", F.col("structure_exact_mass").alias("mass")).where("mass > 0")


def library_mass_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library_matches(_masses(spark, sf_dir), _library(spark, sf_dir), 20.0, 0.008)
    return found.select("pair_id", "mass", "exact_mass", F.round("error_mz", 6).alias("error_mz"))


def mass_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return has_library_mass(_masses(spark, sf_dir), "mass", _library(spark, sf_dir), Tolerance(3.0, 0.0005))


def nearest_library_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_join(_masses(spark, sf_dir), _library(spark, sf_dir), "mass", "exact_mass", 1.0)


def precursor_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "structures_metadata").select("metadata_id", F.col("structure_exact_mass").alias("precursor_mz")).where("precursor_mz > 0")
    queries = _masses(spark, sf_dir).select(F.col("mass").alias("precursor_mz"))
    return reduce_library(library, queries, Tolerance(5.0, 0.002))


def two_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed features in both the time and the mass window of an expected one (shifted copies of the purchases)."""
    seen = _event_features(spark, sf_dir)
    expected = seen.join(table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("feature_id")), "feature_id", "left_semi")
    expected = expected.select(F.col("feature_id").alias("expected_id"), "sample", (F.col("rt") - 120).alias("rt_min"), (F.col("rt") + 120).alias("rt_max"), (F.col("mz") - 10).alias("mz_min"), (F.col("mz") + 10).alias("mz_max"))
    met = range_join(seen, expected, "rt", "rt_min", "rt_max", 240.0, ["sample"])
    return met.where((F.col("mz") >= F.col("mz_min")) & (F.col("mz") <= F.col("mz_max"))).select("expected_id", "feature_id")


#: Mass differences of common ions.
DELTAS = [(17.0265, "NH3"), (18.0106, "H2O"), (21.9819, "Na-H"), (37.9559, "K-H"), (43.9898, "CO2"), (46.0055, "CH2O2"), (132.0423, "pentose"), (162.0528, "hexose")]


def delta_edge_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = spark.createDataFrame(DELTAS, "distance double, label string")
    pairs = table(spark, sf_dir, "annotate_masses_hypothesis").select("hypothesis_id", (F.col("delta") - 0.05).alias("delta_min"), (F.col("delta") + 0.05).alias("delta_max"))
    return delta_edges(pairs, deltas).select("hypothesis_id", "label")


def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clean_chemo").select("candidate_id", "feature_id", F.col("candidate_structure_inchikey_connectivity_layer").alias("structure"), F.col("candidate_structure_error_mz").alias("mass"), F.col("candidate_score_similarity").alias("rt"), "score_weighted_chemo")
    anchors = rows.where("score_weighted_chemo >= 0.98")
    return match_anchors(rows, anchors, 0.5, 0.15).select("candidate_id")


def feature_top_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "clean_chemo").select("candidate_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("candidate_score_pseudo_initial", "score_weighted_chemo", "candidate_score_similarity")])
    top = top_samples(wide, ["candidate_id"], ["candidate_score_pseudo_initial", "score_weighted_chemo", "candidate_score_similarity"], 2)
    return top.select("candidate_id", "sample", "intensity", F.col("rank").cast("long").alias("rank"))


def intensity_vectors_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_discount") > 0, F.col("l_quantity")))
    return intensity_vectors(items, "l_orderkey", "l_linenumber", "v")


def rt_unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rt = normalize_rt(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("rt")), "rt")
    return rt.select("event_id", F.round("rt", 6).alias("rt"))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated pairs of brands over the nations that bought them."""
    items, parts, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    joined = items.join(parts, items.l_partkey == parts.p_partkey).join(orders, items.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    long = joined.groupBy(F.col("p_brand").alias("feature_id"), F.col("c_nationkey").alias("sample")).agg(F.sum("l_quantity").alias("intensity"))
    brands = parts.select(F.col("p_brand").alias("feature_id")).distinct()
    pairs = brands.join(F.broadcast(brands.withColumnRenamed("feature_id", "feature_id_dest")), F.col("feature_id") < F.col("feature_id_dest"))
    r = covariance_edges(long, pairs, p_below=None)
    return r.select("feature_id", "feature_id_dest", F.col("n").cast("long").alias("n"), F.round("correlation", 6).alias("correlation"))


def covariance_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of feature scores over libraries that are unlikely to be chance."""
    chemo = table(spark, sf_dir, "clean_chemo").where("feature_id IS NOT NULL")
    long = chemo.groupBy(F.col("candidate_adduct").alias("feature_id"), F.col("candidate_library").alias("sample")).agg(F.count("*").cast("double").alias("intensity"))
    names = long.select("feature_id").where("feature_id IS NOT NULL").distinct()
    pairs = names.join(F.broadcast(names.withColumnRenamed("feature_id", "feature_id_dest")), F.col("feature_id") < F.col("feature_id_dest"))
    return covariance_edges(long, pairs, p_below=0.05).select("feature_id", "feature_id_dest", F.col("n").cast("long").alias("n"), F.round("correlation", 6).alias("correlation"))


def null_safe_natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = table(spark, sf_dir, "taxonomy").select("taxonomy_id", "organism_taxonomy_08genus", "organism_taxonomy_06family").distinct()
    ref = table(spark, sf_dir, "taxonomy").groupBy("organism_taxonomy_08genus", "organism_taxonomy_06family").agg(F.count("*").alias("n"))
    return natural_join(tax, ref)


def new_columns_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "clean_chemo").select("candidate_id", "feature_id", "candidate_structure_inchikey_connectivity_layer").where("feature_id IS NOT NULL")
    right = table(spark, sf_dir, "weight_bio").where("feature_id IS NOT NULL").groupBy("feature_id", "candidate_structure_inchikey_connectivity_layer").agg(F.max(F.when(~F.isnan("score_biological"), F.col("score_biological"))).alias("score_biological"))
    return join_new_columns(left, right, ["feature_id"], ["candidate_structure_inchikey_connectivity_layer"])


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return first_row(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    both = union_all(customers, suppliers)
    return both.groupBy("nation", "segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


def sample_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bio = table(spark, sf_dir, "weight_bio").where("sample_organism_name IS NOT NULL")
    cells = bio.groupBy(F.col("feature_id").alias("sample")).agg(F.array_join(F.array_sort(F.collect_set("sample_organism_name")), "|").alias("organisms"))
    reference = table(spark, sf_dir, "organism_reference").select("organism_name", F.col("organism_taxonomy_06family").alias("family"), F.col("organism_taxonomy_08genus").alias("genus"))
    features = cells.select(F.col("sample").alias("feature_id"), "sample").where("sample IS NOT NULL")
    return sample_taxa(features, cells.where("sample IS NOT NULL"), reference, "organisms")


def column_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the order table that hold numbers."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey")
    found = numeric_like_columns(orders, orders.columns)
    return spark.createDataFrame([(c,) for c in found], "column_name string")


def collapse_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "structures_stereo").groupBy("library").agg(collapse_sorted(F.col("structure_tag")).alias("tags"))


QUERIES = {
    "feature_pairs_in_window": feature_pairs_in_window,
    "delta_edge_match": delta_edge_match,
    "library_mass_match": library_mass_match,
    "mass_existence": mass_existence,
    "nearest_library_mass": nearest_library_mass,
    "precursor_reduction": precursor_reduction,
    "two_window_join": two_window_join,
    "anchor_match": anchor_match,
    "gap_clusters": gap_clusters,
    "evidence_links": evidence_links,
    "feature_top_samples": feature_top_samples,
    "intensity_vectors": intensity_vectors_of_orders,
    "rt_unit_normalize": rt_unit_normalize,
    "covariance_edges": covariance,
    "covariance_significant": covariance_significant,
    "null_safe_natural_join": null_safe_natural_join,
    "new_columns_join": new_columns_join,
    "keep_first": keep_first,
    "union_by_name": union_by_name,
    "sample_taxonomy": sample_taxonomy,
    "column_discovery": column_discovery,
    "collapse_unique": collapse_unique,
}
_D = "VALUES " + ", ".join(f"({d!r}::DOUBLE, {n!r})" for d, n in DELTAS)
SQL = {
    "feature_pairs_in_window": f"""WITH f AS ({_EVENTS})
SELECT a.feature_id, b.feature_id AS feature_id_dest, b.mz - a.mz AS delta,
  b.mz - a.mz - (a.mz + b.mz) / 2 * (10.0::DOUBLE * 1e-6::DOUBLE) AS delta_min, b.mz - a.mz + (a.mz + b.mz) / 2 * (10.0::DOUBLE * 1e-6::DOUBLE) AS delta_max
FROM f a JOIN f b ON a.sample = b.sample AND b.rt BETWEEN a.rt - 240 AND a.rt + 240 AND a.feature_id <> b.feature_id AND b.mz >= a.mz""",
    "delta_edge_match": f"SELECT DISTINCT hypothesis_id, label FROM annotate_masses_hypothesis JOIN ({_D}) d(distance, label) ON distance BETWEEN delta - 0.05 AND delta + 0.05",
    "library_mass_match": f"""WITH l AS ({_MASSES}), p AS ({_PAIRS})
SELECT DISTINCT pair_id, mass, m AS exact_mass, round(m - mass, 6) AS error_mz FROM p JOIN l
ON mass BETWEEN m - greatest(m * (20.0 * 1e-6), 0.008) AND m + greatest(m * (20.0 * 1e-6), 0.008) AND abs(m - mass) <= 0.008 AND abs(m - mass) * 1e6 / greatest(m, mass) <= 20""",
    "mass_existence": f"""WITH l AS ({_MASSES}), p AS ({_PAIRS})
SELECT pair_id, mass FROM p WHERE EXISTS (SELECT 1 FROM l WHERE mass BETWEEN m - greatest(m * (3.0 * 1e-6), 0.0005) AND m + greatest(m * (3.0 * 1e-6), 0.0005))""",
    "nearest_library_mass": f"""WITH l AS ({_MASSES}), p AS ({_PAIRS}),
lo AS (SELECT pair_id, mass, l.m AS a FROM p ASOF LEFT JOIN l ON p.mass >= l.m),
hi AS (SELECT pair_id, l.m AS b FROM p ASOF LEFT JOIN l ON p.mass < l.m)
SELECT pair_id, mass, CASE WHEN b IS NULL OR (a IS NOT NULL AND mass - a <= b - mass) THEN a ELSE b END AS nearest FROM lo JOIN hi USING (pair_id)""",
    "precursor_reduction": f"""WITH q AS (SELECT DISTINCT mass FROM ({_PAIRS})),
l AS (SELECT metadata_id, structure_exact_mass AS precursor_mz FROM structures_metadata WHERE structure_exact_mass > 0)
SELECT * FROM l WHERE EXISTS (SELECT 1 FROM q WHERE mass BETWEEN precursor_mz - greatest(precursor_mz * (5.0 * 1e-6), 0.002) AND precursor_mz + greatest(precursor_mz * (5.0 * 1e-6), 0.002))""",
    "two_window_join": f"""WITH f AS ({_EVENTS}), x AS (SELECT f.* FROM f JOIN events e ON e.event_id = f.feature_id WHERE e.event_type = 'purchase')
SELECT x.feature_id AS expected_id, f.feature_id FROM x JOIN f ON x.sample = f.sample AND f.rt BETWEEN x.rt - 120 AND x.rt + 120 AND f.mz BETWEEN x.mz - 10 AND x.mz + 10""",
    "anchor_match": """WITH r AS (SELECT candidate_id, feature_id, candidate_structure_inchikey_connectivity_layer AS s, candidate_structure_error_mz AS m, candidate_score_similarity AS rt, score_weighted_chemo AS w FROM clean_chemo)
SELECT candidate_id FROM r WHERE EXISTS (SELECT 1 FROM r a WHERE a.w >= 0.98 AND a.s = r.s AND a.feature_id <> r.feature_id AND abs(a.m - r.m) <= 0.5 AND (a.rt IS NULL OR abs(a.rt - r.rt) <= 0.15))""",
    "gap_clusters": f"""WITH f AS ({_EVENTS}), g AS (SELECT *, rt - lag(rt) OVER (PARTITION BY sample ORDER BY rt, feature_id) AS step FROM f)
SELECT feature_id, sample, CAST(sum(CASE WHEN step IS NULL OR step > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY rt, feature_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g""",
    "evidence_links": f"""WITH f AS ({_EVENTS}), n AS (SELECT *, lead(feature_id) OVER w AS next_id, lead(mz) OVER w AS next_mz FROM f WINDOW w AS (PARTITION BY sample ORDER BY rt, feature_id))
SELECT feature_id, next_id FROM n WHERE abs(mz - next_mz) <= 5""",
    "feature_top_samples": """WITH l AS (UNPIVOT (SELECT candidate_id, candidate_score_pseudo_initial, score_weighted_chemo, candidate_score_similarity FROM clean_chemo)
  ON candidate_score_pseudo_initial, score_weighted_chemo, candidate_score_similarity INTO NAME sample VALUE intensity),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY intensity DESC, sample) AS rank FROM l WHERE intensity > 0 AND NOT isnan(intensity)) SELECT * FROM r WHERE rank <= 2""",
    "intensity_vectors": "SELECT l_orderkey, list(CASE WHEN l_discount > 0 THEN l_quantity END ORDER BY l_linenumber, CASE WHEN l_discount > 0 THEN l_quantity END NULLS FIRST) AS intensity_all FROM lineitem GROUP BY l_orderkey",
    "rt_unit_normalize": """WITH s AS (SELECT min(value) > 2 OR quantile_cont(value, 0.95) > 45 OR max(value) > 180 AS seconds FROM events)
SELECT event_id, round(CASE WHEN seconds THEN value / 60 ELSE value END, 6) AS rt FROM events, s""",
    "covariance_edges": """WITH l AS (SELECT p_brand AS f, c_nationkey AS s, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT a.f AS feature_id, b.f AS feature_id_dest, count(*) AS n, round(corr(a.v, b.v), 6) AS correlation FROM l a JOIN l b ON a.s = b.s AND a.f < b.f WHERE a.v > 0 AND b.v > 0 GROUP BY 1, 2 HAVING count(*) >= 3 AND corr(a.v, b.v) > 0""",
    "null_safe_natural_join": """WITH t AS (SELECT DISTINCT taxonomy_id, organism_taxonomy_08genus, organism_taxonomy_06family FROM taxonomy),
r AS (SELECT organism_taxonomy_08genus AS g, organism_taxonomy_06family AS f, count(*) AS n FROM taxonomy GROUP BY 1, 2)
SELECT t.*, n FROM t LEFT JOIN r ON organism_taxonomy_08genus IS NOT DISTINCT FROM g AND organism_taxonomy_06family IS NOT DISTINCT FROM f""",
    "new_columns_join": """WITH b AS (SELECT feature_id, candidate_structure_inchikey_connectivity_layer AS l, max(score_biological) FILTER (NOT isnan(score_biological)) AS score_biological FROM weight_bio GROUP BY 1, 2)
SELECT candidate_id, c.feature_id, candidate_structure_inchikey_connectivity_layer, score_biological FROM clean_chemo c LEFT JOIN b ON c.feature_id = b.feature_id AND candidate_structure_inchikey_connectivity_layer IS NOT DISTINCT FROM l WHERE c.feature_id IS NOT NULL""",
    "keep_first": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "union_by_name": """WITH u AS (SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier)
SELECT nation, segment, count(*) AS n, round(sum(balance), 2) AS balance FROM u GROUP BY 1, 2""",
    "sample_taxonomy": """WITH o AS (SELECT DISTINCT feature_id, sample_organism_name AS organism_name FROM weight_bio WHERE sample_organism_name IS NOT NULL AND feature_id IS NOT NULL)
SELECT feature_id, coalesce(string_agg(DISTINCT organism_name, ' $ ' ORDER BY organism_name), 'ND') AS sample_organism_name,
  coalesce(string_agg(DISTINCT organism_taxonomy_06family, ' $ ' ORDER BY organism_taxonomy_06family), 'ND') AS sample_family,
  coalesce(string_agg(DISTINCT organism_taxonomy_08genus, ' $ ' ORDER BY organism_taxonomy_08genus), 'ND') AS sample_genus
FROM o LEFT JOIN organism_reference USING (organism_name) GROUP BY feature_id""",
    "column_discovery": "SELECT column_name FROM (VALUES ('o_totalprice'), ('o_custkey')) t(column_name)",
    "collapse_unique": "SELECT library, string_agg(DISTINCT trim(structure_tag), ' $ ' ORDER BY trim(structure_tag)) FILTER (trim(structure_tag) <> '') AS tags FROM structures_stereo GROUP BY library",
}
#: Correlations of n values beyond which Student's p is below 0.05 on both sides.
_CRITICAL = {3: 0.996917, 4: 0.95, 5: 0.878339, 6: 0.811401, 7: 0.754492, 8: 0.706734, 9: 0.666384, 10: 0.631897}
SQL["covariance_significant"] = f"""WITH l AS (SELECT candidate_adduct AS a, candidate_library AS s, count(*)::DOUBLE AS v FROM clean_chemo WHERE feature_id IS NOT NULL AND candidate_adduct IS NOT NULL GROUP BY 1, 2),
r AS (SELECT x.a AS f, y.a AS g, count(*) AS n, corr(x.v, y.v) AS r FROM l x JOIN l y ON x.s = y.s AND x.a < y.a GROUP BY 1, 2), c(n, least) AS (VALUES {", ".join(f"({n}, {r})" for n, r in _CRITICAL.items())})
SELECT f AS feature_id, g AS feature_id_dest, n, round(r, 6) AS correlation FROM r JOIN c USING (n) WHERE r > least"""
