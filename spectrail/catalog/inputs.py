"""Queries on adapters and input reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.operators.scoring import LAYER
from spectrail.session import table
from spectrail.sources.annotations import assemble_fingerprint_tables, merge_edges, report_mismatches, report_table, to_model


def _chemo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_chemo")


def adapter_gnps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _chemo(spark, sf_dir).select(F.col("feature_id").alias("#Scan#"), F.concat(F.lit(" "), "candidate_adduct").alias("Adduct"), F.col("candidate_library").alias("LibraryName"), F.col("candidate_structure_name").alias("Compound_Name"), F.col("candidate_score_similarity").cast("string").alias("MQScore"), F.lit("10").alias("MZErrorPPM"), F.lit("400").alias("Precursor_MZ"))
    return to_model(raw, "gnps")


def adapter_mzmine(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _chemo(spark, sf_dir).select(F.col("feature_id").alias("id"), F.col("candidate_structure_name").alias("compound_name"), F.col("candidate_adduct").alias("adduct"))
    return to_model(raw, "mzmine")


def fingerprint_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their formula row, and de-novo rows of other features."""
    chemo = _chemo(spark, sf_dir).where("feature_id IS NOT NULL").select("feature_id", LAYER, "candidate_library", "candidate_adduct", F.col("candidate_structure_error_mz").alias("e"), F.when(~F.isnan("score_weighted_chemo"), F.col("score_weighted_chemo")).alias("w"))
    formula = F.col("candidate_adduct").alias("candidate_structure_molecular_formula")
    structures = chemo.where("candidate_library <> 'florabase'").select("feature_id", LAYER, formula).distinct()
    de_novo = chemo.where("candidate_library = 'florabase'").select("feature_id", LAYER, formula).distinct()
    formulas = chemo.groupBy("feature_id", formula).agg(F.max("w").alias("candidate_score_sirius_zodiac"), F.lit("x").alias("candidate_adduct"), F.min(F.col("e") / 100).alias("candidate_structure_error_mz"))
    classes = chemo.groupBy("feature_id").agg(F.lit("x").alias("candidate_adduct"), F.min("candidate_library").alias("feature_pred_tax_npc_01pat_val"))
    return assemble_fingerprint_tables(structures, formulas, classes, de_novo).select("feature_id", LAYER, "candidate_structure_molecular_formula", "candidate_score_sirius_zodiac", "feature_pred_tax_npc_01pat_val")


def edges_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotate_masses_hypothesis").where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL").withColumnsRenamed({"feature_id": "feature_source", "feature_id_dest": "feature_target"})
    mass = rows.where("adduct IS NOT NULL").groupBy("feature_source", "feature_target").agg(F.min("adduct").alias("label"))
    spectral = rows.where("delta < 100").groupBy("feature_source", "feature_target").agg(F.max("delta").alias("candidate_score_similarity"))
    entropy = _chemo(spark, sf_dir).where("feature_id IS NOT NULL").groupBy(F.col("feature_id").alias("feature_source")).agg(F.count("*").alias("feature_spectrum_peaks"))
    return merge_edges(mass, entropy, spectral)


def input_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_table(_chemo(spark, sf_dir), "feature_id")


def input_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_mismatches(_chemo(spark, sf_dir), table(spark, sf_dir, "weight_bio"), "feature_id")


QUERIES = {"adapter_gnps": adapter_gnps, "adapter_mzmine": adapter_mzmine, "fingerprint_assembly": fingerprint_assembly, "edges_merge": edges_merge, "input_report": input_report, "input_mismatches": input_mismatches}
SQL = {
    "adapter_gnps": "SELECT DISTINCT feature_id, candidate_adduct, candidate_library, candidate_structure_name, candidate_score_similarity, 10.0::DOUBLE * 1e-6::DOUBLE * 400.0::DOUBLE AS candidate_structure_error_mz FROM clean_chemo",
    "adapter_mzmine": "SELECT DISTINCT feature_id, candidate_structure_name, candidate_adduct, 'mzmine' AS candidate_library FROM clean_chemo",
    "fingerprint_assembly": f"""WITH c AS (SELECT feature_id AS f, {LAYER} AS l, candidate_library AS b, candidate_adduct AS m, candidate_structure_error_mz AS e, CASE WHEN NOT isnan(score_weighted_chemo) THEN score_weighted_chemo END AS w FROM clean_chemo WHERE feature_id IS NOT NULL),
s AS (SELECT DISTINCT f, l, m FROM c WHERE b <> 'florabase'), r AS (SELECT * FROM s UNION ALL SELECT DISTINCT f, l, m FROM c WHERE b = 'florabase' AND f NOT IN (SELECT f FROM s)), z AS (SELECT f, m, max(w) AS z, min(e / 100) AS e FROM c GROUP BY 1, 2), k AS (SELECT f, min(b) AS b FROM c GROUP BY 1)
SELECT r.f AS feature_id, l AS {LAYER}, r.m AS candidate_structure_molecular_formula, z AS candidate_score_sirius_zodiac, k.b AS feature_pred_tax_npc_01pat_val FROM r LEFT JOIN z ON r.f = z.f AND r.m = z.m LEFT JOIN k ON r.f = k.f WHERE e IS NULL OR abs(e) <= 0.01""",
    "edges_merge": """WITH e AS (SELECT feature_id AS s, feature_id_dest AS t, adduct, delta FROM annotate_masses_hypothesis WHERE feature_id IS NOT NULL AND feature_id_dest IS NOT NULL), m AS (SELECT s, t, min(adduct) AS label FROM e WHERE adduct IS NOT NULL GROUP BY 1, 2), p AS (SELECT s, t, max(delta) AS c FROM e WHERE delta < 100 GROUP BY 1, 2),
h AS (SELECT feature_id AS s, count(*) AS n FROM clean_chemo WHERE feature_id IS NOT NULL GROUP BY 1), b AS (SELECT s, t, label, c FROM m FULL JOIN p USING (s, t))
SELECT DISTINCT s AS feature_source, coalesce(t, s) AS feature_target, label, c AS candidate_score_similarity, n AS feature_spectrum_peaks FROM b FULL JOIN h USING (s)""",
    "input_report": "WITH k AS (SELECT feature_id, count(*) AS n FROM clean_chemo GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(feature_id) AS distinct_keys, CAST(coalesce(sum(n) FILTER (feature_id IS NULL), 0) AS BIGINT) AS missing_keys, count(*) FILTER (feature_id IS NOT NULL AND n > 1) AS repeated_keys FROM k",
    "input_mismatches": "WITH a AS (SELECT DISTINCT feature_id FROM clean_chemo WHERE feature_id IS NOT NULL), b AS (SELECT DISTINCT feature_id FROM weight_bio WHERE feature_id IS NOT NULL) SELECT feature_id, 'left' AS side FROM a WHERE feature_id NOT IN (SELECT * FROM b) UNION ALL SELECT feature_id, 'right' FROM b WHERE feature_id NOT IN (SELECT * FROM a)",
}
