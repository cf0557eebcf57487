"""Queries on references between the structure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.operators.orphans import References, find_orphans, orphan_report, tidy_key
from spectrail.session import table


def _registry_references(spark: SparkSession, sf_dir: str) -> list[tuple[References, DataFrame]]:
    pairs, metadata, stereo = (table(spark, sf_dir, t) for t in ("structure_organism_pairs", "structures_metadata", "structures_stereo"))
    key = tidy_key(F.col("structure_inchikey_no_stereo"))
    return [
        (
            References("structure_organism_pairs", pairs.select(F.col("pair_id").alias("id"), tidy_key(F.col("structure_inchikey_connectivity_layer")).alias("key"), F.col("added_at").alias("t"))),
            metadata.select(F.substring(key, 1, 14).alias("key"), F.col("added_at").alias("since"), F.col("removed_at").alias("until")),
        ),
        (
            References("structures_metadata", metadata.select(F.col("metadata_id").alias("id"), key.alias("key"), F.col("added_at").alias("t"))),
            stereo.groupBy(key.alias("key")).agg(F.min("added_at").alias("since")).withColumn("until", F.lit(None).cast("timestamp_ntz")),
        ),
    ]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that names a structure the registry lacks at that time."""
    a, b = (find_orphans(child, parent)[0] for child, parent in _registry_references(spark, sf_dir))
    return a.unionByName(b)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans by table and month."""
    a, b = (orphan_report(child, parent) for child, parent in _registry_references(spark, sf_dir))
    return a.unionByName(b)


_KEY = "upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_PAIR_KEY, _META_KEY = _KEY.format("structure_inchikey_connectivity_layer"), _KEY.format("structure_inchikey_no_stereo")

_P1 = f"""
WITH pairs AS (SELECT pair_id AS id, {_PAIR_KEY} AS k, added_at AS t FROM structure_organism_pairs WHERE structure_inchikey_connectivity_layer IS NOT NULL),
meta AS (SELECT metadata_id AS id, {_META_KEY} AS k, substr({_META_KEY}, 1, 14) AS k14, added_at AS t, removed_at AS gone FROM structures_metadata WHERE structure_inchikey_no_stereo IS NOT NULL),
stereo AS (SELECT {_META_KEY} AS k, min(added_at) AS t FROM structures_stereo GROUP BY 1),
refs AS (
  SELECT 'structure_organism_pairs' AS child_table, p.id, p.t, EXISTS (SELECT 1 FROM meta m WHERE m.k14 = p.k AND m.t <= p.t AND (m.gone IS NULL OR m.gone > p.t)) AS live FROM pairs p
  UNION ALL
  SELECT 'structures_metadata', m.id, m.t, EXISTS (SELECT 1 FROM stereo s WHERE s.k = m.k AND s.t <= m.t) FROM meta m)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _P1 + "SELECT child_table, id AS child_id, strftime(t, '%Y-%m') AS period FROM refs WHERE NOT live",
    "p1_report": _P1 + "SELECT child_table, strftime(t, '%Y-%m') AS period, count(*) AS n_refs, CAST(count(*) FILTER (WHERE NOT live) AS BIGINT) AS n_orphans FROM refs GROUP BY 1, 2",
}
