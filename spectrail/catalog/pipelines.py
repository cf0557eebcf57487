"""Whole pipelines over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.catalog.mass_sql import BASELINE, CLUSTERS, DALTON, LOSSES, PPM, RT, UNIVERSE
from spectrail.catalog.mass_sql import SQL as _MASS_SQL
from spectrail.catalog.pipeline_sql import LEVELS as _LEVELS
from spectrail.catalog.pipeline_sql import SQL as _SCORING_SQL
from spectrail.operators.adducts import adduct_universe
from spectrail.operators.graph import connected_components
from spectrail.operators.scoring import LAYER
from spectrail.operators.taxonomy import BIO_RANKS
from spectrail.plans.annotate_masses import MassSettings, annotate_masses
from spectrail.plans.weight_annotations import Settings, merged_candidates, weight_annotations
from spectrail.session import table
from spectrail.streaming.gaps import session_clusters



def _tiers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """clean_chemo's similarities as spectral matches, its scores as a fingerprint search, and the components and organisms of the other tables."""
    chemo = table(spark, sf_dir, "clean_chemo").where(f"feature_id IS NOT NULL AND {LAYER} IS NOT NULL")
    sop = table(spark, sf_dir, "structure_organism_pairs").where("structure_inchikey_connectivity_layer IS NOT NULL")
    known = sop.groupBy(F.col("structure_inchikey_connectivity_layer").alias(LAYER)).agg(*[F.min(f"structure_tax_{x}").alias(f"candidate_structure_tax_{x}") for x in _LEVELS], F.min("structure_exact_mass").alias("candidate_structure_exact_mass"))
    sample = table(spark, sf_dir, "weight_bio").where("feature_id IS NOT NULL").groupBy("feature_id").agg(F.min("sample_organism_name").alias("sample_organism_name"))
    similar = F.when(~F.isnan("candidate_score_similarity"), F.col("candidate_score_similarity")).alias("candidate_score_similarity")
    mass, rt = F.when(~F.isnan("candidate_structure_error_mz"), F.bround(F.col("candidate_structure_error_mz"), 1) + 400), F.lit(None).cast("double")
    spectral = chemo.select("candidate_id", "feature_id", LAYER, "candidate_adduct", similar, mass.alias("neutral_mass"), rt.alias("rt"))
    fingerprint = chemo.where("NOT isnan(score_weighted_chemo)").select("feature_id", LAYER, F.col("score_weighted_chemo").alias("candidate_score_sirius_confidence"))
    rows = merged_candidates(spectral, fingerprint).join(sample, "feature_id", "left").join(known, LAYER, "left")
    pairs = table(spark, sf_dir, "annotate_masses_hypothesis").where("feature_id IS NOT NULL AND feature_id_dest IS NOT NULL")
    edges = pairs.select(F.col("feature_id").alias("feature_source"), F.col("feature_id_dest").alias("feature_target"), (1 / (1 + F.col("delta"))).alias("candidate_score_similarity"), F.col("delta").alias("feature_spectrum_entropy"))
    components = connected_components(pairs, "feature_id", "feature_id_dest").select("feature_id", F.col("component").alias("component_id"))
    features = chemo.groupBy("feature_id").agg(F.min("candidate_structure_error_mz").alias("rt"), F.max("candidate_structure_error_mz").alias("mz"))
    ref = table(spark, sf_dir, "organism_reference")
    organisms = ref.select("organism_name", *[F.col(f"organism_taxonomy_{r}").alias(f"candidate_{r}") for r in BIO_RANKS])
    ranks = ref.select(F.col("organism_name").alias("sample_organism_name"), *[F.col(f"organism_taxonomy_{r}").alias(f"sample_{r}") for r in BIO_RANKS])
    found = sop.select(F.col("structure_inchikey_connectivity_layer").alias("structure"), "organism_name", F.col("reference_doi").alias("reference"))
    return weight_annotations(rows, edges, found, organisms, ranks, Settings(levels=_LEVELS), components, features)


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "candidate_id", "feature_id", LAYER, "score_biological", "score_chemical", F.round("score_weighted_chemo", 9).alias("score"), F.col("rank_final").cast("long").alias("rank_final"), "promoted", "annotation_note",
        "component_id", "candidates_evaluated", "candidates_best", F.col("candidate_structure_organism_occurrence_closest").alias("closest"), F.col("candidate_structure_organism_occurrence_reference").alias("reference"),
    )


def weighted_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored candidate with its ranks, notes, component, counts and organism references."""
    return _shown(_tiers(spark, sf_dir)["full"])


def weighted_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates of high evidence."""
    return _shown(_tiers(spark, sf_dir)["filtered"])


def weighted_mini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per feature: its best candidate of high evidence and the class labels that it or its neighbours give."""
    mini = _tiers(spark, sf_dir)["mini"]
    return mini.select("feature_id", "candidate_id", "candidate_adduct", "has_inchikey", "label_classyfire", F.round("score_classyfire", 6).alias("score_classyfire"), "label_npclassifier", F.round("score_npclassifier", 6).alias("score_npclassifier"), "candidates_evaluated")


_MASS_SETTINGS = MassSettings(PPM, DALTON, RT, BASELINE, "metadata")


def _masses(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events as features: values as m/z, users as samples, minutes as times."""
    events = table(spark, sf_dir, "events")
    features = events.select(F.col("event_id").cast("string").alias("feature_id"), F.col("user_id").alias("sample"), (F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("rt"), (F.col("value") + 150).alias("mz"))
    library = table(spark, sf_dir, "structures_metadata").where("structure_inchikey_no_stereo IS NOT NULL").select(F.col("structure_inchikey_no_stereo").alias("structure"), F.col("structure_exact_mass").alias("exact_mass"), F.col("structure_molecular_formula").alias("formula"))
    clusters, losses = (spark.createDataFrame(t, "distance double, label string") for t in (CLUSTERS, LOSSES))
    return annotate_masses(features, library, adduct_universe(spark, *UNIVERSE), clusters, losses, _MASS_SETTINGS)


def mass_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of events by mass."""
    return _masses(spark, sf_dir)["annotations"].select("feature_id", "adduct", "structure", "source", "adduct_support", "exact_mass", F.round("error_mz", 7).alias("error_mz"))


def mass_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between events that go with their annotation, with self-loops of the others."""
    return _masses(spark, sf_dir)["edges"]


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, by the streaming form of the gap clusters run over the whole table."""
    s = session_clusters(table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n_events", "highest")


QUERIES = {"weighted_full": weighted_full, "weighted_filtered": weighted_filtered, "weighted_mini": weighted_mini, "mass_annotations": mass_annotations, "mass_edges": mass_edges, "event_sessions": event_sessions}
SQL = _SCORING_SQL | _MASS_SQL | {
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events, max(value) AS highest FROM s GROUP BY user_id, k""",
}
