"""The scoring pipeline: evidence of three kinds, one score, consensus of compounds, three tiers of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions.scalars import pseudo_initial, weighted_sum
from spectrail.operators.graph import top_neighbours
from spectrail.operators.keys import first_row
from spectrail.operators.scoring import LAYER, Evidence, best_per_structure, cap_ties, collapse_to_anchors, filter_ms1, high_evidence, mini_labels, percentile_keep, promote_anchors, rank_candidates
from spectrail.operators.taxonomy import CHEM_LEVELS, biological_scores, chemical_scores, neighbour_votes, organism_lookup, predicted_classes, voting_edges
from spectrail.session import cut


@dataclass(frozen=True)
class Settings:
    """Parameters of the pipeline; the weights are those of the biological, chemical and spectral score."""

    weights: tuple[float, float, float] = (0.4, 0.2, 0.3)
    neighbours: int = 16
    least_consistency: float = 0.0
    ms1_bio: float = 0.0
    ms1_chem: float = 0.0
    ms1_condition: str = "OR"
    percentile: float = 0.0
    most_ties: int = 7
    final_candidates: int = 1
    high_evidence: bool = False
    remove_ties: bool = False
    summarize: bool = False
    levels: dict[str, float] = field(default_factory=lambda: dict(CHEM_LEVELS))
    evidence: Evidence = Evidence()


#: Columns of the merged candidates that the pipeline reads; those that a table lacks are null.
OPTIONAL = {
    "candidate_score_similarity": "double", "candidate_score_sirius_confidence": "double", "candidate_structure_exact_mass": "double", "neutral_mass": "double", "rt": "double",
    "candidate_structure_error_rt": "double", "sample_organism_name": "string",
}


def merged_candidates(spectral: DataFrame, fingerprint: DataFrame | None = None, formulas: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """One row per feature and structure: its most similar spectral row, with the best fingerprint score, and the formula's and the feature's predictions.

    spectral: candidate_id, feature_id, structure layer and the columns of the row; fingerprint: feature_id, structure
    layer, candidate_score_sirius_csi or _confidence; formulas: feature_id, candidate_structure_molecular_formula and new
    columns; classes: feature_id and feature_pred_tax_<level>_val, _score. Structures that only the fingerprint search
    found are candidates, too.
    """
    keys = ["feature_id", LAYER]
    rows = first_row(spectral, keys, [F.col("candidate_score_similarity").desc_nulls_last(), F.asc("candidate_id")])
    if fingerprint is not None:
        scores = [c for c in fingerprint.columns if c.startswith("candidate_score_")]
        best = first_row(fingerprint.where(F.coalesce(*scores).isNotNull()), keys, [F.col(c).desc_nulls_last() for c in scores])
        rows = rows.drop(*scores).join(best.select(*keys, *scores), keys, "full")
    if formulas is not None:
        own = ["feature_id", "candidate_structure_molecular_formula"]
        new = [c for c in formulas.columns if c not in rows.columns]
        rows = rows.join(first_row(formulas.select(*own, *new), own, [F.col(c).desc_nulls_last() for c in new]), own, "left")
    if classes is not None:
        new = [c for c in classes.columns if c not in rows.columns]
        rows = rows.join(first_row(classes.select("feature_id", *new), ["feature_id"], [F.col(c).asc_nulls_last() for c in new]), "feature_id", "left")
    return rows


def with_predictions(rows: DataFrame, votes: DataFrame, levels: list[str]) -> DataFrame:
    """Predicted classes of each feature: its own, if the table brings a superclass for it, else its neighbours' vote."""
    voted = predicted_classes(votes, levels)
    names = [f"feature_pred_tax_{x}_{k}" for x in levels for k in ("val", "score")]
    own = [c for c in names if c in rows.columns]
    if not own:
        return rows.join(voted, "feature_id", "left")
    joined = rows.withColumnsRenamed({c: f"__{c}" for c in own}).join(voted, "feature_id", "left")
    has = F.coalesce(*[F.col(f"__{c}") for c in own if c.endswith("_val")]).isNotNull()
    return joined.withColumns({c: F.when(has, F.col(f"__{c}")).otherwise(F.col(c)) if c in own else F.when(~has, F.col(c)) for c in names}).drop(*[f"__{c}" for c in own])


def clean_candidates(rows: DataFrame, components: DataFrame | None, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, kept, counts): candidates ranked, aligned within compounds and with their ties capped; those of the percentile; and how many of both per feature."""
    tie = "candidate_id"
    # Written out before each step that meets its rows with rows of their own; all windows are within features.
    full = cut(rank_candidates(best_per_structure(rows.repartition("feature_id"), "score_weighted_chemo", [tie])))
    full = cut(promote_anchors(full, components)) if components is not None else full.withColumn("promoted", F.lit(False))
    evidence = [
        F.col("candidate_score_similarity").desc_nulls_last(), F.col("candidate_score_sirius_confidence").desc_nulls_last(), F.col("candidate_structure_error_rt").isNull(), F.desc("promoted"),
        F.col("score_weighted_chemo").desc_nulls_last(), F.col("candidate_score_pseudo_initial").desc_nulls_last(),
    ]
    ranked = cut(cap_ties(collapse_to_anchors(full), settings.most_ties, evidence, tie))
    kept = percentile_keep(ranked, ["feature_id"], "score_weighted_chemo", settings.percentile)
    counts = ranked.groupBy("feature_id").agg(F.count("*").alias("candidates_evaluated")).join(kept.groupBy("feature_id").agg(F.count("*").alias("candidates_best")), "feature_id", "left")
    return ranked, kept, counts


def report(rows: DataFrame, counts: DataFrame, settings: Settings, features: DataFrame | None, components: DataFrame | None, references: DataFrame | None) -> DataFrame:
    """Rows of a tier with what is known of their feature, component and organism; one per feature and rank, or per feature, if wanted."""
    order: list[Column] = [F.col("rank_final").asc_nulls_last(), F.col("score_weighted_chemo").desc_nulls_last(), F.col("candidate_score_pseudo_initial").desc_nulls_last(), F.asc("candidate_id")]
    if settings.remove_ties:
        rows = first_row(rows, ["feature_id", "rank_final"], order)
    if settings.summarize:
        rows = first_row(rows, ["feature_id"], order)
    if features is not None:
        rows = rows.drop("rt").join(first_row(features.select("feature_id", F.col("rt").alias("feature_rt"), F.col("mz").alias("feature_mz")), ["feature_id"], [F.col("feature_rt").asc_nulls_last(), F.col("feature_mz").asc_nulls_last()]), "feature_id", "left")
    if components is not None:
        rows = rows.drop("component_id").join(components.groupBy("feature_id").agg(F.min("component_id").alias("component_id")), "feature_id", "left")
    if references is not None:
        known = references.select(F.col("structure").alias(LAYER), F.col("taxon").alias("candidate_structure_organism_occurrence_closest"), F.col("references").alias("candidate_structure_organism_occurrence_reference"))
        rows = rows.join(known, [LAYER, "candidate_structure_organism_occurrence_closest"], "left")
    return rows.join(counts, "feature_id", "left").withColumn("candidates_best", F.when(F.col(LAYER).isNotNull(), F.col("candidates_best")))


def weight_annotations(
    annotations: DataFrame, edges: DataFrame, pairs: DataFrame, organisms: DataFrame, sample_ranks: DataFrame, settings: Settings = Settings(), components: DataFrame | None = None, features: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables full, filtered and mini.

    annotations: candidate_id, feature_id, structure layer, candidate_adduct, candidate_structure_tax_<level> and the
    OPTIONAL columns, one row per feature and structure (merged_candidates makes them); edges: feature_source,
    feature_target, candidate_score_similarity, feature_spectrum_entropy; pairs: structure, organism_name and, for the
    references of results, reference; organisms: organism_name, candidate_<rank>; sample_ranks: sample_organism_name,
    sample_<rank>; components: feature_id, component_id; features: feature_id, rt, mz.

    Scores are computed on distinct structures, names and classes and joined back. The candidates are written out twice:
    before their neighbours vote, and ranked, as all tiers start from there.
    """
    levels = list(settings.levels)
    rows = annotations.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items() if c not in annotations.columns])
    samples = rows.select(F.col(LAYER).alias("structure"), "sample_organism_name").distinct().join(sample_ranks, "sample_organism_name")
    bio = biological_scores(pairs, samples, organisms).withColumnsRenamed({"structure": LAYER, "closest": "candidate_structure_organism_occurrence_closest"})
    rows = rows.join(bio, [LAYER, "sample_organism_name"], "left")
    rows = rows.withColumn("candidate_score_pseudo_initial", pseudo_initial(F.col("candidate_score_similarity"), F.col("candidate_score_sirius_confidence")))
    own = weighted_sum([F.col("score_biological"), F.col("candidate_score_pseudo_initial")], [settings.weights[0], settings.weights[2]])
    rows = cut(rows.withColumn("score_weighted_bio", own))
    near = top_neighbours(edges, "feature_source", "feature_target", "candidate_score_similarity", settings.neighbours)
    votes = neighbour_votes(voting_edges(near), rows, "score_weighted_bio", levels, least=settings.least_consistency)
    rows = chemical_scores(with_predictions(rows, votes, levels), settings.levels)
    score = weighted_sum([F.col("score_biological"), F.col("score_chemical"), F.col("candidate_score_pseudo_initial")], list(settings.weights))
    rows = filter_ms1(rows.withColumn("score_weighted_chemo", score), settings.ms1_bio, settings.ms1_chem, settings.ms1_condition)
    full, kept, counts = clean_candidates(rows, components, settings)
    best = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.col("rank_final").asc_nulls_last(), "candidate_id"))
    filtered = high_evidence(kept, settings.evidence).withColumn("__n", best).where(F.col("__n") <= settings.final_candidates).drop("__n")
    references = None
    if "reference" in pairs.columns:
        wanted = full.select(F.col(LAYER).alias("structure"), F.col("candidate_structure_organism_occurrence_closest").alias("taxon")).where("structure IS NOT NULL AND taxon IS NOT NULL").distinct()
        references = organism_lookup(pairs, organisms.withColumnsRenamed({c: c.removeprefix("candidate_") for c in organisms.columns}), wanted)
    tiers = {"full": high_evidence(full, settings.evidence) if settings.high_evidence else full, "filtered": filtered}
    out = {name: report(df, counts, settings, features, components, references) for name, df in tiers.items()}
    one = first_row(out["filtered"], ["feature_id"], [F.col("rank_final").asc_nulls_last(), F.asc("candidate_id")])
    out["mini"] = mini_labels(kept, settings.levels).join(one.drop("candidates_evaluated", "candidates_best"), "feature_id", "left").join(counts, "feature_id", "left")
    return out
