"""The filter pipeline: candidates of all sources reduced to those that agree with their feature's ion and retention time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.operators.keys import natural_join
from spectrail.operators.scoring import adduct_semantics, best_rt_match, without_redundant_ms1


def filter_annotations(features: DataFrame, ms1: DataFrame, spectral: DataFrame, states: DataFrame, times: DataFrame | None = None, ppm: float = 10.0, dalton: float = 0.005, rt: float | None = None) -> DataFrame:
    """Features with their candidates: redundant ones by mass alone dropped, ions checked, the retention-time error added.

    features: feature_id, rt, mz; ms1, spectral: candidates with candidate_id, feature_id, the structure layer,
    candidate_library, state_key and neutral_mass; states: feature_id, state_key, neutral_mass, support; times: structure
    layer, rt. A feature without a candidate keeps one row of nulls. rt: the greatest error, none by default; candidates
    without a time stay.
    """
    candidates = without_redundant_ms1(ms1, spectral)
    joined = natural_join(features.distinct(), candidates)
    known = adduct_semantics(joined.where(F.col("candidate_id").isNotNull()), states, ppm, dalton)
    if times is not None:
        known = best_rt_match(known, times, ["candidate_id"])
        if rt is not None:
            known = known.where(F.col("candidate_structure_error_rt").isNull() | (F.abs("candidate_structure_error_rt") <= rt))
    return known.unionByName(joined.where(F.col("candidate_id").isNull()), allowMissingColumns=True)
