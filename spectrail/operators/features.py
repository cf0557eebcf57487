"""Preparation of feature tables: intensities, retention times, pairs and covariance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions.special import student_p_value
from spectrail.operators.intervals import range_join
from spectrail.session import bounded, cut

#: Endings and beginnings that mark a sample's intensity column, areas before heights.
INTENSITY_PATTERNS = [r" Peak area$", r":area$", r"^quant_", r" Peak height$"]


def intensity_columns(columns: list[str]) -> dict[str, str]:
    """Sample names by their intensity columns; heights count only where no column gives areas."""
    for patterns in (INTENSITY_PATTERNS[:3], INTENSITY_PATTERNS[3:]):
        found = {c: re.sub(p, "", c) for c in columns for p in patterns if re.search(p, c)}
        if found:
            return found
    return {}


def numeric_like_columns(df: DataFrame, columns: list[str], least: float = 0.8) -> list[str]:
    """Columns of which at least that part of the non-null values are numbers, by one aggregation."""
    parts = df.agg(*[(F.count(F.col(c).try_cast("double")) / F.count(c)).alias(c) for c in columns]).first()
    return [c for c in columns if parts[c] is not None and parts[c] >= least]


def long_intensities(df: DataFrame, row_id: list[str], samples: list[str]) -> DataFrame:
    """(row_id..., sample, intensity), nulls kept."""
    return df.select(*row_id, *[F.col(c).cast("double").alias(c) for c in samples]).unpivot(row_id, samples, "sample", "intensity")


def top_samples(df: DataFrame, row_id: list[str], samples: list[str], n: int) -> DataFrame:
    """The n samples of each feature with the highest positive intensity, ties in the order of sample names."""
    rank = F.row_number().over(Window.partitionBy(*row_id).orderBy(F.desc("intensity"), "sample"))
    return long_intensities(df, row_id, samples).where("intensity > 0").withColumn("rank", rank).where(F.col("rank") <= n)


def intensity_vectors(long: DataFrame, row_id: str, sample: str, intensity: str) -> DataFrame:
    """One array per feature, ordered by sample, nulls in their places."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(intensity).alias("v"))))
    return long.groupBy(row_id).agg(F.transform(pairs, lambda x: x["v"]).alias("intensity_all"))


def normalize_rt(df: DataFrame, rt: str) -> DataFrame:
    """Retention times in minutes: seconds are assumed if the smallest exceeds 2, the 95th percentile 45 or the largest 180.

    Whether the (interpolated) percentile exceeds 45 follows from how many values don't, and from the two next to 45: one
    aggregation that combines map-side.
    """
    low = F.col(rt) <= 45
    one = df.agg(F.min(rt).alias("least"), F.max(rt).alias("most"), F.count(rt).alias("n"), F.count(F.when(low, 1)).alias("k"), F.max(F.when(low, F.col(rt))).alias("below"), F.min(F.when(~low, F.col(rt))).alias("above"))
    place = 0.95 * (F.col("n") - 1)
    between = F.col("below") + (F.col("above") - F.col("below")) * (place - F.floor(place)) > 45
    high = F.when(F.col("k") <= F.floor(place), F.lit(True)).when(F.col("k") >= F.ceil(place) + 1, F.lit(False)).otherwise(between)
    one = one.select(F.coalesce((F.col("least") > 2) | high | (F.col("most") > 180), F.lit(False)).alias("__seconds"))
    return df.crossJoin(F.broadcast(one)).withColumn(rt, F.when(F.col("__seconds"), F.col(rt) / 60).otherwise(F.col(rt))).drop("__seconds")


def feature_pairs(features: DataFrame, tolerance_rt: float, tolerance_ppm: float) -> DataFrame:
    """Pairs of features of a sample within the retention-time window, the heavier one second, with their mass difference and its range.

    features: feature_id, sample, rt, mz. Null times or masses pair with nothing.
    """
    source = features.select("feature_id", "sample", "rt", "mz", (F.col("rt") - tolerance_rt).alias("rt_min"), (F.col("rt") + tolerance_rt).alias("rt_max"))
    dest = features.select(F.col("feature_id").alias("feature_id_dest"), "sample", F.col("rt").alias("rt_dest"), F.col("mz").alias("mz_dest"))
    pairs = range_join(dest, source, "rt_dest", "rt_min", "rt_max", 2 * tolerance_rt, ["sample"])
    pairs = pairs.where((F.col("feature_id") != F.col("feature_id_dest")) & (F.col("mz_dest") >= F.col("mz")))
    delta, spread = F.col("mz_dest") - F.col("mz"), (F.col("mz") + F.col("mz_dest")) / 2 * (tolerance_ppm * 1e-6)
    return pairs.select("feature_id", "rt", "mz", "feature_id_dest", "mz_dest", delta.alias("delta"), (delta - spread).alias("delta_min"), (delta + spread).alias("delta_max"))


def covariance_edges(long: DataFrame, pairs: DataFrame, least: int = 3, p_below: float | None = 0.05) -> DataFrame:
    """Pearson correlation of the positive intensities that two features share: (feature_id, feature_id_dest, n, correlation, p_value).

    long: feature_id, sample, intensity; pairs: feature_id, feature_id_dest. Kept if least samples are shared, the
    correlation is positive and its p-value below the limit. Sums are taken in one aggregation, no vector is built.
    """
    x = long.where("intensity > 0").select("feature_id", "sample", F.col("intensity").alias("x"))
    y = x.select(F.col("feature_id").alias("feature_id_dest"), "sample", F.col("x").alias("y"))
    both = pairs.select("feature_id", "feature_id_dest").distinct().join(x, "feature_id").join(y, ["feature_id_dest", "sample"])
    r = both.groupBy("feature_id", "feature_id_dest").agg(F.count("*").alias("n"), F.corr("x", "y").alias("correlation"))
    r = r.where((F.col("n") >= least) & (F.col("correlation") > 0)).withColumn("p_value", student_p_value(F.col("correlation"), F.col("n")))
    return r if p_below is None else r.where(F.col("p_value") < p_below)


def sample_taxa(features: DataFrame, metadata: DataFrame, taxonomy: DataFrame, organism: str, separator: str = r"\|") -> DataFrame:
    """Per feature the organisms of its sample (several in a cell are parted) with their taxonomy, each rank's values joined by ' $ ', ND where unknown.

    features: feature_id, sample; metadata: sample and the organism column; taxonomy: organism_name and its rank columns.
    """
    ranks = [c for c in taxonomy.columns if c != "organism_name"]
    own = metadata.select("sample", F.explode(F.split(F.col(organism), separator)).alias("organism_name")).select("sample", F.trim("organism_name").alias("organism_name"))
    known = own.distinct().join(bounded(cut(taxonomy)), "organism_name", "left")

    def joined(c: str):
        return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), " $ "), F.lit("")), F.lit("ND")).alias(f"sample_{c}")

    return features.join(known, "sample", "left").groupBy("feature_id").agg(joined("organism_name"), *[joined(c) for c in ranks])
