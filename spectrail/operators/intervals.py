"""Joins on ranges and nearest values, and clusters by gaps, without nested loops."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, hot_keys
from spectrail.session import BROADCAST_ROWS, bounded, cut


@dataclass(frozen=True)
class Tolerance:
    """A mass tolerance of ppm and Dalton, with the way in which the two are combined."""

    ppm: float
    dalton: float
    combine: str = "max"  # max: the wider window; or / and: one of or both limits; sum: both added

    def window(self, mass: Column) -> Column:
        """Half the width of the window around a mass."""
        relative = mass * (self.ppm * 1e-6)
        if self.combine == "sum":
            return relative + self.dalton
        return F.least(relative, F.lit(self.dalton)) if self.combine == "and" else F.greatest(relative, F.lit(self.dalton))

    def holds(self, a: Column, b: Column) -> Column:
        """Whether two masses agree; the relative limit refers to the greater one."""
        return F.abs(a - b) <= self.window(F.greatest(a, b))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, on: list[str] | None = None, how: str = "inner", also: Column | None = None) -> DataFrame:
    """Rows of points with low <= value <= high of ranges, and equal columns `on`.

    A point lies in one bucket of the given width and a range in all that it touches, so this is a hash or merge join on
    the bucket (and `on`) with the exact condition on top; no pair is met twice. width should be about the length of the
    longest range. how: inner, or left_semi (points that lie in some range). also: a further condition on a pair. Columns
    must differ but for `on`. Nulls match nothing. A crowded bucket is a skewed part of a sort-merge join, which AQE splits.
    """
    on = on or []
    inside = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    inside = inside if also is None else inside & also
    a = points.withColumn("__bucket", F.floor(F.col(value) / width))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    if how == "left_semi":
        a = a.alias("a")
        b = b.withColumnsRenamed({c: f"__r_{c}" for c in [*on, "__bucket"]})
        same = F.col("__bucket") == F.col("__r___bucket")
        for c in on:
            same = same & (F.col(f"a.{c}") == F.col(f"__r_{c}"))
        return a.join(b, same & inside, "left_semi").drop("__bucket")
    return a.join(b, [*on, "__bucket"]).where(inside).drop("__bucket")


def ranges_hit(ranges: DataFrame, points: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ranges in which some point lies, each once. Equal points count once, so a crowded spot costs no more."""
    a = ranges.where(F.col(low) <= F.col(high)).withColumn("__row", F.struct(*ranges.columns))
    b = points.select(F.col(value).alias("__v")).where(F.col(value).isNotNull()).distinct().withColumn("__bucket", F.floor(F.col("__v") / width))
    a = a.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    hit = a.join(b.withColumnRenamed("__bucket", "__b"), (F.col("__bucket") == F.col("__b")) & (F.col("__v") >= F.col(low)) & (F.col("__v") <= F.col(high)), "left_semi")
    return hit.select(*ranges.columns).dropDuplicates()


def _nearest_of_few(points: DataFrame, targets: DataFrame, value: str) -> DataFrame:
    """points with `nearest` of a bounded number of targets (__t): each Arrow batch is searched in the sorted array, nothing is shuffled."""
    known = np.sort(np.array([r[0] for r in targets.collect()], np.float64))
    shared = points.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("double")
    def nearest(column: pd.Series) -> pd.Series:
        held, v = shared.value, column.to_numpy(np.float64, na_value=np.nan)
        if not len(held):
            return pd.Series([None] * len(v), dtype="float64")
        at = np.searchsorted(held, v)
        below, above = held[np.clip(at - 1, 0, len(held) - 1)], held[np.clip(at, 0, len(held) - 1)]
        return pd.Series(np.where(np.isnan(v), np.nan, np.where(np.abs(v - below) <= np.abs(above - v), below, above)))

    found = points.withColumn("nearest", nearest(F.col(value).cast("double")))
    return found.withColumn("nearest", F.when(~F.isnan("nearest"), F.col("nearest")))


def nearest_join(points: DataFrame, targets: DataFrame, value: str, target: str, width: float = 1.0, on: list[str] | None = None, few: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """points with `nearest`, the target value closest to `value` (the lower of two equally close ones) among those with equal columns `on`; null if there is none.

    Few targets without `on` are searched in memory. Else both sides are cut into buckets: within a bucket one pass in
    order of value remembers the last target and the next one, and a table of the buckets' extremes, itself carried on by
    blocks of buckets, gives the neighbours beyond. Buckets that hold many points are salted, their targets repeated. No
    point meets more than four targets. Null and NaN values have no nearest target; null in `on` matches nothing.
    """
    on = on or []
    number = F.col(target).cast("double")
    t = targets.select(*on, number.alias("__t")).where(number.isNotNull() & ~F.isnan(number)).distinct()
    if not on:
        t = cut(t)
        if t.count() <= few:
            return _nearest_of_few(points, t, value)
    bucket = [*on, "__bucket"]
    t = t.withColumn("__bucket", F.floor(F.col("__t") / width))
    ends = cut(t.groupBy(*bucket).agg(F.min("__t").alias("__first"), F.max("__t").alias("__last")))
    own = F.col(value).cast("double")
    p = points.withColumn("__v", F.when(~F.isnan(own), own)).withColumn("__bucket", F.floor(F.col("__v") / width))
    held = p.where(F.col("__bucket").isNotNull()).groupBy(*bucket).agg(F.count("*").alias("__n"))
    hot = bounded(hot_keys(held, bucket, "__n", hot_rows).withColumnRenamed("__parts", "__many"))
    # One row per bucket in use, in blocks of 1,000 buckets; one row per block above them.
    line = held.select(*bucket).join(ends, bucket, "full").withColumn("__block", F.floor(F.col("__bucket") / 1_000))
    block = line.groupBy(*on, "__block").agg(F.min("__first").alias("__f"), F.max("__last").alias("__l"))
    whole = Window.partitionBy(*on).orderBy("__block")
    beside = block.select(*on, "__block", F.max("__l").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("__lb"), F.min("__f").over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("__fa"))
    inner = Window.partitionBy(*on, "__block").orderBy("__bucket")
    before, after = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(1, Window.unboundedFollowing)
    line = line.select(*bucket, "__block", F.max("__last").over(before).alias("__below"), F.min("__first").over(after).alias("__above")).join(beside, [*on, "__block"])
    line = cut(line.select(*bucket, F.coalesce("__below", "__lb").alias("__below"), F.coalesce("__above", "__fa").alias("__above")))
    parts = F.coalesce(F.col("__many"), F.lit(1))
    p = p.join(hot, bucket, "left").withColumn("__part", F.pmod(F.xxhash64(*points.columns), parts)).drop("__many")
    t = t.join(hot, bucket, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("__many")
    run = Window.partitionBy(*bucket, "__part").orderBy("__v", F.col("__t").isNull())
    both = p.withColumn("__t", F.lit(None).cast("double")).unionByName(t.withColumn("__v", F.col("__t")), allowMissingColumns=True).withColumn("__is_point", F.col("__t").isNull())
    both = both.withColumn("__lower", F.last("__t", True).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__upper", F.first("__t", True).over(run.rowsBetween(0, Window.unboundedFollowing)))
    found = both.where("__is_point").join(bounded(line), bucket, "left")
    near = F.array_compact(F.array("__lower", "__upper", "__below", "__above"))
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x - F.col("__v")).alias("d"), x.alias("t"))))
    return found.withColumn("nearest", F.when(F.col("__v").isNotNull(), best["t"])).select(*points.columns, "nearest")


def gap_cluster(df: DataFrame, keys: list[str], axis: str, gap: float, tie: list[str], relative_ppm: bool = False) -> DataFrame:
    """Adds `cluster`: 1, 2, ... along the axis within the keys; a new one begins where the step exceeds gap (ppm of the value if relative) or the axis is null."""
    order = Window.partitionBy(*keys).orderBy(F.col(axis).asc_nulls_last(), *tie)
    step = F.col(axis) - F.lag(axis).over(order)
    limit = F.col(axis) * (gap * 1e-6) if relative_ppm else F.lit(gap)
    new = F.when(step.isNull() | (step > limit), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def linked_to_next(df: DataFrame, keys: list[str], axis: str, value: str, row_id: str, tolerance: Tolerance) -> DataFrame:
    """(row_id, next_id) of rows next to each other along the axis whose values agree within the tolerance."""
    order = Window.partitionBy(*keys).orderBy(axis, row_id)
    following = df.withColumn("__id", F.lead(row_id).over(order)).withColumn("__value", F.lead(value).over(order))
    return following.where(tolerance.holds(F.col(value), F.col("__value"))).select(row_id, F.col("__id").alias("next_id"))
