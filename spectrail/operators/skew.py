"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.session import BROADCAST_ROWS, bounded, cut

#: A key with more rows than this is hot: its rows are salted instead of meeting in one task.
HOT_ROWS = 50_000
#: Parts into which the rows of a hot key are salted, at least; large keys get one part for every HOT_ROWS rows.
SALTS = 16


def few_hot(counts: DataFrame, n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of counts above hot_rows, written out; never more than may be broadcast.

    Where more keys than that are above hot_rows, the limit rises to the rows' share of them: a key below it then holds
    less than one BROADCAST_ROWS-th of all rows, which is no skew.
    """
    hot = cut(counts.where(F.col(n) > hot_rows))
    size = hot.agg(F.count("*").alias("keys"), F.sum(n).alias("rows")).first()
    return hot if size.keys <= BROADCAST_ROWS else hot.where(F.col(n) > size.rows // BROADCAST_ROWS)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than hot_rows rows and their number of parts. counts: one row per key with its exact number of rows.

    At most BROADCAST_ROWS keys come out, so every user may broadcast them.
    """
    parts = F.greatest(F.lit(SALTS), F.ceil(F.col(n) / hot_rows)).cast("int").alias("__parts")
    return few_hot(counts, n, hot_rows).select(*keys, parts)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """left join right, where left may have hot keys and right has one row per key.

    Rows of a hot key are spread over its parts by salt (an integer column of left) and right's row is repeated once
    per part; all other rows join as usual, in the same shuffle. hot: from hot_keys().
    """
    parts = bounded(hot)
    a = left.join(parts, keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), F.col("__parts"))).cast("int")).drop("__parts")
    b = right.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"], how).drop("__part")


def split_points(df: DataFrame, keys: list[str], value: str, pieces: int = 64) -> DataFrame:
    """Per key an ascending array `__cuts` of at most pieces - 1 values that part its rows about evenly (one mergeable sketch per key)."""
    grid = [i / pieces for i in range(1, pieces)]
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, grid, 2_000))).alias("__cuts"))


def with_range_bucket(df: DataFrame, cuts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `__bucket`: how many split points lie above the value, so bucket 0 holds the largest values. Equal values share a bucket."""
    return df.join(bounded(cuts), keys).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c > F.col(value)))).drop("__cuts")


def counts_above(df: DataFrame, keys: list[str], value: str, n: str, hot: DataFrame) -> DataFrame:
    """For rows (keys, value, n), one per distinct value: adds `__above`, the sum of n over greater values of the same key.

    Keys in hot are cut into value ranges; a range knows the sum of the ranges above it, so no task sorts a whole hot key.
    """
    own = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    flags = bounded(hot)
    cold = df.join(flags, keys, "left_anti").withColumn("__above", F.coalesce(F.sum(n).over(own), F.lit(0)))
    warm = df.join(flags, keys, "left_semi")
    ranged = with_range_bucket(warm, cut(split_points(warm, keys, value)), keys, value)
    before = ranged.groupBy(*keys, "__bucket").agg(F.sum(n).alias("__in"))
    order = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(before.withColumn("__before", F.coalesce(F.sum("__in").over(order), F.lit(0))).drop("__in"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.join(bounded(before), [*keys, "__bucket"]).withColumn("__above", F.col("__before") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return cold.unionByName(ranged.select(*cold.columns))
