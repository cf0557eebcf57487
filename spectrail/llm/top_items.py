"""Top N items within every group, by a hot-cold split.

Exact group counts send each group one way. Light groups go through an ordinary window. Heavy groups are cut into score
ranges; ranges that lie below N better rows are dropped by their exact counts, and the rest is cut down in salted parts, as
many as its exact count asks for, to N rows each before the final order is made, so no task sorts a heavy group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, few_hot, split_points, with_range_bucket
from spectrail.session import bounded, cut


def top_items(df: DataFrame, group: str, score: str, row_id: str, n: int, hot_rows: int = HOT_ROWS, salts: int = 16) -> DataFrame:
    """The n rows of each group with the highest score, ties going to the smaller id: group, row_id, score, position.

    Rows with a null group and with a null or NaN score never count; groups with fewer rows come out whole. Repeated rows
    with different ids are rows of their own. An empty table gives an empty result.
    """
    rows = df.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(row_id).alias("i")).where(F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    counts = rows.groupBy("g").agg(F.count("*").alias("size"))
    flags = bounded(few_hot(counts, "size", hot_rows).select("g"))
    best = F.desc("s"), F.asc("i")

    light = rows.join(flags, "g", "left_anti")
    light = light.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*best))).where(F.col("position") <= n)

    own = rows.join(flags, "g", "left_semi")
    ranged = with_range_bucket(own, cut(split_points(own, ["g"], "s")), ["g"], "s")
    above = Window.partitionBy("g").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = ranged.groupBy("g", "__bucket").agg(F.count("*").alias("in")).withColumn("before", F.coalesce(F.sum("in").over(above), F.lit(0)))
    # Equal scores share a range, so a range may be as large as its group: it gets as many parts as its rows need.
    needed = cut(needed.where(F.col("before") < n).select("g", "__bucket", F.greatest(F.lit(salts), F.ceil(F.col("in") / hot_rows)).alias("parts")))
    part = F.pmod(F.xxhash64("i"), F.col("parts"))
    kept = ranged.join(bounded(needed), ["g", "__bucket"]).withColumn("part", part)
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("g", "__bucket", "part").orderBy(*best))).where(F.col("k") <= n)
    top = kept.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*best))).where(F.col("position") <= n)

    return light.unionByName(top.select(*light.columns)).select(F.col("g").alias(group), F.col("i").alias(row_id), F.col("s").alias(score), "position")
