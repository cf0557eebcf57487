"""References to records that do not exist, or not at that time.

A child row refers by a key to a parent table whose records stand from one time until another (or for good). A row is an
orphan if no parent record of that key stands at the row's own time.

Skew-aware split, without any row-by-row search:

1. References are pre-aggregated per key and day, parents per key and moment (opened - closed), both with map-side
   combining, so a key that holds a third of all rows shrinks to one row per day before anything is shuffled.
2. A running sum over the days of a key (never more rows than days) gives each reference group its verdict: live, orphan,
   or mixed if a parent opens or closes on that very day.
3. Heavy keys take their verdicts from a broadcast whose size is checked; the rest go through a shuffled anti-join on
   (key, day). Only rows of mixed groups are ordered in time, within one key and day.
4. The orphans of both ways are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, few_hot
from spectrail.session import bounded, cut


def tidy_key(c: Column) -> Column:
    """A structure key without regard to letter case and to white space around it."""
    return F.upper(F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))


@dataclass(frozen=True)
class References:
    """Rows that refer: id, key and time."""

    table: str
    rows: DataFrame  # id, key, t


@dataclass(frozen=True)
class Groups:
    """Verdicts per key and day, the parents' events and the keys that hold many references."""

    verdicts: DataFrame  # key, day, n, verdict, base
    events: DataFrame  # key, t, d
    heavy: DataFrame  # key


def _judge(child: DataFrame, parent: DataFrame, hot_rows: int) -> Groups:
    day = F.to_date("t").alias("day")
    refs = child.groupBy("key", day).agg(F.count("*").alias("n"))
    opened = parent.where(F.col("since").isNotNull() & F.col("key").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    closed = opened.where(F.col("until").isNotNull())
    events = (
        opened.select("key", F.col("since").alias("t"), F.lit(1).alias("d"))
        .unionByName(closed.select("key", F.col("until").alias("t"), F.lit(-1).alias("d")))
        .groupBy("key", "t")
        .agg(F.sum("d").alias("d"))
    )
    events = events.where(F.col("d") != 0)
    zero = F.lit(0).cast("long")
    marks = refs.select("key", "day", "n", zero.alias("net"), zero.alias("ups"), zero.alias("downs")).unionByName(
        events.select("key", day, zero.alias("n"), F.col("d").alias("net"), F.greatest("d", zero).alias("ups"), F.least("d", zero).alias("downs"))
    )
    marks = marks.groupBy("key", "day").agg(*[F.sum(c).alias(c) for c in ("n", "net", "ups", "downs")])
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("net").over(before), zero)
    verdict = (
        F.when((F.col("base") > 0) & (F.col("base") + F.col("downs") > 0), "live")
        .when((F.col("base") <= 0) & (F.col("ups") == 0), "orphan")
        .otherwise("mixed")
    )
    verdicts = cut(marks.withColumn("base", base).where("n > 0").select("key", "day", "n", verdict.alias("verdict"), "base"))
    heavy = few_hot(verdicts.groupBy("key").agg(F.sum("n").alias("n")), "n", hot_rows).select("key")
    return Groups(verdicts, events, heavy)


def _mixed(rows: DataFrame, events: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of mixed groups (with their base) at whose moment no parent stands."""
    moves = events.withColumn("day", F.to_date("t")).join(mixed.select("key", "day", "base"), ["key", "day"])
    both = rows.select("key", "day", "t", "base", "id", F.lit(0).cast("long").alias("d")).unionByName(moves.select("key", "day", "t", "base", F.lit(None).cast("long").alias("id"), "d"))
    # RANGE frame: all events at the very moment of a row count, the parent's start included.
    upto = Window.partitionBy("key", "day").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("open", F.col("base") + F.sum("d").over(upto)).where(F.col("id").isNotNull() & (F.col("open") <= 0)).select("id", "key", "t")


def find_orphans(child: References, parent: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Groups]:
    """Orphans of one reference as (child_table, child_id, period), and the verdicts they come from.

    child.rows: id, key, t; parent: key, since, until (null: stands for good). Rows without a key refer to nothing and are
    no case. A row without a time is an orphan of the null period, since nothing can be shown to stand then; a parent
    without a start never stands. Repeated rows each count; an empty parent makes every reference an orphan; further
    columns of either table are not read.
    """
    rows = child.rows.where(F.col("key").isNotNull()).withColumn("day", F.to_date("t"))
    groups = _judge(rows, parent, hot_rows)
    live = groups.verdicts.where("verdict = 'live'").select("key", "day")
    mixed = groups.verdicts.where("verdict = 'mixed'").select("key", "day", "base")
    heavy = bounded(groups.heavy)
    # The live groups of heavy keys are few (a key has a group per day) and broadcast, those of all others are shuffled.
    loud = rows.join(heavy, "key", "left_semi").join(bounded(cut(live.join(heavy, "key", "left_semi"))), ["key", "day"], "left_anti")
    quiet = rows.join(heavy, "key", "left_anti").join(live.join(heavy, "key", "left_anti"), ["key", "day"], "left_anti")
    left = cut(loud.unionByName(quiet).join(mixed, ["key", "day"], "left"))
    late = _mixed(left.where(F.col("base").isNotNull()), groups.events, mixed)
    found = left.where(F.col("base").isNull()).select("id", "key", "t").unionByName(late)
    return found.select(F.lit(child.table).alias("child_table"), F.col("id").alias("child_id"), F.date_format("t", "yyyy-MM").alias("period")), groups


def orphan_report(child: References, parent: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per table and month: references and orphans among them (child_table, period, n_refs, n_orphans).

    Whole groups are counted from the pre-aggregate; only the rows of mixed groups are looked at one by one.
    """
    rows = child.rows.where(F.col("key").isNotNull()).withColumn("day", F.to_date("t"))
    groups = _judge(rows, parent, hot_rows)
    mixed = groups.verdicts.where("verdict = 'mixed'").select("key", "day", "base")
    late = _mixed(rows.join(mixed, ["key", "day"]), groups.events, mixed)
    period = F.date_format("day", "yyyy-MM").alias("period")
    counted = groups.verdicts.select(period, F.col("n").alias("refs"), F.when(F.col("verdict") == "orphan", F.col("n")).otherwise(0).alias("lost"))
    single = late.select(F.date_format("t", "yyyy-MM").alias("period"), F.lit(0).cast("long").alias("refs"), F.lit(1).cast("long").alias("lost"))
    total = counted.unionByName(single).groupBy("period").agg(F.sum("refs").alias("n_refs"), F.sum("lost").alias("n_orphans"))
    return total.select(F.lit(child.table).alias("child_table"), "period", "n_refs", "n_orphans")
