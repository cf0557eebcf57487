"""Best representative of each duplicate group, chosen field by field.

One aggregation takes, for every attribute, the maximum of a composite (usable, source priority, time, id, value). The
maximum combines map-side, so a group that holds a third of all rows is one partial row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.session import bounded

#: Marks that stand for a missing text, compared trimmed and in lower case.
MISSING_MARKS = ["na", "n/a", "nan", "nd", "null", "none", "empty", "unknown", "notclassified"]


def usable(c: Column, kind: str) -> Column:
    """Whether a value may survive: not null, no NaN, and as text with a letter or digit and no mark for a missing value."""
    if kind in ("double", "float"):
        return c.isNotNull() & ~F.isnan(c)
    if kind == "string":
        low = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
        return c.isNotNull() & c.rlike(r"[\p{L}\p{N}]") & ~low.isin(MISSING_MARKS)
    return c.isNotNull()


def surviving_values(df: DataFrame, key: Column, row_id: str, time: str, source: str, trust: DataFrame, fields: list[str], least_rows: int = 2) -> DataFrame:
    """Per key with at least least_rows records: n_records and, for each field, the surviving value and `<field>__from`, the id of its record.

    trust: (source, rank), 1 being trusted most. Among records with a usable value the lowest rank wins, then the latest
    time, then the smallest id; a source without a rank comes after all others, a null time before all others. A field
    without any usable value is null with id -1. Rows with a null key are left out; an empty table gives an empty result.
    """
    kinds = dict(df.dtypes)
    ranks = trust.groupBy(F.col(trust.columns[0]).alias("__source")).agg(F.min(trust.columns[1]).cast("int").alias("__rank"))
    rows = df.select(key.alias("key"), F.col(row_id).alias("__id"), F.col(time).alias("__time"), F.col(source).alias("__source"), *[F.col(f).alias(f"v_{f}") for f in fields])
    rows = rows.where(F.col("key").isNotNull()).join(bounded(ranks), "__source", "left")
    order = (-F.coalesce("__rank", F.lit(2**31 - 1))).alias("trust"), F.col("__time").alias("time"), (-F.col("__id")).alias("id")
    best = [F.max(F.when(usable(F.col(f"v_{f}"), kinds[f]), F.struct(*order, F.col(f"v_{f}").alias("value")))).alias(f"b_{f}") for f in fields]
    grouped = rows.groupBy("key").agg(F.count("*").alias("n_records"), *best).where(F.col("n_records") >= least_rows)
    values = [c for f in fields for c in (F.col(f"b_{f}.value").alias(f), F.coalesce(-F.col(f"b_{f}.id"), F.lit(-1)).alias(f"{f}__from"))]
    return grouped.select("key", "n_records", *values)
