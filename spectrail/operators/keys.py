"""Schemas, null-safe joins and ordered de-duplication: the rules that every step shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in their order: cast where df has them (a value that can't be cast is null), else null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that both sides have, in the order of the left one."""
    other = set(right.columns)
    return [c for c in left.columns if c in other]


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join on columns of the same name in which null matches null; each key column comes out once."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on])
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full", "outer", "full_outer"):
        joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in on})
    return joined.drop(*[f"__r_{c}" for c in on])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Null-safe join on all columns that both sides have."""
    return null_safe_join(left, right, shared_columns(left, right), how)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order, which should end in columns that leave no tie. Null is a key like others."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def union_all(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def join_new_columns(left: DataFrame, right: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Left join on the required keys and on those optional ones that have a value in common, adding only new columns, one right row per key."""
    both = [c for c in optional if c in left.columns and c in right.columns]
    keys = list(required)
    for c in both:
        if not left.select(c).where(F.col(c).isNotNull()).join(right.select(c).distinct(), c, "left_semi").isEmpty():
            keys.append(c)
    new = [c for c in right.columns if c not in left.columns]
    one = first_row(right.select(*keys, *new), keys, [F.col(c).asc_nulls_last() for c in new] or [F.lit(0)])
    return null_safe_join(left, one, keys)
