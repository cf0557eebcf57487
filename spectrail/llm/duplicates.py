"""Duplicates hidden by formatting differences.

Byte-identical raw rows collapse first, with their counts, so that a cell repeated billions of times is canonicalised
once. Only the distinct survivors are brought into canonical form (ASCII ones inside the JVM, the rest in Arrow batches),
and a second grouping on the full canonical text sums the counts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spectrail.operators.skew import HOT_ROWS, hot_keys, salted_join
from spectrail.session import cut

#: Signs that part the fields of a cell.
FIELD_SIGNS = "$|;"
_JOIN = "\x1f"


def canonical_text(text: str) -> str:
    """The parts of a cell by their letters and digits alone, after compatibility composition and case folding, without repeats, in order."""
    for sign in FIELD_SIGNS[1:]:
        text = text.replace(sign, FIELD_SIGNS[0])
    parts = set()
    for part in text.split(FIELD_SIGNS[0]):
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", part).casefold())
        parts.add("".join(c for c in folded if c.isalnum()))
    return _JOIN.join(sorted(parts - {""}))


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def _canonical_ascii(c: Column) -> Column:
    parts = F.transform(F.split(F.lower(c), "[$|;]"), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), _JOIN)


def canonical_groups(df: DataFrame, scope: str, text: str, row_id: str) -> DataFrame:
    """One row per distinct raw cell that survives: scope, text, canonical, n (its rows), first (its smallest id).

    Rows with a null scope or text, and cells without any letter or digit, belong to no group.
    """
    raw = df.where(F.col(scope).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(scope).alias("scope"), F.col(text).alias("text")).agg(F.count("*").alias("n"), F.min(row_id).alias("first"))
    # One pass over the distinct cells: Python sees the text of those that aren't plain ASCII, and a null for the others.
    ascii_only = F.length("text") == F.octet_length("text")
    canonical = F.when(ascii_only, _canonical_ascii(F.col("text"))).otherwise(_canonical(F.when(~ascii_only, F.col("text"))))
    return raw.withColumn("canonical", canonical).where(F.col("canonical") != "")


def collapse_formatting(df: DataFrame, scope: str, text: str, row_id: str) -> DataFrame:
    """One record per set of copies: scope, first_id, n_copies, n_spellings; records without copies are among them.

    Copies have the same scope and the same parts in any order. Nulls in scope or text and cells without letters or digits
    have no canonical form and don't come out. An empty table gives an empty result; long cells are used whole.
    """
    g = canonical_groups(df, scope, text, row_id).groupBy("scope", "canonical")
    return g.agg(F.min("first").alias("first_id"), F.sum("n").alias("n_copies"), F.count("*").alias("n_spellings")).drop("canonical")


def find_copies(df: DataFrame, scope: str, text: str, row_id: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(first_id, id) for each row that repeats an earlier record in whatever formatting; first_id is the smallest id of its copies."""
    cells = cut(canonical_groups(df, scope, text, row_id))
    groups = cells.groupBy("scope", "canonical").agg(F.min("first").alias("first_id"), F.sum("n").alias("copies"), F.count("*").alias("spellings"))
    groups = cut(groups.where("copies > 1"))
    hot = hot_keys(groups, ["scope", "canonical"], "spellings", hot_rows)
    mapped = salted_join(cells.select("scope", "text", "canonical"), groups.select("scope", "canonical", "first_id"), ["scope", "canonical"], hot, F.hash("text"))
    hot = hot_keys(cells, ["scope", "text"], "n", hot_rows)
    rows = df.select(F.col(scope).alias("scope"), F.col(text).alias("text"), F.col(row_id).alias("id"))
    found = salted_join(rows, mapped.select("scope", "text", "first_id"), ["scope", "text"], hot, F.col("id").cast("int"))
    return found.where("id <> first_id").select("first_id", "id")
