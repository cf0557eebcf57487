"""Column functions shared by the steps: sentinels, weighted sums, collapsing and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that stand for a missing or unclassified text.
NOT_CLASSIFIED, UNKNOWN, NOT_CONSISTENT = "notClassified", "ND", "notConsistent"
#: Texts that are read as null.
NULL_TEXTS = ["", "NA", "N/A", "null", "NaN"]
#: Separator of several values in one cell.
MANY = " $ "


def text_or_null(c: Column) -> Column:
    """A trimmed text, null if it is blank or a mark for null."""
    t = F.trim(c)
    return F.when(~t.isin(NULL_TEXTS), t)


def weighted_sum(values: list[Column], weights: list[float]) -> Column:
    """Weighted mean over all weights, a missing value counting as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, weights, strict=True)]) / sum(weights)


def sigmoid(x: Column, shift: float = 100.0, scale: float = 20.0) -> Column:
    """A fingerprint score on the scale 0 to 1."""
    return 1 / (1 + F.exp(-(x + shift) / scale))


def pseudo_initial(similarity: Column, confidence: Column) -> Column:
    """Mean of the spectral and the fingerprint score if there are both, else the one there is."""
    return F.when(similarity.isNotNull() & confidence.isNotNull(), (similarity + confidence) / 2).otherwise(F.coalesce(similarity, confidence))


def collapse_sorted(c: Column) -> Column:
    """Aggregate: distinct non-blank values in order, joined; null if there is none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c)))), MANY), F.lit(""))


def collapse_first_seen(order: Column, c: Column) -> Column:
    """Aggregate: distinct non-blank values in the order of their first occurrence, joined; null if there is none."""
    pairs = F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct(order.alias("o"), F.trim(c).alias("v")))))
    return F.nullif(F.array_join(F.array_distinct(F.transform(pairs, lambda x: x["v"])), MANY), F.lit(""))


def collapse_names(c: Column) -> Column:
    """Aggregate: names that are distinct without regard to case, each in its first form by order, joined."""
    names = F.array_sort(F.collect_set(F.nullif(F.trim(c), F.lit(""))))
    kept = F.filter(names, lambda x, i: ~F.exists(F.slice(names, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.nullif(F.array_join(kept, MANY), F.lit(""))


def chemont_id(c: Column) -> Column:
    """CHEMONTID: and seven digits, from any form that ends in a number."""
    digits = F.regexp_extract(c, r"(\d+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("CHEMONTID:"), F.lpad(digits, 7, "0")))


def no_stereo_key(c: Column) -> Column:
    """Connectivity layer and protonation mark of an InChIKey."""
    return F.concat(F.substring(c, 1, 14), F.lit("-"), F.right(c, F.lit(1)))


def reliability_to_score(c: Column) -> Column:
    """Identification levels 1 to 4 on the scale 1 to 0.25; another number as it is."""
    levels = F.when(c == "1", 1.0).when(c == "2", 0.75).when(c == "3", 0.5).when(c == "4", 0.25)
    return F.coalesce(levels, c.try_cast("double"))


def score_to_reliability(c: Column) -> Column:
    """The identification level of a score; 4 if there is none."""
    return F.when(c >= 1, "1").when(c >= 0.75, "2").when(c >= 0.5, "3").otherwise("4")


def charge_of_adduct(c: Column) -> Column:
    """Signed charge of an adduct text such as [M+2H]2+."""
    number = F.regexp_extract(c, r"\](\d*)[+-]$", 1)
    sign = F.when(c.endswith("-"), -1).when(c.endswith("+"), 1)
    return sign * F.when(number == "", 1).otherwise(number.try_cast("int"))


def round_even(c: Column, digits: int = 5) -> Column:
    """Rounding with halves to the even neighbour."""
    return F.bround(c, digits)


def contains_pattern(text: Column, pattern: Column) -> Column:
    """Whether the text holds a match of the pattern; a pattern of letters, digits and blanks alone is searched for as it is."""
    plain = pattern.rlike(r"^[\p{L}\p{N} _-]*$")
    return F.when(plain, F.contains(text, pattern)).otherwise(F.regexp_like(text, F.when(plain, F.lit("")).otherwise(pattern)))
