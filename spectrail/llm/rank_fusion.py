"""One ranking from several differently scaled scores: robust rank aggregation.

Each score of an item becomes its normalised rank within the group (1/n is best; ties share the worst rank; a missing
score ranks last), so no scale can dominate. The sorted ranks are held against the order statistics of uniform ranks
(beta distribution); the smallest probability, corrected for the number of scores, is the item's significance, and items
are ranked by it.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, counts_above, hot_keys, salted_join
from spectrail.session import bounded, cut

#: Stands for a missing score: below every value.
LOWEST = float("-inf")
#: Items whose champion is chosen in one task.
DUEL_ROWS = 1_000


def order_statistic(x: Column, k: int, m: int) -> Column:
    """Probability that the k-th smallest of m uniform numbers is at most x: the beta distribution (k, m - k + 1)."""
    terms = [F.lit(comb(m, i)) * F.pow(x, F.lit(i)) * F.pow(1 - x, F.lit(m - i)) for i in range(k, m + 1)]
    return sum(terms[1:], terms[0])


def significance(ranks: list[Column]) -> Column:
    """The corrected minimum of the order-statistic probabilities of an item's normalised ranks, to 12 digits (so that rounding errors part no ties)."""
    m, ordered = len(ranks), F.array_sort(F.array(*ranks))
    return F.round(F.least(F.lit(1.0), m * F.least(*[order_statistic(ordered[k], k + 1, m) for k in range(m)])), 12)


def _worst_rank(items: DataFrame, score: str, hot: DataFrame, hot_rows: int) -> DataFrame:
    """Adds the number of items of the group that aren't lower in score, for hot groups."""
    values = items.groupBy("g", score).agg(F.count("*").alias("n"))
    values = cut(counts_above(values, ["g"], score, "n", hot))
    crowded = hot_keys(values, ["g", score], "n", hot_rows)
    ranks = values.select("g", score, (F.col("__above") + F.col("n")).alias(f"w_{score}"))
    return salted_join(items, ranks, ["g", score], crowded, F.hash("item"))


def rank_items(items: DataFrame, scores: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """items (g, item, one column per score, null or NaN where missing) with size, r_<score>, rho and rank; and the hot groups.

    rank is 1 for the most significant items of a group; equally significant items share it. No group is sorted in one task
    if it has more than hot_rows items. Items must be distinct within their group; an empty table gives an empty result.
    """
    filled = [F.when(F.col(s).isNull() | F.isnan(s), LOWEST).otherwise(F.col(s)).alias(s) for s in scores]
    items = cut(items.select("g", "item", *filled))
    sizes = items.groupBy("g").agg(F.count("*").alias("size"))
    hot = hot_keys(sizes, ["g"], "size", hot_rows)
    flags = bounded(hot.select("g"))
    group = Window.partitionBy("g")
    light = items.join(flags, "g", "left_anti").withColumn("size", F.count("*").over(group))
    light = light.withColumns({f"w_{s}": F.col("size") - F.rank().over(group.orderBy(s)) + 1 for s in scores})
    all_items = light
    if not hot.isEmpty():
        heavy = items.join(flags, "g", "left_semi")
        for s in scores:
            heavy = _worst_rank(heavy, s, hot.select("g"), hot_rows)
        heavy = heavy.join(bounded(cut(sizes.join(flags, "g", "left_semi"))), "g")
        all_items = light.unionByName(heavy.select(*light.columns))
    ranked = all_items.withColumns({f"r_{s}": F.col(f"w_{s}") / F.col("size") for s in scores}).drop(*[f"w_{s}" for s in scores])
    ranked = ranked.withColumn("rho", significance([F.col(f"r_{s}") for s in scores]))
    first = ranked.join(flags, "g", "left_anti").withColumn("rank", F.rank().over(group.orderBy("rho")))
    if not hot.isEmpty():
        heavy = cut(ranked.join(flags, "g", "left_semi").withColumn("merit", -F.col("rho")))
        levels = cut(counts_above(heavy.groupBy("g", "merit").agg(F.count("*").alias("n")), ["g"], "merit", "n", hot.select("g")))
        crowded = hot_keys(levels, ["g", "merit"], "n", hot_rows)
        placed = salted_join(heavy, levels.select("g", "merit", (F.col("__above") + 1).alias("rank")), ["g", "merit"], crowded, F.hash("item"))
        first = first.unionByName(placed.select(*first.columns))
    return first, hot


def _beats(x: Column, y: Column, scores: list[str], wins: int) -> Column:
    return sum((x[s] > y[s]).cast("int") for s in scores) >= wins


def undisputed_firsts(items: DataFrame, scores: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(g, item): the item of a group of two or more that is strictly higher than each other one in most of the scores.

    It follows the ranking: an item that wins most scores against each of the n - 1 others has at least
    (n - 1) * majority strict wins, so its normalised ranks can't sum to more than m - (n - 1) * majority / n. The items
    within that bound, few in a group, meet in duels whose winner stays (an undisputed first wins every duel, so it is the
    last one left); a check against all items of the group confirms it. Neither step compares all pairs.
    """
    m = len(scores)
    wins = m // 2 + 1
    ranked, hot = rank_items(items, scores, hot_rows)
    ranked = cut(ranked.select("g", "item", "size", *scores, *[f"r_{s}" for s in scores]))
    bound = m - wins * (F.col("size") - 1) / F.col("size") + 1e-9
    fit = ranked.where((F.col("size") > 1) & (sum(F.col(f"r_{s}") for s in scores) <= bound)).select("g", F.struct("item", *scores).alias("x"))

    def duel(array: Column) -> Column:
        return F.reduce(array, array[0], lambda champion, x: F.when(_beats(x, champion, scores, wins), x).otherwise(champion))

    most = ranked.agg(F.max("size")).first()[0] or 0
    while most > DUEL_ROWS:  # each level leaves one champion for about so many items of a group
        part = F.pmod(F.xxhash64("x"), F.lit(-(-most // DUEL_ROWS)))
        fit = fit.groupBy("g", part.alias("part")).agg(duel(F.collect_list("x")).alias("x")).drop("part")
        most = -(-most // DUEL_ROWS)
    champions = cut(fit.groupBy("g").agg(duel(F.collect_list("x")).alias("c")))
    own = salted_join(ranked.select("g", F.struct("item", *scores).alias("x"), "size"), champions, ["g"], hot, F.hash("x"))
    beaten = own.groupBy("g").agg(F.max("size").alias("size"), F.max("c.item").alias("item"), F.sum(_beats(F.col("c"), F.col("x"), scores, wins).cast("int")).alias("beaten"))
    return beaten.where(F.col("beaten") == F.col("size") - 1).select("g", "item")
