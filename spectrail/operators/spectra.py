"""Spectra: cleaning, entropy, similarity and similarity edges.

A spectrum is array<struct<mz, intensity>>. What can be said with array functions stays in the JVM; kernels with a state
run on Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from spectrail.operators.intervals import Tolerance, ranges_hit
from spectrail.session import cut

PEAK = StructType([StructField("mz", DoubleType()), StructField("intensity", DoubleType())])
PEAKS = ArrayType(PEAK)
SCORE = StructType([StructField("score", DoubleType()), StructField("matches", IntegerType()), StructField("forward", DoubleType()), StructField("reverse", DoubleType())])
#: Added to every tolerance: the square root of the spacing of doubles at 1.
EPSILON = sqrt(2.0**-52)

#: Pairs of spectra that one task compares.
PAIRS_A_TASK = 20_000

Peaks = list[tuple[float, float]]


def total(peaks: Column) -> Column:
    """Sum of the intensities."""
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"])


def entropy(peaks: Column) -> Column:
    """Shannon entropy of the intensities; null without any intensity."""
    positive = F.filter(peaks, lambda p: p["intensity"] > 0)
    t = total(positive)
    return F.when(t > 0, F.log(t) - F.aggregate(positive, F.lit(0.0), lambda a, p: a + p["intensity"] * F.log(p["intensity"])) / t)


def usable_peaks(peaks: Column) -> Column:
    """Peaks with finite positive values, by m/z."""
    return F.array_sort(F.filter(peaks, lambda p: (p["mz"] > 0) & (p["intensity"] > 0) & ~F.isnan(p["mz"]) & ~F.isnan(p["intensity"]) & (p["mz"] < float("inf")) & (p["intensity"] < float("inf"))))


def is_sanitized(peaks: Column, dalton: float, ppm: float) -> Column:
    """Whether peaks are finite, positive, in order and further apart than the tolerance."""
    after = F.slice(peaks, F.lit(2), F.greatest(F.size(peaks) - 1, F.lit(0)))
    gaps = F.zip_with(F.slice(peaks, F.lit(1), F.greatest(F.size(peaks) - 1, F.lit(0))), after, lambda a, b: b["mz"] - a["mz"] > F.greatest(F.lit(dalton), b["mz"] * (ppm * 1e-6)))
    return (F.size(usable_peaks(peaks)) == F.size(peaks)) & F.forall(gaps, lambda x: x)


def merged_peaks(peaks: Peaks, dalton: float, ppm: float) -> Peaks:
    """Peaks in order, neighbours within the tolerance merged into one at their intensity-weighted m/z."""
    out: Peaks = []
    for mz, intensity in sorted((float(m), float(i)) for m, i in peaks if m > 0 and 0 < i < float("inf") and m < float("inf")):
        if out and mz - out[-1][0] <= max(dalton, mz * ppm * 1e-6):
            m, i = out[-1]
            out[-1] = ((m * i + mz * intensity) / (i + intensity), i + intensity)
        else:
            out.append((mz, intensity))
    return out


def _tuples(peaks) -> Peaks:
    return [(p["mz"], p["intensity"]) for p in peaks if p["mz"] is not None and p["intensity"] is not None] if peaks is not None else []


def sanitize(peaks: Column, dalton: float = 0.01, ppm: float = 10.0) -> Column:
    """Finite positive peaks in order, those within the tolerance merged; empty for null."""

    @F.pandas_udf(PEAKS)
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda x: [{"mz": m, "intensity": i} for m, i in merged_peaks(_tuples(x), dalton, ppm)])

    return clean(peaks)


def dynamic_cutoff(intensities: np.ndarray) -> float:
    """Median minus twice the median deviation of the intensities if that is positive, else their 5th percentile."""
    middle = np.median(intensities)
    low = middle - 2 * 1.4826 * np.median(np.abs(intensities - middle))
    return float(low if low > 0 else np.percentile(intensities, 5))


def cleaned_peaks(peaks: Peaks, cutoff: float | None, precursor: float | None, dalton: float) -> Peaks:
    """Finite positive peaks in order from the cut-off on, without repeated noise values and what lies from the precursor on, scaled to a sum of 1."""
    kept = sorted((m, i) for m, i in peaks if 0 < m < float("inf") and 0 < i < float("inf"))
    if not kept:
        return []
    limit = dynamic_cutoff(np.array([i for _, i in kept])) if cutoff is None else cutoff
    kept = [(m, i) for m, i in kept if i >= limit]
    times = Counter(i for _, i in kept)
    noise = {i for i in sorted(i for _, i in kept)[:10] if times[i] > 5}
    kept = [(m, i) for m, i in kept if i not in noise and (precursor is None or m < precursor - dalton)]
    scale = sum(i for _, i in kept)
    return [(m, i / scale) for m, i in kept]


def clean_spectra(df: DataFrame, peaks: str, cutoff: float | None = None, least: int = 1, precursor: str | None = None, dalton: float = 0.01) -> DataFrame:
    """Spectra without noise, scaled to a sum of 1 and with at least `least` peaks.

    Peaks below the cut-off (dynamic if none is given) go, as do values that repeat more than five times among the ten
    smallest, and peaks from the precursor on if its column is named. Null spectra are dropped.
    """

    @F.pandas_udf(PEAKS)
    def clean(column: pd.Series, end: pd.Series) -> pd.Series:
        ends = (None if pd.isna(x) else float(x) for x in end)
        return pd.Series([[{"mz": m, "intensity": i} for m, i in cleaned_peaks(_tuples(x), cutoff, e, dalton)] for x, e in zip(column, ends, strict=True)])

    cleaned = df.where(F.col(peaks).isNotNull()).withColumn(peaks, clean(peaks, F.col(precursor).cast("double") if precursor else F.lit(None).cast("double")))
    return cleaned.where(F.size(peaks) >= least)


def _closest(x: Peaks, y: Peaks, shift: float, dalton: float, ppm: float) -> dict[int, int]:
    """For each peak of x the peak of y that has it as its closest within the tolerance; the nearer y wins a shared x."""
    found: dict[int, int] = {}
    moved = [m + shift for m, _ in x]
    reach = [dalton + ppm * abs(m) * 1e-6 + EPSILON for m in moved]
    start = 0
    for j, (mz, _) in enumerate(y):
        while start < len(x) and moved[start] + reach[start] < mz:
            start += 1
        best, apart = -1, float("inf")
        for i in range(start, len(x)):
            if moved[i] - reach[i] > mz:
                break
            d = abs(moved[i] - mz)
            if d <= reach[i] and d < apart:
                best, apart = i, d
        if best >= 0 and (best not in found or apart < abs(moved[best] - y[found[best]][0])):
            found[best] = j
    return found


def _best_matching(weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs with the greatest total weight, each side used once; by augmenting along the best alternating path."""
    match_x: dict[int, int] = {}
    match_y: dict[int, int] = {}
    near: dict[int, list[int]] = {}
    for i, j in weights:
        near.setdefault(i, []).append(j)
    while True:
        # Longest path in the residual graph by relaxation; a free x begins, and any x reached back through a pair may end it unmatched.
        gain = {i: 0.0 for i in near if i not in match_x}
        came: dict[int, int] = {}
        via: dict[int, float] = {}
        for _ in range(len(near) + 1):
            changed = False
            for i in list(gain):
                for j in near[i]:
                    g = gain[i] + weights[i, j]
                    if match_x.get(i) != j and g > via.get(j, float("-inf")) + 1e-15:
                        via[j], came[j], changed = g, i, True
                        if j in match_y:
                            k = match_y[j]
                            gain[k] = g - weights[k, j]
            if not changed:
                break
        ends = [(g, ("y", j)) for j, g in via.items() if j not in match_y] + [(g, ("x", i)) for i, g in gain.items() if i in match_x]
        best = max(ends, default=(0.0, None))
        if best[1] is None or best[0] <= 1e-15:
            return sorted(match_x.items())
        kind, at = best[1]
        if kind == "x":
            j = match_x.pop(at)
            del match_y[j]
            at = j
        while True:
            i = came[at]
            before = match_x.get(i)
            match_x[i], match_y[at] = at, i
            if before is None:
                break
            at = before


def _best_pairs(weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs with the greatest total weight, each side used once.

    Where no peak has more than two partners, as it is and moved, the pairs form chains, and along a chain the best choice
    of edges that don't touch comes by going along once; anything else goes to the general search.
    """
    near: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for i, j in weights:
        near.setdefault(("x", i), []).append((i, j))
        near.setdefault(("y", j), []).append((i, j))
    if max(map(len, near.values()), default=0) > 2:
        return _best_matching(weights)
    left, chosen = set(weights), []
    for end in [n for n, edges in near.items() if len(edges) == 1]:
        chain, at = [], end
        while (edge := next((e for e in near[at] if e in left), None)) is not None:
            left.discard(edge)
            chain.append(edge)
            at = ("y", edge[1]) if at[0] == "x" else ("x", edge[0])
        sums = [0.0, 0.0]
        for e in chain:
            sums.append(max(sums[-1], sums[-2] + weights[e]))
        k = len(chain)
        while k > 0:
            if sums[k + 1] > sums[k]:
                chosen.append(chain[k - 1])
                k -= 2
            else:
                k -= 1
    return chosen + (_best_matching({e: weights[e] for e in left}) if left else [])


def shifted_cosine(x: Peaks, y: Peaks, x_precursor: float, y_precursor: float, dalton: float, ppm: float) -> tuple[float, int, float, float]:
    """Similarity of two spectra whose peaks may be moved by the difference of their precursors: (score, matches, forward, reverse).

    Peaks pair with their closest one, as they are or moved; of the possible pairs those with the greatest sum of
    square-rooted intensity products count. forward and reverse are the parts of both spectra's intensity that is matched.
    """
    sx, sy = sum(i for _, i in x), sum(i for _, i in y)
    if sx <= 0 or sy <= 0:
        return 0.0, 0, 0.0, 0.0
    pairs = set(_closest(x, y, 0.0, dalton, ppm).items())
    shift = y_precursor - x_precursor
    if abs(shift) > dalton:
        pairs |= set(_closest(x, y, shift, dalton, ppm).items())
    weights = {(i, j): sqrt(x[i][1] * y[j][1] / (sx * sy)) for i, j in pairs}
    best: dict[int, tuple[float, int]] = {}
    for (i, j), w in weights.items():
        best[i] = max(best.get(i, (-1.0, -1)), (w, -j))
    chosen = [(i, -j) for i, (_, j) in sorted(best.items())]
    if len({j for _, j in chosen}) < len(chosen):
        chosen = _best_pairs(weights)
    return sum(weights[p] for p in chosen), len(chosen), sum(x[i][1] for i, _ in chosen) / sx, sum(y[j][1] for _, j in chosen) / sy


def joined_peaks(x: Peaks, y: Peaks, x_precursor: float, y_precursor: float, dalton: float, ppm: float) -> list[tuple[int | None, int | None]]:
    """Outer join of two spectra's peaks by their places: all pairs, as they are or moved by the precursors' difference, then what is left of x and of y."""
    pairs = set(_closest(x, y, 0.0, dalton, ppm).items())
    shift = y_precursor - x_precursor
    if abs(shift) > dalton:
        pairs |= set(_closest(x, y, shift, dalton, ppm).items())
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    return [*sorted(pairs), *((i, None) for i in range(len(x)) if i not in left), *((None, j) for j in range(len(y)) if j not in right)]


def aligned_score(rows: list[tuple[float | None, float | None, float | None, float | None]]) -> tuple[float, int]:
    """(score, matches) of peaks that are joined already: rows (m/z, intensity) of x and of y, None on the side that has no peak.

    Equal m/z on a side are one peak; of the pairs those with the greatest sum of square-rooted intensity products count.
    """
    x = {m: i for m, i, _, _ in reversed(rows) if m is not None}
    y = {m: i for _, _, m, i in reversed(rows) if m is not None}
    sx, sy = sum(x.values()), sum(y.values())
    if sx <= 0 or sy <= 0:
        return 0.0, 0
    at, to = {m: k for k, m in enumerate(sorted(x))}, {m: k for k, m in enumerate(sorted(y))}
    weights: dict[tuple[int, int], float] = {}
    for a, i, b, j in rows:
        if a is not None and b is not None:
            pair = at[a], to[b]
            weights[pair] = max(weights.get(pair, 0.0), sqrt(i * j / (sx * sy)))
    chosen = _best_pairs(weights) if weights else []
    return sum(weights[p] for p in chosen), len(chosen)


def aligned_cosine(x: Column, y: Column) -> Column:
    """Cosine of square-rooted intensities of spectra whose peaks lie at the same places, in the JVM."""
    products = F.zip_with(x, y, lambda p, q: F.sqrt(p["intensity"] * q["intensity"]))
    return F.aggregate(products, F.lit(0.0), lambda a, v: a + v) / F.sqrt(total(x) * total(y))


def entropy_similarity(x: Peaks, y: Peaks, dalton: float, ppm: float) -> float:
    """1 minus the entropy gained by mixing two spectra, over its greatest value; spectra of low entropy are evened out first."""

    def evened(peaks: Peaks) -> Peaks:
        s = sum(i for _, i in peaks)
        e = -sum(i / s * log(i / s) for _, i in peaks)
        if e < 3:
            peaks = [(m, i ** (0.25 + e * 0.25)) for m, i in peaks]
            s = sum(i for _, i in peaks)
        return [(m, i / s) for m, i in peaks]

    if not x or not y:
        return 0.0
    x, y = evened(x), evened(y)
    gained, i, j = 0.0, 0, 0
    flog = lambda v: v * log(v) if v > 0 else 0.0
    while i < len(x) and j < len(y):
        apart, reach = x[i][0] - y[j][0], max(dalton, ppm * x[i][0] * 1e-6)
        if abs(apart) <= reach:
            a, b = x[i][1], y[j][1]
            gained += flog(a + b) - flog(a) - flog(b)
            i, j = i + 1, j + 1
        elif apart < 0:
            i += 1
        else:
            j += 1
    return max(0.0, min(1.0, gained / log(4)))


def similarity(method: str, dalton: float = 0.01, ppm: float = 10.0):
    """A function of (peaks, peaks, precursor, precursor) that gives struct<score, matches, forward, reverse>. method: gnps or cosine (one kernel), or entropy."""
    if method not in ("gnps", "cosine", "entropy"):
        raise ValueError(f"unknown method {method}")

    @F.pandas_udf(SCORE)
    def kernel(x: pd.Series, y: pd.Series, px: pd.Series, py: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, p, q in zip(x, y, px, py, strict=True):
            u, v = _tuples(a), _tuples(b)
            if method == "entropy":
                rows.append((entropy_similarity(u, v, dalton, ppm), matched_peaks([m for m, _ in u], [m for m, _ in v], dalton, ppm), None, None))
            else:
                rows.append(shifted_cosine(u, v, p, q, dalton, ppm))
        return pd.DataFrame(rows, columns=["score", "matches", "forward", "reverse"])

    return kernel


def matched_peaks(x: list[float], y: list[float], dalton: float, ppm: float) -> int:
    """Peaks of x with a peak of y within the tolerance. Both in order."""
    n, j = 0, 0
    for mz in x:
        reach = max(dalton, ppm * mz * 1e-6)
        while j < len(y) and y[j] < mz - reach:
            j += 1
        n += j < len(y) and y[j] <= mz + reach
    return n


def _needed_keys(keys: DataFrame, threshold: float) -> DataFrame:
    """Per spectrum the rarest of its keys, so many that peaks with any of the others can't reach the threshold.

    keys: feature_id, b, k (the key), p (the peak), i (its share of the intensity). A score is at most the root of the
    share of intensity that pairs, so two spectra that share none of these rare keys stay below the threshold.
    """
    counts = keys.groupBy("b", "k").agg(F.countDistinct("feature_id").alias("n"))
    ranked = keys.join(counts, ["b", "k"])
    order = F.struct("n", "b", "k")
    last = ranked.groupBy("feature_id", "p").agg(F.max(order).alias("last"), F.first("i").alias("i"))
    # The keys in order of rarity; what all peaks that end later could still add.
    own = Window.partitionBy("feature_id").orderBy(F.desc("last")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = last.withColumn("__later", F.sum("i").over(own))
    limit = reach.where(F.col("__later") >= threshold**2 * (1 - 1e-9)).groupBy("feature_id").agg(F.max("last").alias("limit"))
    return ranked.join(limit, "feature_id").where(order <= F.col("limit")).select("feature_id", "b", "k").distinct()


def similarity_edges(spectra: DataFrame, method: str = "gnps", threshold: float = 0.0, least_matches: int = 1, dalton: float = 0.01, ppm: float = 10.0) -> DataFrame:
    """Edges between similar spectra: (feature_source, feature_target, candidate_score_similarity, matches), the smaller id first.

    spectra: feature_id, precursor_mz, peaks. Only pairs that could score above the threshold are compared: they share a
    peak, or a loss from the precursor, within the tolerance, found by a bucket join; for the cosine kernels it must be one
    of the rare ones without which the threshold is out of reach, so a peak that all spectra have forms no pairs. No pair
    is lost. Spectra without peaks have no edges.
    """
    width = max(dalton, 1e-6 * ppm * 2_000) * 2 + 2 * EPSILON
    share = F.transform("peaks", lambda p: p["intensity"] / total(F.col("peaks")))
    peaks = spectra.where(F.size("peaks") > 0).select("feature_id", "precursor_mz", F.posexplode(F.arrays_zip(F.transform("peaks", lambda p: p["mz"]).alias("mz"), share.alias("i"))).alias("p", "x"))
    places = [("x.mz", 0)] if method == "entropy" else [("x.mz", 0), ("precursor_mz - x.mz", 1)]
    each = [F.struct((F.floor(F.expr(v) / width) + step).alias("b"), F.lit(k).alias("k")) for v, k in places for step in (0, 1)]
    keys = peaks.select("feature_id", "p", F.col("x.i").alias("i"), F.explode(F.array(*each)).alias("e")).select("feature_id", "p", "i", "e.b", "e.k")
    keys = _needed_keys(cut(keys), threshold) if threshold > 0 and method != "entropy" else keys.select("feature_id", "b", "k").distinct()
    keys = cut(keys)
    pairs = keys.withColumnRenamed("feature_id", "feature_source").join(keys.withColumnRenamed("feature_id", "feature_target"), ["b", "k"]).where("feature_source < feature_target").select("feature_source", "feature_target").distinct()
    a = spectra.select(F.col("feature_id").alias("feature_source"), F.col("peaks").alias("pa"), F.col("precursor_mz").alias("ma"))
    b = spectra.select(F.col("feature_id").alias("feature_target"), F.col("peaks").alias("pb"), F.col("precursor_mz").alias("mb"))
    # Comparing costs far more than a pair's few bytes suggest, so the number of tasks follows the pairs.
    pairs = cut(pairs)
    tasks = max(2 * spectra.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS_A_TASK)
    scored = pairs.join(a, "feature_source").join(b, "feature_target").repartition(tasks).withColumn("s", similarity(method, dalton, ppm)("pa", "pb", "ma", "mb"))
    found = scored.select("feature_source", "feature_target", F.col("s.score").alias("candidate_score_similarity"), F.col("s.matches").alias("matches"))
    return found.where((F.col("candidate_score_similarity") > threshold) & (F.col("matches") >= least_matches))


def with_isolated(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Edges and a self-loop for each feature that none of them touches."""
    touched = edges.select(F.col("feature_source").alias("feature_id")).unionByName(edges.select(F.col("feature_target").alias("feature_id"))).distinct()
    alone = features.select("feature_id").distinct().join(touched, "feature_id", "left_anti")
    return edges.unionByName(alone.select(F.col("feature_id").alias("feature_source"), F.col("feature_id").alias("feature_target")), allowMissingColumns=True)


def score_histogram(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """(bin, n): how many scores between 0 and 1 fall into each bin; 1 belongs to the last one."""
    return df.where(F.col(score).isNotNull()).groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def reduce_library(library: DataFrame, queries: DataFrame, tolerance: Tolerance) -> DataFrame:
    """Library rows with a query in their window, by precursor m/z or, if both tables have neutral_mass, by that. library and queries have precursor_mz."""
    width = max(2 * tolerance.dalton, 2e-6 * tolerance.ppm * 1_000)

    def hit(column: str) -> DataFrame:
        reach = tolerance.window(F.col(column))
        ranged = library.withColumn("__low", F.col(column) - reach).withColumn("__high", F.col(column) + reach)
        return ranges_hit(ranged, queries, column, "__low", "__high", width).drop("__low", "__high")

    if "neutral_mass" not in library.columns or "neutral_mass" not in queries.columns:
        return hit("precursor_mz")
    return hit("precursor_mz").unionByName(hit("neutral_mass")).dropDuplicates()


def annotate_spectra(queries: DataFrame, library: DataFrame, tolerance: Tolerance, threshold: float, method: str = "gnps") -> DataFrame:
    """Best library match of each query spectrum and structure above the threshold.

    queries: feature_id, precursor_mz, peaks, adduct; library: spectrum_id, structure, precursor_mz, peaks, adduct. Spectra
    meet by precursor m/z and, if both tables have neutral_mass, by that too, as ions of one molecule: such a pair is
    compared without moved peaks. The mode is exact_adduct for equal adducts, m_delta_rescued for pairs that only the
    mass brought together, else precursor_mz. As in the output model, candidate_adduct is the query's adduct and
    candidate_query_adduct the library's. Empty spectra match nothing.
    """
    from spectrail.operators.intervals import range_join
    from spectrail.operators.keys import first_row

    width = max(2 * tolerance.dalton, 2e-6 * tolerance.ppm * 1_000)
    kernel = similarity(method, tolerance.dalton, tolerance.ppm)
    there = F.size("peaks") > 0

    def met(column: str, otherwise: str) -> DataFrame:
        reach = tolerance.window(F.col(column))
        lib = library.where(there).select("spectrum_id", "structure", F.col("adduct").alias("candidate_query_adduct"), F.col("peaks").alias("lib_peaks"), F.col(column).alias("lib_mz"), (F.col(column) - reach).alias("low"), (F.col(column) + reach).alias("high"))
        q = queries.where(there).select("feature_id", F.col("adduct").alias("candidate_adduct"), "peaks", F.col(column).alias("own_mz"))
        pairs = range_join(q, lib, "own_mz", "low", "high", width).withColumn("s", kernel("peaks", "lib_peaks", "own_mz", "lib_mz"))
        mode = F.when(F.col("candidate_adduct") == F.col("candidate_query_adduct"), "exact_adduct").otherwise(otherwise)
        return pairs.where(F.col("s.score") >= threshold).withColumn("candidate_adduct_match_mode", mode)

    found = met("precursor_mz", "precursor_mz")
    if "neutral_mass" in queries.columns and "neutral_mass" in library.columns:
        found = found.unionByName(met("neutral_mass", "m_delta_rescued"))
    good = found.select("feature_id", "structure", "spectrum_id", "candidate_adduct", "candidate_query_adduct", "candidate_adduct_match_mode", F.col("s.score").alias("candidate_score_similarity"), F.col("s.forward").alias("candidate_score_similarity_forward"), F.col("s.reverse").alias("candidate_score_similarity_reverse"), F.col("s.matches").alias("candidate_count_similarity_peaks_matched"))
    return first_row(good, ["feature_id", "structure"], [F.desc("candidate_score_similarity"), F.desc("candidate_count_similarity_peaks_matched"), F.asc("spectrum_id"), F.asc("candidate_adduct_match_mode")])


def combine_replicates(spectra: DataFrame, dalton: float = 0.01, ppm: float = 10.0) -> DataFrame:
    """One spectrum per feature_id: all its peaks, merged; the smallest precursor m/z stands."""
    gathered = spectra.groupBy("feature_id").agg(F.min("precursor_mz").alias("precursor_mz"), F.flatten(F.collect_list("peaks")).alias("peaks"))
    return gathered.withColumn("peaks", sanitize(F.col("peaks"), dalton, ppm))


def packed_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair (i, j) of n items, numbered from 1, in a packed lower triangle."""
    low, high = F.least(i, j), F.greatest(i, j)
    return n * (low - 1) - F.floor(low * (low - 1) / 2) + high - low


