"""Ranking, filtering and consensus of annotation candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions.scalars import weighted_sum
from spectrail.operators.intervals import nearest_join, range_join
from spectrail.operators.keys import first_row

LAYER = "candidate_structure_inchikey_connectivity_layer"


def finite(c: Column) -> Column:
    """The value, null if it is no finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def rank_with_ties(c: str, keys: list[str], dense: bool = False) -> Column:
    """Rank by descending value within the keys, ties sharing it; a null has none."""
    order = Window.partitionBy(*keys).orderBy(F.col(c).desc_nulls_last())
    return F.when(F.col(c).isNotNull(), (F.dense_rank() if dense else F.rank()).over(order))


def rank_candidates(df: DataFrame, score: str = "score_weighted_chemo", initial: str = "candidate_score_pseudo_initial") -> DataFrame:
    """Adds rank_initial (dense) and rank_final (min rank); negative scores count as 0, non-finite ones as missing."""
    clean = df.withColumns({f"__{c}": F.greatest(finite(F.col(c)), F.when(F.col(c).isNotNull(), 0.0)) for c in (score, initial)})
    ranked = clean.withColumn("rank_initial", rank_with_ties(f"__{initial}", ["feature_id"], dense=True)).withColumn("rank_final", rank_with_ties(f"__{score}", ["feature_id"]))
    return ranked.drop(f"__{score}", f"__{initial}")


def best_per_structure(df: DataFrame, score: str, tie: list[str]) -> DataFrame:
    """One row per feature and structure: the highest score, then the tie columns."""
    return first_row(df, ["feature_id", LAYER], [F.col(score).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie]])


def combine_scores(bio: DataFrame, chemo: DataFrame, weights: tuple[float, float, float] = (0.4, 0.2, 0.3)) -> DataFrame:
    """Narrow join of both score tables on feature and structure with score_final (weights: biological, chemical, spectral)."""
    joined = bio.join(chemo, ["feature_id", LAYER])
    parts = [F.col(c) for c in ("score_biological", "score_chemical", "candidate_score_pseudo_initial")]
    return joined.withColumn("score_final", weighted_sum(parts, list(weights)))


def filter_ms1(df: DataFrame, least_bio: float, least_chem: float, condition: str = "OR") -> DataFrame:
    """Keeps spectral matches; candidates by mass alone need their biological or (and) chemical score."""
    bio, chem = F.col("score_biological") >= least_bio, F.col("score_chemical") >= least_chem
    return df.where(F.col("candidate_score_similarity").isNotNull() | ((bio | chem) if condition == "OR" else (bio & chem)))


def percentile_keep(df: DataFrame, keys: list[str], score: str, part: float) -> DataFrame:
    """Rows of at least that part of their group's highest score; rows of rank 1 and promoted ones always."""
    df = df.withColumn("__best", F.max(score).over(Window.partitionBy(*keys)))
    keep = F.col(score) >= part * F.col("__best")
    for c, always in (("rank_final", F.col("rank_final") == 1), ("promoted", F.col("promoted"))):
        keep = keep | always if c in df.columns else keep
    return df.where(keep).drop("__best")


def cap_ties(df: DataFrame, most: int, evidence: list[Column], tie: str) -> DataFrame:
    """At most `most` rows of each tied group (feature, adduct, rank), the best evidence first, with a note; untied rows stay. A note that a row has is kept before that one."""
    keys = ["feature_id", "candidate_adduct", "rank_final"]
    group = Window.partitionBy(*keys)
    counted = df.withColumn("__size", F.count("*").over(group)).withColumn("__n", F.row_number().over(group.orderBy(*evidence, tie)))
    note = F.when(F.col("__size") > most, F.concat(F.lit(f"Sampled {most} of "), F.col("__size"), F.lit(" tied candidates")))
    note = F.coalesce("annotation_note", note) if "annotation_note" in df.columns else note
    return counted.where(F.col("__n") <= most).withColumn("annotation_note", note).drop("__size", "__n")


#: Notes on candidates that other features of the same compound speak for.
PROMOTED_NOTE = "Promoted to rank 1: cluster entity consensus (same M across component)"
ANCHOR_NOTE = "Kept candidate matching best-supported InChIKey from sibling feature with same neutral mass (different adduct)"


def promote_anchors(df: DataFrame, components: DataFrame, digits: int = 4) -> DataFrame:
    """Aligns the features of one compound: rank_final anew where another feature's structure is better backed; adds promoted and annotation_note.

    df: feature_id, structure layer, rank_final, score_weighted_chemo, candidate_structure_exact_mass (else neutral_mass),
    candidate_score_similarity and candidate_score_sirius_confidence; components: feature_id, component_id. Per component
    and rounded mass the first-ranked row with the best evidence (a spectrum, then the score) is the anchor. Where it is a
    candidate of a feature whose first rank is another structure without a spectrum, it becomes the first of that mass
    and the others follow in their order. Null masses and features outside all components stay as they are.
    """
    one = components.groupBy("feature_id").agg(F.min("component_id").alias("__c"))
    mass = F.bround(F.coalesce("candidate_structure_exact_mass", "neutral_mass"), digits)
    spectrum = F.col("candidate_score_similarity").isNotNull() | (F.coalesce("candidate_score_sirius_confidence", F.lit(0.0)) > 0)
    rows = df.join(one, "feature_id", "left").withColumn("__m", mass).withColumn("__ms2", spectrum)
    first = (F.col("rank_final") == 1) & F.col("__c").isNotNull() & F.col("__m").isNotNull() & F.col(LAYER).isNotNull()
    best = F.min(F.struct((~F.col("__ms2")).alias("a"), (-F.col("score_weighted_chemo")).alias("b"), F.col("feature_id").alias("f"), F.col(LAYER).alias("l"))).alias("x")
    anchors = rows.where(first).groupBy("__c", "__m").agg(best).select("__c", "__m", F.col("x.f").alias("__f"), F.col("x.l").alias("__l"))
    rows = rows.join(anchors, ["__c", "__m"], "left").withColumn("__is", F.coalesce(F.col(LAYER) == F.col("__l"), F.lit(False)))
    group = Window.partitionBy("feature_id", "__c", "__m")
    rows = rows.withColumn("__in", F.max("__is").over(group))
    other = F.col("__in") & (F.col("rank_final") == 1) & ~F.col("__ms2") & ~F.col("__is")
    rows = rows.withColumn("__turn", F.col("__in") & F.coalesce(F.max(other).over(Window.partitionBy("feature_id")), F.lit(False)))
    anew = F.row_number().over(group.orderBy(F.desc("__is"), F.col("rank_final").asc_nulls_last(), F.col(LAYER)))
    rows = rows.withColumn("rank_final", F.when(F.col("__turn"), anew).otherwise(F.col("rank_final")).cast("int"))
    promoted = F.coalesce(F.col("__is") & (F.col("rank_final") == 1) & (F.col("feature_id") != F.col("__f")), F.lit(False))
    rows = rows.withColumn("promoted", promoted).withColumn("annotation_note", F.when(promoted, F.lit(PROMOTED_NOTE)))
    return rows.withColumnRenamed("__c", "component_id").drop("__m", "__ms2", "__f", "__l", "__is", "__in", "__turn")


def collapse_to_anchors(df: DataFrame, mass: float = 0.005, rt: float = 0.15) -> DataFrame:
    """Tied groups (feature, adduct, rank) in which some rows match an anchor keep only those: adds annotation_note to them.

    An anchor is the only row of its group, of rank 1, in another feature, with the same structure and nearly the same
    neutral_mass and, if it has one, rt.
    """
    group = Window.partitionBy("feature_id", "candidate_adduct", "rank_final")
    rows = df.withColumn("__size", F.count("*").over(group))
    known = rows.where(F.col(LAYER).isNotNull() & F.col("neutral_mass").isNotNull())
    ends = known.select("candidate_id", F.col(LAYER).alias("structure"), "feature_id", F.col("neutral_mass").alias("mass"), "rt", "rank_final", "__size")
    matched = match_anchors(ends.where("__size > 1"), ends.where("rank_final = 1 AND __size = 1"), mass, rt).select("feature_id", F.col("structure").alias(LAYER), "candidate_id", F.lit(True).alias("__hit")).distinct()
    rows = rows.join(matched, ["feature_id", LAYER, "candidate_id"], "left").withColumn("__any", F.max(F.coalesce("__hit", F.lit(False))).over(group))
    note = F.when(F.col("__hit"), F.lit(ANCHOR_NOTE)).otherwise(F.col("annotation_note") if "annotation_note" in df.columns else F.lit(None).cast("string"))
    return rows.where(~F.col("__any") | F.coalesce("__hit", F.lit(False))).withColumn("annotation_note", note).drop("__size", "__hit", "__any")


#: Marks of a class that isn't known.
NO_CLASS = ["", "notClassified", "empty", "N/A", "null"]


def mini_labels(df: DataFrame, levels: dict[str, float], prefix: str = "candidate_structure_tax") -> DataFrame:
    """One class label per feature and system: (feature_id, has_inchikey, label_classyfire, score_classyfire, label_npclassifier, score_npclassifier).

    The structure's label is the deepest known class of the highest-scored candidate that has one; the predicted one is of
    the level with the highest product of score and level weight (the deeper of equals). The structure's label stands,
    without a score, if its candidate scores at least as high; else the predicted one.
    """
    out = df.groupBy("feature_id").agg(F.max(F.col(LAYER).isNotNull()).alias("has_inchikey"))
    for system, name in (("cla", "classyfire"), ("npc", "npclassifier")):
        deep = [x for x in sorted((x for x in levels if x.startswith(system)), reverse=True)]
        if not deep:
            out = out.withColumn(f"label_{name}", F.lit(None).cast("string")).withColumn(f"score_{name}", F.lit(None).cast("double"))
            continue
        own = F.coalesce(*[F.when(~F.trim(F.col(f"{prefix}_{x}")).isin(NO_CLASS), F.trim(F.col(f"{prefix}_{x}"))) for x in deep])
        score = F.col("score_weighted_chemo")
        said = [F.when(F.col(f"feature_pred_tax_{x}_val").isNotNull() & (F.col(f"feature_pred_tax_{x}_val") != "notClassified"), F.col(f"feature_pred_tax_{x}_score") * levels[x]) for x in deep]
        top = F.greatest(*said, F.lit(None).cast("double"))
        label = F.coalesce(*[F.when(w == top, F.col(f"feature_pred_tax_{x}_val")) for x, w in zip(deep, said, strict=True)])
        per = df.select("feature_id", own.alias("own"), score.alias("s"), label.alias("said"), top.alias("top"))
        best = per.groupBy("feature_id").agg(
            F.min(F.when(F.col("own").isNotNull(), F.struct(F.isnull("s").alias("a"), (-F.col("s")).alias("b"), F.col("own").alias("l"), F.col("s")))).alias("o"),
            F.min(F.when(F.col("said").isNotNull(), F.struct((-F.col("top")).alias("b"), F.col("said").alias("l"), F.col("top").alias("s")))).alias("p"),
        )
        first = F.coalesce(F.col("o.s") >= F.col("p.s"), F.col("p").isNull())
        best = best.select("feature_id", F.when(first, F.col("o.l")).otherwise(F.col("p.l")).alias(f"label_{name}"), F.when(~first, F.col("p.s")).alias(f"score_{name}"))
        out = out.join(best, "feature_id", "left")
    return out


@dataclass(frozen=True)
class Evidence:
    """Limits for results of high evidence."""

    biological: float = 0.8
    initial: float = 0.9
    final: float = 0.75
    rt_error: float = 0.15
    fingerprint: float = 0.4
    similarity: float = 0.4
    one_sided: float = 0.8
    peaks: int = 2


def high_evidence(df: DataFrame, limits: Evidence = Evidence()) -> DataFrame:
    """Candidates with a high score, a small retention-time error and enough spectral evidence, where these are known at all. Absent columns are unknown."""

    def get(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast("double")

    score = (get("score_biological") >= limits.biological) | (get("candidate_score_pseudo_initial") >= limits.initial) | (get("score_weighted_chemo") >= limits.final)
    rt = get("candidate_structure_error_rt").isNull() | (F.abs(get("candidate_structure_error_rt")) <= limits.rt_error)
    sirius, similarity = get("candidate_score_sirius_confidence"), get("candidate_score_similarity")
    sides = F.coalesce(get("candidate_score_similarity_forward") >= limits.one_sided, F.lit(False)) | F.coalesce(get("candidate_score_similarity_reverse") >= limits.one_sided, F.lit(False))
    spectral = (sirius.isNull() & similarity.isNull()) | (sirius >= limits.fingerprint) | (similarity >= limits.similarity) | sides
    peaks = get("candidate_count_similarity_peaks_matched")
    return df.where(score & rt & spectral & (peaks.isNull() | (peaks >= limits.peaks)))


def cluster_consensus(df: DataFrame, digits: int = 4) -> DataFrame:
    """Aligns the first ranks of features of one compound: adds anchor_structure, promoted and rank_consensus.

    df: component_id, mass, feature_id, structure, rank_final, score, ms2 (whether a spectrum backs it). Per component and
    rounded mass the best first-ranked row, those with a spectrum first, is the anchor; in other features of the group that
    have no spectrum its structure moves to rank 1 and the others follow in their order.
    """
    df = df.withColumn("mass_key", F.bround("mass", digits))
    group = ["component_id", "mass_key"]
    anchors = first_row(df.where("rank_final = 1 AND component_id IS NOT NULL AND mass_key IS NOT NULL"), group, [F.desc("ms2"), F.col("score").desc_nulls_last(), F.asc("feature_id"), F.asc("structure")])
    anchors = anchors.select(*group, F.col("structure").alias("anchor_structure"), F.col("feature_id").alias("anchor_feature"))
    joined = df.join(anchors, group, "left")
    no_spectrum = ~F.max("ms2").over(Window.partitionBy("feature_id"))
    promoted = F.coalesce((F.col("structure") == F.col("anchor_structure")) & (F.col("feature_id") != F.col("anchor_feature")) & no_spectrum, F.lit(False))
    order = Window.partitionBy("feature_id").orderBy(F.desc("promoted"), F.col("rank_final").asc_nulls_last(), "structure")
    return joined.withColumn("promoted", promoted).withColumn("rank_consensus", F.row_number().over(order)).drop("anchor_feature")


def summarize(df: DataFrame, key: str, order: list[Column], collapse: list[str], drop_ties: str | None = None) -> DataFrame:
    """One row per key: the first in order, with the listed columns' distinct values joined over all its rows.

    drop_ties: a rank column; keys with several rows of rank 1 are left out.
    """
    from spectrail.functions.scalars import collapse_sorted

    if drop_ties:
        tied = df.where(F.col(drop_ties) == 1).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
        df = df.join(tied, key, "left_anti")
    joined = df.groupBy(key).agg(*[collapse_sorted(F.col(c).cast("string")).alias(c) for c in collapse])
    return first_row(df, [key], order).drop(*collapse).join(joined, key)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """df without the columns that hold nothing but nulls, found by one aggregation."""
    held = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if held[c]])


def merge_sources(spectral: DataFrame, fingerprint: DataFrame, formula: DataFrame) -> DataFrame:
    """Best spectral row per feature and structure, full-joined with the best fingerprint row, left-joined with the best formula row of each (feature, formula)."""
    keys = ["feature_id", LAYER]
    a = first_row(spectral, keys, [F.col("candidate_score_similarity").desc_nulls_last(), F.col("candidate_library").asc_nulls_last(), F.col("molecular_formula").asc_nulls_last()])
    b = first_row(fingerprint, keys, [F.col("candidate_score_sirius_csi").desc_nulls_last(), F.col("molecular_formula").asc_nulls_last()]).withColumnRenamed("molecular_formula", "__formula")
    both = a.join(b, keys, "full").withColumn("molecular_formula", F.coalesce("molecular_formula", "__formula")).drop("__formula")
    c = first_row(formula, ["feature_id", "molecular_formula"], [F.col("candidate_score_zodiac").desc_nulls_last()])
    return both.join(c, ["feature_id", "molecular_formula"], "left")


def without_redundant_ms1(ms1: DataFrame, spectral: DataFrame, least_similarity: float = 0.3, least_peaks: int = 2) -> DataFrame:
    """Spectral rows and those candidates by mass alone whose feature and structure no good spectral row has (an unknown similarity or peak count is good)."""

    def good(c: str, least: float) -> Column:
        return F.col(c).isNull() | (F.col(c) >= least) if c in spectral.columns else F.lit(True)

    keys = spectral.where(good("candidate_score_similarity", least_similarity) & good("candidate_count_similarity_peaks_matched", least_peaks)).select("feature_id", LAYER).distinct()
    return spectral.unionByName(ms1.join(keys, ["feature_id", LAYER], "left_anti"), allowMissingColumns=True)


def best_rt_match(df: DataFrame, library: DataFrame, tie: list[str]) -> DataFrame:
    """Adds candidate_structure_error_rt, the smallest difference to the library's times of the structure; null without any. No limit applies.

    df: feature_id, rt, structure layer, candidate_library; library: structure layer, rt. Each row meets the nearest time
    alone, not all of its structure. Of two equally near times the lower one counts, of equal rows the first by tie.
    """
    near = nearest_join(df.where(F.col(LAYER).isNotNull()), library.where("rt IS NOT NULL").select(LAYER, F.col("rt").alias("__rt")), "rt", "__rt", 1.0, on=[LAYER])
    near = near.unionByName(df.where(F.col(LAYER).isNull()).withColumn("nearest", F.lit(None).cast("double"))).withColumn("candidate_structure_error_rt", F.col("rt") - F.col("nearest"))
    return first_row(near, ["feature_id", LAYER, "candidate_library"], [F.abs("candidate_structure_error_rt").asc_nulls_last(), F.col("nearest").asc_nulls_last(), *[F.asc(c) for c in tie]]).drop("nearest")


def match_anchors(df: DataFrame, anchors: DataFrame, mass: float = 0.005, rt: float = 0.15) -> DataFrame:
    """Rows with an anchor of another feature and the same structure, of nearly the same mass and, if the anchor has one, time.

    df and anchors: structure, feature_id, mass, rt. Masses meet in a range join within the structure.
    """
    a = anchors.select("structure", F.col("feature_id").alias("__f"), (F.col("mass") - mass).alias("__low"), (F.col("mass") + mass).alias("__high"), F.col("rt").alias("__rt")).distinct()
    also = (F.col("feature_id") != F.col("__f")) & (F.col("__rt").isNull() | (F.abs(F.col("rt") - F.col("__rt")) <= rt))
    return range_join(df, a, "mass", "__low", "__high", 2 * mass, on=["structure"], how="left_semi", also=also)


def adduct_semantics(annotations: DataFrame, states: DataFrame, ppm: float, dalton: float) -> DataFrame:
    """Keeps annotations that agree with their feature's strongest ion state, by its key or by neutral mass, with the way in which they do.

    annotations: feature_id, state_key, neutral_mass; states: feature_id, state_key, neutral_mass, support. Features without a state keep all.
    """
    best = first_row(states, ["feature_id"], [F.col("support").desc_nulls_last(), F.asc("state_key")]).select("feature_id", F.col("state_key").alias("__key"), F.col("neutral_mass").alias("__mass"))
    joined = annotations.join(best, "feature_id", "left")
    apart = F.abs(F.col("neutral_mass") - F.col("__mass"))
    mode = (
        F.when(F.col("__key").isNull(), "precursor_mz")
        .when(F.col("state_key") == F.col("__key"), "exact_adduct")
        .when((apart <= dalton) | (apart * 1e6 / F.greatest("neutral_mass", "__mass") <= ppm), "m_delta_rescued")
    )
    return joined.withColumn("adduct_match_mode", mode).where("adduct_match_mode IS NOT NULL").drop("__key", "__mass")


def coverage_report(annotations: DataFrame, classes: str, feature: str, order: list[Column]) -> DataFrame:
    """(class, any, best, any_percent, best_percent): features that have a class at all, and as their first row."""
    total = annotations.agg(F.countDistinct(feature).alias("n"))
    any_ = annotations.groupBy(F.col(classes).alias("class")).agg(F.countDistinct(feature).alias("any"))
    best = first_row(annotations, [feature], order).groupBy(F.col(classes).alias("class")).agg(F.count("*").alias("best"))
    joined = any_.join(best, any_["class"].eqNullSafe(best["class"]), "left").select(any_["class"], "any", F.coalesce("best", F.lit(0)).cast("long").alias("best"))
    percent = lambda c: F.round(100 * F.col(c) / F.col("n"), 1)
    return joined.crossJoin(F.broadcast(total)).select("class", "any", "best", percent("any").alias("any_percent"), percent("best").alias("best_percent"))


def evaluate_predictions(predictions: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Counts and Matthews correlation for the first k candidates: (k, tp, fp, fn, tn, hit_rate, mcc).

    predictions: query, structure, rank; truth: query, structure (null: not in the library). A query counts as a hit if its
    structure is among its first k, as a false positive if it has candidates but no structure or another one.
    """
    grid = truth.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    best = truth.withColumnRenamed("structure", "__truth").join(predictions, "query", "left")
    per = best.groupBy("query", "__truth").agg(F.min("rank").alias("any"), F.min(F.when(F.col("structure") == F.col("__truth"), F.col("rank"))).alias("at"))
    per = per.join(F.broadcast(grid))
    hit, some = F.coalesce(F.col("at") <= F.col("k"), F.lit(False)), F.coalesce(F.col("any") <= F.col("k"), F.lit(False))
    known = F.col("__truth").isNotNull()
    kinds = {"tp": known & hit, "fp": some & ~hit, "fn": known & ~some, "tn": ~known & ~some}
    counts = per.groupBy("k").agg(*[F.sum(c.cast("long")).alias(n) for n, c in kinds.items()], F.sum(known.cast("long")).alias("n_known"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in kinds)
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(bottom == 0, 0.0).otherwise((tp * tn - fp * fn) / bottom)
    return counts.select("k", *kinds, F.when(F.col("n_known") > 0, tp / F.col("n_known")).alias("hit_rate"), mcc.alias("mcc"))
