"""Biological and chemical evidence: rank matches, neighbours' votes and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions.scalars import NOT_CLASSIFIED, NOT_CONSISTENT, UNKNOWN, contains_pattern
from spectrail.operators.keys import null_safe_join
from spectrail.session import bounded, cut

#: Ranks from the widest to the narrowest, with the score of a match.
BIO_RANKS = {"01domain": 0.1, "02kingdom": 0.2, "03phylum": 0.3, "04class": 0.4, "05order": 0.5, "06family": 0.6, "07tribe": 0.7, "08genus": 0.8, "09species": 0.9, "10varietas": 1.0}
#: Score of a candidate whose organism is all life.
BIOTA, BIOTA_SCORE = "Biota", 1.007276
#: Classes of two systems from the widest to the narrowest, with the score of a match.
CHEM_LEVELS = {"cla_01kin": 0.142857, "npc_01pat": 0.285714, "cla_02sup": 0.428571, "npc_02sup": 0.571429, "cla_03cla": 0.714286, "npc_03cla": 0.857143, "cla_04dirpar": 1.0}


def rank_score(candidate: str, sample: str, ranks: dict[str, float], collapsed: bool) -> Column:
    """The highest score of the ranks at which the candidate's name matches the sample's.

    collapsed: the sample cell may hold several names, so the candidate's name is searched for in it. Unclassified and unknown match nothing.
    """

    def at(rank: str) -> Column:
        c, s = F.col(f"{candidate}_{rank}"), F.col(f"{sample}_{rank}")
        named = c.isNotNull() & s.isNotNull() & (c != NOT_CLASSIFIED) & (s != UNKNOWN)
        return F.when(named & (contains_pattern(s, c) if collapsed else c == s), ranks[rank])

    return F.greatest(*[at(r) for r in ranks])


def biological_scores(pairs: DataFrame, samples: DataFrame, organisms: DataFrame, ranks: dict[str, float] | None = None, collapsed: bool = False) -> DataFrame:
    """(structure, sample_organism_name, score_biological, closest): the best match of a structure's organisms with each sample organism.

    pairs: structure, organism_name; samples: structure, sample_organism_name and its ranks as sample_<rank>; organisms:
    organism_name and candidate_<rank>. Distinct names are matched, not rows. Equal scores go to the wider rank's name.
    """
    ranks = ranks or BIO_RANKS
    wanted = samples.select("structure", "sample_organism_name").where("sample_organism_name IS NOT NULL AND structure IS NOT NULL").distinct()
    met = cut(wanted.join(pairs.select("structure", "organism_name").where("organism_name IS NOT NULL").distinct(), "structure"))
    known = samples.select("sample_organism_name", *[f"sample_{r}" for r in ranks]).where("sample_organism_name IS NOT NULL").dropDuplicates(["sample_organism_name"])
    couples = met.select("sample_organism_name", "organism_name").distinct()
    scored = couples.join(bounded(organisms), "organism_name").join(bounded(known), "sample_organism_name")
    score = F.when(F.col("candidate_01domain") == BIOTA, BIOTA_SCORE).otherwise(rank_score("candidate", "sample", ranks, collapsed))
    scored = scored.withColumn("score_biological", score)
    closest = reduce(lambda w, r: w.when(F.col("score_biological") == ranks[r], F.col(f"candidate_{r}")), ranks, F.when(F.col("candidate_01domain") == BIOTA, F.lit(BIOTA)))
    scored = scored.select("sample_organism_name", "organism_name", "score_biological", closest.alias("closest")).where("closest IS NOT NULL")
    best = met.join(scored, ["sample_organism_name", "organism_name"]).groupBy("structure", "sample_organism_name")
    best = best.agg(F.max(F.struct("score_biological", "closest")).alias("b"))
    return best.select("structure", "sample_organism_name", "b.score_biological", "b.closest")


def voting_edges(edges: DataFrame, least_neighbours: int = 2, least_entropy: float = 0.0) -> DataFrame:
    """Distinct edges that may vote: no self-loops, with entropy or a label, from sources with enough neighbours."""
    voiced = F.col("feature_spectrum_entropy").cast("double") > least_entropy
    if "label" in edges.columns:
        voiced = voiced | F.col("label").isNotNull()
    kept = edges.where((F.col("feature_source") != F.col("feature_target")) & voiced).select("feature_source", "feature_target").distinct()
    many = kept.groupBy("feature_source").agg(F.count("*").alias("n")).where(F.col("n") >= least_neighbours).select("feature_source")
    return kept.join(many, "feature_source", "left_semi")


def neighbour_votes(edges: DataFrame, annotations: DataFrame, score: str, levels: list[str], prefix: str = "candidate_structure_tax", least: float = 0.0) -> DataFrame:
    """The class that a feature's neighbours agree on, per level: (feature_source, level, val, consistency, score).

    consistency is the part of the annotated neighbours with that class; it is multiplied by the feature's own best score
    for the class. The highest product wins (nulls last, then the class by name); below `least` the class is not consistent.
    All levels are counted in one pass over the edges.
    """
    annotated = annotations.select(F.col("feature_id").alias("feature_target")).distinct()
    totals = edges.join(annotated, "feature_target").groupBy("feature_source").agg(F.countDistinct("feature_target").alias("n_targets"))
    long = annotations.select("feature_id", F.col(score).alias("s"), *[F.col(f"{prefix}_{x}").alias(x) for x in levels]).unpivot(["feature_id", "s"], levels, "level", "val")
    own = cut(long.where("val IS NOT NULL").groupBy("feature_id", "level", "val").agg(F.max("s").alias("s")))
    counts = edges.join(own.withColumnRenamed("feature_id", "feature_target"), "feature_target").groupBy("feature_source", "level", "val").agg(F.count("*").alias("n"))
    votes = counts.join(totals, "feature_source").withColumn("consistency", F.col("n") / F.col("n_targets"))
    votes = votes.join(own.withColumnRenamed("feature_id", "feature_source"), ["feature_source", "level", "val"], "left").withColumn("score", F.col("consistency") * F.col("s"))
    order = F.struct(F.isnull("score").alias("a"), (-F.col("score")).alias("b"), F.col("val"), F.col("consistency"), F.col("score"))
    best = votes.groupBy("feature_source", "level").agg(F.min(order).alias("x")).select("feature_source", "level", "x.val", "x.consistency", "x.score")
    kept = F.when(F.col("score").isNull(), None).when(F.col("score") >= least, F.col("val")).otherwise(NOT_CONSISTENT)
    return best.select("feature_source", "level", kept.alias("val"), "consistency", "score")


def predicted_classes(votes: DataFrame, levels: list[str]) -> DataFrame:
    """Votes as one row per feature: feature_id, feature_pred_tax_<level>_val and _score."""
    wide = votes.groupBy("feature_source").pivot("level", levels).agg(F.first("val").alias("val"), F.first("score").alias("score"))
    return wide.select(F.col("feature_source").alias("feature_id"), *[F.col(f"{x}_{k}").alias(f"feature_pred_tax_{x}_{k}") for x in levels for k in ("val", "score")])


def chemical_scores(annotations: DataFrame, levels: dict[str, float] | None = None, prefix: str = "candidate_structure_tax") -> DataFrame:
    """Adds score_chemical: the highest weight of the levels at which the candidate's class is found in the predicted one, 0 if there is none.

    Distinct class tuples are matched and joined back, nulls matching nulls.
    """
    levels = levels or CHEM_LEVELS
    columns = [c for x in levels for c in (f"{prefix}_{x}", f"feature_pred_tax_{x}_val")]
    tuples = annotations.select(*columns).distinct()

    def at(x: str) -> Column:
        c, p = F.col(f"{prefix}_{x}"), F.col(f"feature_pred_tax_{x}_val")
        return F.when(c.isNotNull() & p.isNotNull() & (c != NOT_CLASSIFIED) & contains_pattern(p, c), levels[x])

    scored = tuples.withColumn("score_chemical", F.greatest(*[at(x) for x in levels], F.lit(0.0)))
    return null_safe_join(annotations, scored, columns)


def organism_lookup(pairs: DataFrame, organisms: DataFrame, wanted: DataFrame) -> DataFrame:
    """References of the organisms under a taxon: (structure, taxon, references).

    wanted: structure, taxon. Rank columns of organisms are turned to rows and reduced to the wanted taxa before any join.
    """
    taxa = wanted.select("taxon").where("taxon IS NOT NULL").distinct()
    ranks = [c for c in organisms.columns if c != "organism_name"]
    long = organisms.unpivot(["organism_name"], ranks, "rank", "taxon").where("taxon IS NOT NULL").select("organism_name", "taxon").distinct().join(bounded(cut(taxa)), "taxon", "left_semi")
    rows = pairs.where("reference IS NOT NULL").join(long, "organism_name").join(wanted.distinct(), ["structure", "taxon"], "left_semi")
    return rows.groupBy("structure", "taxon").agg(F.array_join(F.array_sort(F.collect_set("reference")), " $ ").alias("references"))


def label_levels(candidates: DataFrame, levels: list[str], structure_score: str, prefix: str = "candidate_structure_tax") -> DataFrame:
    """Per feature and level the label of the best structure or the predicted one, whichever scores higher: adds label_<level> and label_<level>_score."""
    out = candidates
    for x in levels:
        own, predicted = F.col(f"{prefix}_{x}"), F.col(f"feature_pred_tax_{x}_val")
        own_score = F.when(own.isNotNull(), F.col(structure_score))
        other = F.when(predicted.isNotNull() & ~predicted.isin(NOT_CONSISTENT, "empty"), F.col(f"feature_pred_tax_{x}_score"))
        first = F.coalesce(own_score >= other, own_score.isNotNull())
        out = out.withColumn(f"label_{x}", F.when(first, own).when(other.isNotNull(), predicted)).withColumn(f"label_{x}_score", F.greatest(own_score, other))
    return out
