"""Annotation by mass alone: pairs in time, edges by known differences, hypotheses of ions, library matches, agreement, propagation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.operators.adducts import ELECTRON, adduct_differences, possible_losses
from spectrail.operators.features import covariance_edges, feature_pairs
from spectrail.operators.graph import assigned_states, connected_components, consistent_masses, consistent_pairs, edges_in_state
from spectrail.operators.intervals import Tolerance
from spectrail.operators.keys import union_all
from spectrail.operators.masses import (
    agreeing_annotations, competing_labels, delta_edges, evidence_hypotheses, library_matches, node_hypotheses, output_edges, propagate_in_components, prune_by_support, structures_of_masses, with_support,
)
from spectrail.session import bounded, cut


@dataclass(frozen=True)
class MassSettings:
    """Tolerances in ppm, Dalton and minutes, and adducts that every feature may be."""

    ppm: float = 10.0
    dalton: float = 0.01
    rt: float = 0.05
    baseline: tuple[str, ...] = ("[M+H]+",)
    library: str = "ms1"


def _hypothesis(df: DataFrame, feature: str, adduct: Column, mass: Column, source: str) -> DataFrame:
    return df.select(F.col(feature).alias("feature_id"), adduct.alias("adduct"), mass.alias("mass"), F.lit(source).alias("source"), F.lit(None).cast("long").alias("adduct_support"))


def implied_mass(mz: str) -> Column:
    """Mass of the molecule behind an ion of the adduct table (n_mer, z, adduct_mass)."""
    return (F.abs("z") * F.col(mz) - F.col("adduct_mass") + F.col("z") * ELECTRON) / F.col("n_mer")


def modified(adduct: Column, sign: str, label: Column) -> Column:
    """An adduct with a cluster (+) or a loss (-) right behind its molecules."""
    return F.concat(F.regexp_extract(adduct, r"^(\[\d*M)", 1), F.lit(sign), label, F.regexp_replace(adduct, r"^\[\d*M", ""))


def modifier_edges(pairs: DataFrame, clusters: DataFrame, losses: DataFrame) -> DataFrame:
    """Pairs whose difference is a cluster's or a loss's mass: feature_id, feature_id_dest, label, kind, one label a pair.

    clusters, losses: distance, label (small tables). Where both kinds fit, the label that more pairs of the feature have wins.
    """
    found = [delta_edges(pairs, t).select("feature_id", "feature_id_dest", "label").distinct() for t in (clusters, losses)]
    scores = union_all(*found).groupBy("feature_id", "label").agg(F.count("*").alias("score"))
    return competing_labels(found[0], found[1], scores).select("feature_id", "feature_id_dest", "label", "kind")


def modifier_hypotheses(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Hypotheses carried over modifier edges: the heavier feature holds a cluster more, or the lighter one has lost something.

    known: feature_id, adduct, mass of features with a hypothesis.
    """
    up = edges.where("kind = 'cluster'").join(known, "feature_id")
    down = edges.where("kind = 'loss'").join(known.withColumnRenamed("feature_id", "feature_id_dest"), "feature_id_dest")
    return _hypothesis(up, "feature_id_dest", modified(F.col("adduct"), "+", F.col("label")), F.col("mass"), "cluster").unionByName(_hypothesis(down, "feature_id", modified(F.col("adduct"), "-", F.col("label")), F.col("mass"), "loss"))


def annotate_masses(
    features: DataFrame, library: DataFrame, adducts: DataFrame, clusters: DataFrame, losses: DataFrame, settings: MassSettings = MassSettings(), intensities: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Tables annotations, edges and components.

    features: feature_id, sample, rt, mz and, if known, adduct; library: structure, exact_mass, formula; adducts: adduct,
    n_mer, z, adduct_mass, tier; clusters, losses: distance, label; intensities: feature_id, sample, intensity.

    Edges between plain ions are kept if they are supported and imply one mass per feature. Hypotheses come from these
    edges, from features' own adducts, from library masses with peers, from clusters and losses and from the baseline; one
    per feature and adduct stays, supported before unsupported. Those with a library mass become annotations if their
    edges agree and their formula allows the loss, and go to features of the same component and mass.
    """
    tolerance = Tolerance(settings.ppm, settings.dalton)
    pairs = cut(feature_pairs(features, settings.rt, settings.ppm))
    single = adducts.where("n_mer = 1 AND abs(z) = 1")
    edges = delta_edges(pairs, adduct_differences(single, settings.ppm * 1e-6 * 2_000))
    edges = consistent_pairs(edges.select("feature_id", F.col("group1").alias("adduct"), F.col("group2").alias("adduct_dest"), "feature_id_dest").distinct())
    ions = bounded(single.select("adduct", "n_mer", "z", "adduct_mass"))
    placed = edges.join(features.select("feature_id", "mz").distinct(), "feature_id").join(ions, "adduct").withColumn("mass", implied_mass("mz"))
    edges = consistent_masses(placed.select("feature_id", "adduct", "adduct_dest", "feature_id_dest", "mass"), "mass", settings.ppm, settings.dalton)
    modifiers = cut(modifier_edges(pairs, clusters, losses))

    pair = _hypothesis(edges, "feature_id", F.col("adduct"), F.col("mass"), "pair").unionByName(_hypothesis(edges, "feature_id_dest", F.col("adduct_dest"), F.col("mass"), "pair"))
    found = evidence_hypotheses(features.select("feature_id", "sample", "rt", "mz"), adducts, library, tolerance, settings.rt)
    evidence = cut(_hypothesis(found, "feature_id", F.col("adduct"), F.col("mass"), "evidence"))
    anything = bounded(ions.where(F.col("adduct").isin(*settings.baseline)))  # a handful of rows for every feature
    baseline = _hypothesis(features.select("feature_id", "mz").join(anything), "feature_id", F.col("adduct"), implied_mass("mz"), "baseline")
    own = []
    if "adduct" in features.columns:
        named = features.withColumn("adduct", F.explode(F.split("adduct", r"\s*[|/]\s*"))).join(bounded(adducts.select("adduct", "n_mer", "z", "adduct_mass")), "adduct")
        own = [_hypothesis(named, "feature_id", F.col("adduct"), implied_mass("mz"), "preassigned")]
    known = cut(node_hypotheses(pair, evidence, *own).select("feature_id", "adduct", "mass"))
    plain = edges.select("feature_id", "adduct", "feature_id_dest", "adduct_dest")
    hypotheses = node_hypotheses(pair, evidence, *own, baseline, modifier_hypotheses(known, modifiers))
    candidates = prune_by_support(with_support(hypotheses, plain))
    matched = library_matches(candidates, library, settings.ppm, settings.dalton)
    agreed = agreeing_annotations(matched, plain, ["preassigned", "evidence", "cluster", "loss"])
    structures = library.select("structure", "exact_mass", "formula").distinct()
    annotations = cut(possible_losses(structures_of_masses(agreed, structures, settings.library), "adduct", "formula"))
    components = cut(connected_components(plain, "feature_id", "feature_id_dest"))
    named = annotations.select("feature_id", "structure", F.col("exact_mass").alias("mass"))
    lost = propagate_in_components(named, components, known.select("feature_id", "mass").distinct(), tolerance)
    lost = lost.select("feature_id", "structure", "mass", F.lit("propagated").alias("source"), F.lit(settings.library).alias("candidate_library"))
    annotations = annotations.unionByName(lost, allowMissingColumns=True)

    weighted = plain.withColumn("weight", F.lit(1.0))
    kept = edges_in_state(weighted, assigned_states(weighted)).select("feature_id", "feature_id_dest", F.concat_ws(" _ ", "adduct", "adduct_dest").alias("label"))
    labelled = [("adduct", kept), ("cluster", modifiers.where("kind = 'cluster'").drop("kind")), ("loss", modifiers.where("kind = 'loss'").drop("kind"))]
    if intensities is not None:
        labelled.append(("covariance", covariance_edges(intensities, pairs).select("feature_id", "feature_id_dest")))
    return {"annotations": annotations, "edges": output_edges(labelled, features), "components": components}
