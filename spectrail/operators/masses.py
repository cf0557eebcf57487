"""Annotation by mass: edges between features, hypotheses of ions and their match with a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.adducts import ELECTRON
from spectrail.operators.graph import connected_components, peer_support
from spectrail.operators.intervals import Tolerance, gap_cluster, range_join
from spectrail.operators.keys import first_row, union_all
from spectrail.session import cut

#: Order in which sources of a hypothesis are trusted.
SOURCES = ["preassigned", "pair", "evidence", "cluster", "loss", "multi", "baseline"]


def delta_edges(pairs: DataFrame, deltas: DataFrame, width: float = 1.0) -> DataFrame:
    """Pairs whose range of mass differences holds a known one: pairs' columns and those of deltas (distance and labels), distinct."""
    return range_join(deltas, pairs, "distance", "delta_min", "delta_max", width).distinct()


def library_matches(candidates: DataFrame, library: DataFrame, ppm: float, dalton: float) -> DataFrame:
    """Candidates (mass) with each library mass (exact_mass) within the wider window that also keeps both limits; adds error_mz."""
    window = Tolerance(ppm, dalton, "max").window(F.col("exact_mass"))
    ranged = library.select("exact_mass").where("exact_mass > 0").distinct().select("exact_mass", (F.col("exact_mass") - window).alias("value_min"), (F.col("exact_mass") + window).alias("value_max"))
    met = range_join(candidates, ranged, "mass", "value_min", "value_max", max(2 * dalton, 4e-3 * ppm))
    error = F.col("exact_mass") - F.col("mass")
    met = met.withColumn("error_mz", error)
    return met.where((F.abs(error) <= dalton) & (F.abs(error) * 1e6 / F.greatest("exact_mass", "mass") <= ppm)).drop("value_min", "value_max").distinct()


def has_library_mass(df: DataFrame, mass: str, library: DataFrame, tolerance: Tolerance) -> DataFrame:
    """Rows with a library mass within the tolerance."""
    window = tolerance.window(F.col("exact_mass"))
    ranged = library.select("exact_mass").where("exact_mass > 0").distinct().select((F.col("exact_mass") - window).alias("__low"), (F.col("exact_mass") + window).alias("__high"))
    return range_join(df, ranged, mass, "__low", "__high", max(2 * tolerance.dalton, 4e-3 * tolerance.ppm), how="left_semi")


def evidence_hypotheses(features: DataFrame, adducts: DataFrame, library: DataFrame, tolerance: Tolerance, rt_gap: float, least_peers: int = 2) -> DataFrame:
    """Ion hypotheses of features that the library and their neighbours in time support.

    features: feature_id, sample, rt, mz; adducts: adduct, n_mer, z, adduct_mass, tier (a small table); library: exact_mass.
    Each feature and adduct implies a mass; those without a library mass go. Per sample and nearest library mass,
    features within rt_gap of one another form a cluster; its adducts are peers. Adducts of tier 0 need no peer, others
    need least_peers different ones.
    """
    implied = features.join(F.broadcast(adducts)).withColumn("mass", (F.abs("z") * F.col("mz") - F.col("adduct_mass") + F.col("z") * ELECTRON) / F.col("n_mer")).where("mass > 0")
    window = tolerance.window(F.col("exact_mass"))
    lib = library.select("exact_mass").where("exact_mass > 0").distinct().select("exact_mass", (F.col("exact_mass") - window).alias("__low"), (F.col("exact_mass") + window).alias("__high"))
    met = range_join(implied, lib, "mass", "__low", "__high", max(2 * tolerance.dalton, 4e-3 * tolerance.ppm))
    nearest = first_row(met, ["feature_id", "sample", "adduct"], [F.abs(F.col("mass") - F.col("exact_mass")), F.asc("exact_mass")])
    clustered = gap_cluster(nearest, ["sample", "exact_mass"], "rt", rt_gap, ["feature_id", "adduct"])
    peers = F.size(F.collect_set("adduct").over(Window.partitionBy("sample", "exact_mass", "cluster")))
    clustered = clustered.withColumn("n_peers", peers)
    return clustered.where((F.col("tier") == 0) | (F.col("n_peers") >= least_peers)).select("feature_id", "sample", "rt", "mz", "adduct", "mass", "exact_mass", "cluster", "n_peers", "tier")


def node_hypotheses(*sources: DataFrame) -> DataFrame:
    """One hypothesis per feature and adduct: the most trusted source, then the greatest support.

    Each table has feature_id, adduct, mass, source and adduct_support.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return first_row(union_all(*sources), ["feature_id", "adduct"], [rank, F.col("adduct_support").desc_nulls_last(), F.col("mass").asc_nulls_last()])


def with_support(hypotheses: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds adduct_support from the edges, 0 if none."""
    return hypotheses.drop("adduct_support").join(peer_support(edges), ["feature_id", "adduct"], "left").withColumn("adduct_support", F.coalesce("adduct_support", F.lit(0)))


def competing_labels(clusters: DataFrame, losses: DataFrame, scores: DataFrame) -> DataFrame:
    """One label for pairs that are both a cluster and a loss: the one whose hypothesis scores higher, a loss among equals.

    clusters and losses: feature_id, feature_id_dest, label; scores: feature_id, label, score.
    """
    both = union_all(clusters.withColumn("kind", F.lit("cluster")), losses.withColumn("kind", F.lit("loss")))
    scored = both.join(scores, ["feature_id", "label"], "left")
    return first_row(scored, ["feature_id", "feature_id_dest"], [F.col("score").desc_nulls_last(), F.desc("kind"), F.asc("label")])


def prune_by_support(candidates: DataFrame) -> DataFrame:
    """Drops unsupported candidates of features that have a supported one, and multimer candidates of features that have others."""
    feature = Window.partitionBy("feature_id")
    supported = F.max((F.coalesce("adduct_support", F.lit(0)) > 0).cast("int")).over(feature) == 1
    other = F.max((F.col("source") != "multi").cast("int")).over(feature) == 1
    marked = candidates.withColumn("__s", supported).withColumn("__o", other)
    return marked.where((~F.col("__s") | (F.coalesce("adduct_support", F.lit(0)) > 0)) & (~F.col("__o") | (F.col("source") != "multi"))).drop("__s", "__o")


def propagate_in_components(annotations: DataFrame, components: DataFrame, masses: DataFrame, tolerance: Tolerance) -> DataFrame:
    """Structures of a component's annotated features for its other features of the same mass.

    annotations: feature_id, structure, mass; components: feature_id, component; masses: feature_id, mass of features to
    fill. Masses meet in a range join within the component, so a large component isn't paired with itself.
    """
    known = annotations.join(components, "feature_id").select("component", "structure", F.col("mass").alias("__mass")).where("__mass IS NOT NULL").distinct()
    # Twice the window holds both ways of relating a relative limit; the exact condition follows.
    reach = 2 * tolerance.window(F.abs("__mass"))
    known = known.withColumn("__low", F.col("__mass") - reach).withColumn("__high", F.col("__mass") + reach)
    other = masses.join(annotations.select("feature_id"), "feature_id", "left_anti").join(components, "feature_id")
    width = max(4 * tolerance.dalton, 4e-6 * tolerance.ppm * 1_000)
    met = range_join(other, known, "mass", "__low", "__high", width, on=["component"], also=tolerance.holds(F.col("mass"), F.col("__mass")))
    return met.select("feature_id", "structure", "mass").distinct()


def agreeing_annotations(annotations: DataFrame, edges: DataFrame, safe: list[str]) -> DataFrame:
    """Annotations whose adduct an edge of the feature supports or whose source is safe; features that no edge touches keep all."""
    named = union_all(edges.select("feature_id", "adduct"), edges.select(F.col("feature_id_dest").alias("feature_id"), F.col("adduct_dest").alias("adduct"))).distinct()
    supported = annotations.join(named.withColumn("__edge", F.lit(True)), ["feature_id", "adduct"], "left")
    touched = named.select("feature_id").distinct().withColumn("__touched", F.lit(True))
    return supported.join(touched, "feature_id", "left").where(F.col("__edge") | F.col("source").isin(safe) | F.col("__touched").isNull()).drop("__edge", "__touched")


def component_masses(edges: DataFrame, mass: str) -> DataFrame:
    """(component, mass): the median of the masses that a component's edges imply."""
    parts = connected_components(edges, "feature_id", "feature_id_dest")
    return edges.join(parts, "feature_id").groupBy("component").agg(F.percentile(mass, 0.5).alias("mass"))


def output_edges(labelled: list[tuple[str, DataFrame]], features: DataFrame) -> DataFrame:
    """Edges of all kinds as (feature_source, feature_target, label), with a self-loop for each feature that none touches."""
    parts = [df.select(F.col("feature_id").alias("feature_source"), F.col("feature_id_dest").alias("feature_target"), F.coalesce(F.col("label"), F.lit(kind)).alias("label") if "label" in df.columns else F.lit(kind).alias("label")) for kind, df in labelled]
    edges = cut(union_all(*parts).distinct())
    touched = union_all(edges.select(F.col("feature_source").alias("feature_id")), edges.select(F.col("feature_target").alias("feature_id"))).distinct()
    alone = features.select("feature_id").distinct().join(touched, "feature_id", "left_anti")
    return edges.unionByName(alone.select(F.col("feature_id").alias("feature_source"), F.col("feature_id").alias("feature_target"), F.lit(None).cast("string").alias("label")))


def structures_of_masses(matches: DataFrame, library: DataFrame, tag: str) -> DataFrame:
    """Rows per structure of each matched mass, tagged with the library's name."""
    return matches.join(library, "exact_mass").withColumn("candidate_library", F.lit(tag)).distinct()
