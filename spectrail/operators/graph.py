"""Feature networks: support, consistency, components and communities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.session import bounded, cut


def both_directions(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(a, b) and (b, a) of each edge."""
    return edges.select(F.col(source).alias("a"), F.col(target).alias("b")).unionByName(edges.select(F.col(target).alias("a"), F.col(source).alias("b")))


def peer_support(edges: DataFrame) -> DataFrame:
    """Number of distinct neighbours that support each feature's adduct: (feature_id, adduct, adduct_support).

    edges: feature_id, adduct, feature_id_dest, adduct_dest; null is a neighbour and an adduct like others.
    """
    src = edges.select("feature_id", "adduct", F.col("feature_id_dest").alias("neighbor"))
    dest = edges.select(F.col("feature_id_dest").alias("feature_id"), F.col("adduct_dest").alias("adduct"), F.col("feature_id").alias("neighbor"))
    return src.unionByName(dest).distinct().groupBy("feature_id", "adduct").agg(F.count("*").alias("adduct_support"))


def consistent_pairs(edges: DataFrame, least_support: int = 2, least_degree: int = 3) -> DataFrame:
    """Edges whose adducts are unambiguous or supported.

    A pair with several hypotheses, or with an end of at least least_degree neighbours, needs an end whose adduct is
    supported by least_support neighbours.
    """
    from spectrail.operators.keys import null_safe_join

    support = peer_support(edges)
    pairs = edges.groupBy("feature_id", "feature_id_dest").agg(F.count("*").alias("hypotheses"))
    ends = both_directions(edges, "feature_id", "feature_id_dest").distinct().groupBy("a").agg(F.count("*").alias("degree"))
    scored = null_safe_join(edges, pairs, ["feature_id", "feature_id_dest"])
    scored = null_safe_join(scored, support.withColumnRenamed("adduct_support", "src_support"), ["feature_id", "adduct"])
    scored = null_safe_join(scored, support.select(F.col("feature_id").alias("feature_id_dest"), F.col("adduct").alias("adduct_dest"), F.col("adduct_support").alias("dest_support")), ["feature_id_dest", "adduct_dest"])
    scored = null_safe_join(scored, ends.select(F.col("a").alias("feature_id"), F.col("degree").alias("src_degree")), ["feature_id"])
    scored = null_safe_join(scored, ends.select(F.col("a").alias("feature_id_dest"), F.col("degree").alias("dest_degree")), ["feature_id_dest"])
    doubtful = (F.col("hypotheses") > 1) | (F.col("src_degree") >= least_degree) | (F.col("dest_degree") >= least_degree)
    kept = scored.where(~doubtful | (F.col("src_support") >= least_support) | (F.col("dest_support") >= least_support))
    return kept.select("feature_id", "adduct", "adduct_dest", "feature_id_dest").distinct()


#: Edges that are few enough for one task to find their components.
ONE_TASK_EDGES = 200_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, p) of the ends of a few edges (u, v): the least end that each is linked to."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    found = [(x, root(x)) for x in list(parent)]
    v, p = zip(*found, strict=True) if found else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(p, pa.string())], names=["v", "p"])


def _at_parents(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """df with the column's values replaced by their parents (v, p). Both sides are joined by sort and merge where they are large, whose skewed parts AQE splits."""
    return df.join(bounded(parents.select(F.col("v").alias(column), F.col("p").alias("__p"))), column, "left").withColumn(column, F.coalesce("__p", column)).drop("__p")


def connected_components(edges: DataFrame, source: str, target: str, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(feature_id, component): every end of an edge with the smallest one of its component. Null ends are left out.

    Ends are ordered by a hash, so that names in order don't make long chains. Each round every end takes the least of its
    neighbours and itself as its parent and edges go to the parents of both ends, which halves them at least along a chain;
    when one task can hold what is left, it finishes by union-find. The loop ends when no edge is left, not after a number
    of rounds.
    """
    ends = edges.select(F.col(source).cast("string").alias("u"), F.col(target).cast("string").alias("v"))
    nodes = ends.select(F.explode(F.array("u", "v")).alias("n")).where("n IS NOT NULL").distinct()
    hashed = [F.concat(F.hex(F.pmod(F.xxhash64(c), F.lit(1 << 32))), F.lit(":"), F.col(c)).alias(c) for c in ("u", "v")]
    state = cut(ends.where("u <> v").select(*hashed).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    while (n := state.count()) > one_task_edges:
        near = both_directions(state, "u", "v")
        steps.append(cut(near.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))))
        moved = _at_parents(_at_parents(state, "u", steps[-1]), "v", steps[-1]).where("u <> v")
        # A parent that isn't its own one stays an end, linked to its parent.
        up = _at_parents(steps[-1].select(F.col("p").alias("u"), F.col("p").alias("v")).distinct(), "v", steps[-1]).where("u <> v")
        state = cut(moved.select("u", "v").unionByName(up.select("u", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if n:
        steps.append(cut(state.coalesce(1).mapInArrow(_roots, "v string, p string")))
    if not steps:
        return nodes.select(F.col("n").alias("feature_id"), F.col("n").alias("component"))
    total = steps[-1]
    for step in reversed(steps[:-1]):
        total = cut(_at_parents(step, "p", total))
    named = total.select(F.expr("substr(v, instr(v, ':') + 1)").alias("n"), "p")
    least = cut(named.groupBy("p").agg(F.min("n").alias("component")))
    found = named.join(bounded(least), "p").select("n", "component")
    return nodes.join(found, "n", "left").select(F.col("n").alias("feature_id"), F.coalesce("component", "n").alias("component"))


def top_neighbours(edges: DataFrame, source: str, target: str, score: str, n: int = 16) -> DataFrame:
    """The n best edges of each source; null scores last, ties in the order of targets."""
    order = Window.partitionBy(source).orderBy(F.col(score).desc_nulls_last(), F.col(target))
    return edges.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def edge_weights(edges: DataFrame, score: str, matched: str, peaks: str) -> DataFrame:
    """Adds `weight`: the square of score x matched / peaks, brought to the range 0.01 to 1."""
    raw = F.pow(F.col(score) * F.col(matched) / F.col(peaks), F.lit(2))
    ends = edges.agg(F.min(raw).alias("__low"), F.max(raw).alias("__high"))
    span = F.col("__high") - F.col("__low")
    return edges.crossJoin(F.broadcast(ends)).withColumn("weight", F.when(span > 0, 0.01 + 0.99 * (raw - F.col("__low")) / span).otherwise(1.0)).drop("__low", "__high")


#: Resolutions that are tried, from coarse to fine.
RESOLUTIONS = (0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def _moved(links: DataFrame, place: DataFrame, total: float, rounds: int) -> DataFrame:
    """Local moving of nodes between communities, of all resolutions (r) at once: (r, n, c, d) after rounds in which a node goes where modularity gains most.

    links: r and both directions (a, b, w) without self-links; place: r, n, c, d (the node's degree). Half of the nodes may
    move in a round, by a hash of node and round, and any node to a community with a smaller name, so two nodes don't
    swap forever; it ends when nobody gains.
    """
    at = ["r", "n", "at", "d"]
    for k in range(rounds):
        held = place.groupBy("r", "c").agg(F.sum("d").alias("held"))
        to = links.join(place.select("r", F.col("n").alias("b"), "c"), ["r", "b"]).groupBy("r", F.col("a").alias("n"), "c").agg(F.sum("w").alias("in"))
        own = place.select("r", "n", F.col("c").alias("at"), "d")
        options = own.join(to, ["r", "n"]).unionByName(own.withColumn("c", F.col("at")).withColumn("in", F.lit(0.0))).groupBy(*at, "c").agg(F.max("in").alias("in"))
        gain = F.round(F.col("in") - F.col("r") * F.col("d") * (F.col("held") - F.when(F.col("c") == F.col("at"), F.col("d")).otherwise(0.0)) / total, 12)
        best = options.join(held, ["r", "c"]).withColumn("gain", gain).groupBy(*at).agg(F.max(F.struct("gain", (F.col("c") == F.col("at")).alias("stay"), F.col("c"))).alias("x"))
        turn = (F.pmod(F.xxhash64("n", F.lit(k)), F.lit(2)) == 0) | (F.col("x.c") < F.col("at"))
        placed = cut(best.select("r", "n", F.when(turn, F.col("x.c")).otherwise(F.col("at")).alias("c"), "d", (F.col("x.c") != F.col("at")).alias("would")))
        place = placed.select("r", "n", "c", "d")
        if placed.where("would").isEmpty():
            break
    return place


def modularities(links: DataFrame, place: DataFrame, total: float) -> DataFrame:
    """(r, q): modularity at resolution 1 of the communities (r, n, c, d) of each resolution."""
    named = place.select("r", "n", "c")
    inside = links.join(named.select("r", F.col("n").alias("a"), F.col("c").alias("ca")), ["r", "a"]).join(named.select("r", F.col("n").alias("b"), F.col("c").alias("cb")), ["r", "b"])
    inside = inside.groupBy("r").agg((F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)) / total).alias("inside"))
    expected = place.groupBy("r", "c").agg((F.sum("d") / total).alias("p")).groupBy("r").agg(F.sum(F.col("p") * F.col("p")).alias("chance"))
    return inside.join(expected, "r").select("r", F.round(F.col("inside") - F.col("chance"), 9).alias("q"))


def communities(edges: DataFrame, source: str, target: str, weight: str, resolutions: tuple[float, ...] = RESOLUTIONS, rounds: int = 6, levels: int = 2) -> DataFrame:
    """(feature_id, component, community): communities by greedy modularity, of the resolution whose communities have the highest one.

    Nodes move by rounds of joins and aggregations, then communities become the nodes of the next level, so the largest
    component is never in one task; all resolutions go through the same rounds. rounds and levels bound the search, which
    is a heuristic like any such. A community bears its smallest feature. Edges with a null end are left out, null weights
    count 0, equal modularity goes to the coarser resolution. Repeated and turned edges add up.
    """
    own = edges.select(F.col(source).cast("string").alias("a"), F.col(target).cast("string").alias("b"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")).where("a IS NOT NULL AND b IS NOT NULL")
    parts = cut(connected_components(own, "a", "b"))
    both = own.where("a <> b").unionByName(own.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    plain = cut(both.groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 0"))
    total = plain.agg(F.sum("w")).first()[0]
    if not total:
        return parts.select("feature_id", "component", F.col("feature_id").alias("community"))
    every = F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("r")
    links = plain.select(every, "a", "b", "w")
    nodes = cut(links.groupBy("r", F.col("a").alias("n")).agg(F.sum("w").alias("d")))
    member, level_links, level_nodes = nodes.select("r", "n", F.col("n").alias("c")), links, nodes
    for _ in range(levels):
        place = _moved(level_links, level_nodes.select("r", "n", F.col("n").alias("c"), "d"), total, rounds)
        named = place.select("r", F.col("n").alias("c"), F.col("c").alias("__c"))
        member = cut(member.join(named, ["r", "c"]).select("r", "n", F.col("__c").alias("c")))
        if place.where("n <> c").isEmpty():
            break
        ends = level_links.join(named.select("r", F.col("c").alias("a"), F.col("__c").alias("ca")), ["r", "a"]).join(named.select("r", F.col("c").alias("b"), F.col("__c").alias("cb")), ["r", "b"])
        level_links = cut(ends.where("ca <> cb").groupBy("r", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        level_nodes = place.groupBy("r", F.col("c").alias("n")).agg(F.sum("d").alias("d"))
    best = modularities(links, member.join(nodes, ["r", "n"]), total).orderBy(F.desc("q"), "r").first().r
    chosen = member.where(F.col("r") == best).select("n", "c")
    names = chosen.groupBy("c").agg(F.min("n").alias("community"))
    named = chosen.join(names, "c").select(F.col("n").alias("feature_id"), "community")
    return parts.join(named, "feature_id", "left").select("feature_id", "component", F.coalesce("community", "feature_id").alias("community"))


def pruned_communities(edges: DataFrame, members: DataFrame, weight: str) -> DataFrame:
    """Edges within communities that are heavy for theirs.

    members: feature_id, community; edges: feature_source, feature_target, weight. An edge stays if its weight is at least
    the greater of its community's 75th percentile and of the greater of 0.05 and its median.
    """
    a = members.select(F.col("feature_id").alias("feature_source"), F.col("community"))
    b = members.select(F.col("feature_id").alias("feature_target"), F.col("community").alias("__other"))
    inside = edges.join(a, "feature_source").join(b, "feature_target").where("community = __other").drop("__other")
    limit = inside.groupBy("community").agg(F.greatest(F.percentile(weight, 0.75), F.lit(0.05), F.percentile(weight, 0.5)).alias("__limit"))
    return inside.join(limit, "community").where(F.col(weight) >= F.col("__limit")).drop("__limit")


def consistent_masses(edges: DataFrame, mass: str, ppm: float, dalton: float, rounds: int = 10) -> DataFrame:
    """Edges whose implied mass agrees with the median of both their features, found again until nothing changes (rounds at most).

    edges: feature_id, feature_id_dest and the mass that the edge implies. A mass agrees within ppm or within dalton.
    """
    state = cut(edges.where(F.col(mass).isNotNull()))
    n = state.count()
    for _ in range(rounds):
        medians = [state.select(F.col(c).alias("f"), F.col(mass).alias("m")) for c in ("feature_id", "feature_id_dest")]
        median = medians[0].unionByName(medians[1]).groupBy("f").agg(F.percentile("m", 0.5).alias("med"))
        a = median.select(F.col("f").alias("feature_id"), F.col("med").alias("__a"))
        b = median.select(F.col("f").alias("feature_id_dest"), F.col("med").alias("__b"))

        def near(c: str):
            apart = F.abs(F.col(mass) - F.col(c))
            return (apart <= dalton) | (apart * 1e6 / F.col(c) <= ppm)

        state = cut(state.join(a, "feature_id").join(b, "feature_id_dest").where(near("__a") & near("__b")).select(*edges.columns))
        if (left := state.count()) == n:
            break
        n = left
    return state


def assigned_states(edges: DataFrame, prior: float = 0.01) -> DataFrame:
    """One adduct per feature that makes as much weight of edges agree as possible: (feature, state).

    edges: feature_id, adduct, feature_id_dest, adduct_dest, weight. A state's score is the weight of the feature's edges
    whose both adducts hold, plus a small prior for each edge that names it; among equals the shorter text wins, then the
    first by name. In each round a feature changes to its best state if it gains more than all its neighbours would, so
    no two neighbours change at once and the total rises until no feature would; a round is joins and aggregations, and no
    component is brought into one task. Edges with a null end or adduct count for nothing.
    """
    known = edges.dropna(subset=["feature_id", "adduct", "feature_id_dest", "adduct_dest"]).where("feature_id <> feature_id_dest")
    there = known.select(F.col("feature_id").alias("n"), F.col("adduct").alias("a"), F.col("feature_id_dest").alias("m"), F.col("adduct_dest").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
    back = there.select(F.col("m").alias("n"), F.col("b").alias("a"), F.col("n").alias("m"), F.col("a").alias("b"), "w")
    ends = cut(there.unionByName(back))
    priors = cut(ends.groupBy("n", "a").agg((F.count("*") * prior).alias("p")))

    def best(scores: DataFrame) -> DataFrame:
        return scores.groupBy("n").agg(F.min(F.struct((-F.col("s")).alias("s"), F.length("a").alias("k"), "a")).alias("x")).select("n", F.col("x.a").alias("best"), (-F.col("x.s")).alias("top"))

    state = cut(best(priors.withColumnRenamed("p", "s")).select("n", F.col("best").alias("state")))
    near = ends.select("n", "m").distinct()
    while True:  # the total rises in every round, so this ends
        other = state.select(F.col("n").alias("m"), F.col("state").alias("b"))
        agreed = ends.join(other, ["m", "b"], "left_semi").groupBy("n", "a").agg(F.sum("w").alias("v"))
        scores = priors.join(agreed, ["n", "a"], "left").select("n", "a", F.round(F.col("p") + F.coalesce("v", F.lit(0.0)), 9).alias("s"))
        own = state.join(scores.withColumnRenamed("a", "state").withColumnRenamed("s", "now"), ["n", "state"])
        gains = cut(own.join(best(scores), "n").withColumn("gain", F.col("top") - F.col("now")))
        willing = gains.where("gain > 0").select("n", "gain")
        if willing.isEmpty():
            break
        rivals = near.join(willing.select(F.col("n").alias("m"), F.col("gain").alias("g")), "m").groupBy("n").agg(F.max(F.struct("g", "m")).alias("r"))
        moves = willing.join(rivals, "n", "left").where("r IS NULL OR gain > r.g OR (gain = r.g AND n > r.m)").select("n", F.lit(True).alias("move"))
        state = cut(gains.join(moves, "n", "left").select("n", F.when(F.col("move"), F.col("best")).otherwise(F.col("state")).alias("state")))
    return state.select(F.col("n").alias("feature"), "state")


def edges_in_state(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Edges whose both adducts are their features' states, the heaviest of each pair."""
    from spectrail.operators.keys import first_row

    a = states.select(F.col("feature").alias("feature_id"), F.col("state").alias("adduct"))
    b = states.select(F.col("feature").alias("feature_id_dest"), F.col("state").alias("adduct_dest"))
    kept = edges.join(a, ["feature_id", "adduct"], "left_semi").join(b, ["feature_id_dest", "adduct_dest"], "left_semi")
    return first_row(kept, ["feature_id", "feature_id_dest"], [F.col("weight").desc_nulls_last(), F.asc("adduct"), F.asc("adduct_dest")])
