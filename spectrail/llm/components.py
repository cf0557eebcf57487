"""Consolidating pairwise matches into groups, on a two-dimensional grid of edge blocks.

Vertices are hashed into blocks and an edge belongs to the cell of its two blocks, so the edges of a vertex that holds a
third of all pairs are spread over a whole row and column of cells; a cell that is still too full is split by a hash of its
edges. Each round runs a local union-find in every cell; each vertex then compares the representatives it got in its row
and its column and takes the smallest as its parent, and what linked a vertex to the others now links its parent to
theirs. The next round works on these edges alone; it ends when no edge is left.

Representatives are compared by a hash of their names. So along a chain of ascending names half of all vertices, not one,
are nobody's parent after a round, and the rounds grow with the logarithm of the longest chain. The smallest name of each
group is put back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, hot_keys, salted_join
from spectrail.session import BROADCAST_ROWS, bounded, cut

#: Edges that one cell should hold at most, which bounds the memory of its union-find.
CELL_EDGES = 100_000


def union_find(pairs: Iterator[tuple[str, str]]) -> dict[str, str]:
    """Each vertex of the pairs with the smallest vertex of its group."""
    parent: dict[str, str] = {}
    for a, b in pairs:
        roots = []
        for x in (a, b):
            p = parent.setdefault(x, x)
            while p != x:
                q = parent[p]
                parent[x] = q
                x, p = p, q
            roots.append(x)
        low, high = min(roots), max(roots)
        parent[high] = low
    for x in parent:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
    return parent


def _cell(edges: pa.Table) -> pa.Table:
    parent = union_find(zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True))
    return pa.table({"v": pa.array(parent.keys(), pa.string()), "rep": pa.array(parent.values(), pa.string())})


def _undirected(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shuffled(name: str) -> Column:
    """A vertex's name behind a hash of it: another name for each, in an order that has nothing to do with the names'."""
    return F.concat(F.hex(F.pmod(F.xxhash64(name), F.lit(1 << 32))), F.lit(":"), F.col(name))


def _follow(left: DataFrame, column: str, right: DataFrame, hot_rows: int) -> DataFrame:
    """Replaces left[column] by its parent in right (v, rep), where it has one."""
    right = right.select(F.col("v").alias(column), F.col("rep").alias("__next"))
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = left.join(F.broadcast(right), column, "left")
    else:
        hot = hot_keys(left.groupBy(column).agg(F.count("*").alias("n")), [column], "n", hot_rows)
        joined = salted_join(left, right, [column], hot, F.hash(*[c for c in left.columns if c != column]), "left")
    return joined.withColumn(column, F.coalesce("__next", column)).drop("__next")


def in_cells(edges: DataFrame, n: int, cell_edges: int) -> DataFrame:
    """The n edges (a, b) with their cell: row and column of the grid, and part of a cell that holds more than cell_edges."""
    blocks = ceil(sqrt(2 * n / cell_edges))
    a, b = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("a", "b"))
    placed = edges.withColumn("row", F.least(a, b)).withColumn("column", F.greatest(a, b))
    if blocks == 1:
        return placed.withColumn("part", F.lit(0).cast("long"))
    full = placed.groupBy("row", "column").agg(F.count("*").alias("held")).where(F.col("held") > cell_edges)
    full = bounded(cut(full.select("row", "column", F.ceil(F.col("held") / cell_edges).alias("parts"))))
    part = F.pmod(F.xxhash64("b", "a"), F.coalesce("parts", F.lit(1)))
    return placed.join(full, ["row", "column"], "left").withColumn("part", part).drop("parts")


def linked_groups(pairs: DataFrame, left: str, right: str, cell_edges: int = CELL_EDGES, hot_rows: int = HOT_ROWS, watch: list | None = None) -> DataFrame:
    """(group_id, member): every value of either column with the smallest value of its group, compared as text.

    A value that occurs only beside a null or itself is a group of its own; nulls are no members. Repeated and turned
    pairs count once. An empty table gives an empty result; further columns aren't read. watch: gets the number of edges
    of each round.
    """
    ends = pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    members = ends.select(F.explode(F.array("a", "b")).alias("v")).where(F.col("v").isNotNull()).distinct()
    edges = cut(_undirected(ends.where("a <> b").select(_shuffled("a").alias("a"), _shuffled("b").alias("b"))))
    parents: list[DataFrame] = []
    while n := edges.count():
        if watch is not None:
            watch.append(n)
        stars = in_cells(edges, n, cell_edges).groupBy("row", "column", "part").applyInArrow(_cell, "v string, rep string")
        # A vertex has one representative per cell of its row and column at most: a bounded set.
        seen = cut(stars.groupBy("v").agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps")))
        parents.append(seen.select("v", "rep"))
        linked = seen.select(F.col("rep").alias("a"), F.explode("reps").alias("b")).distinct()
        edges = cut(_undirected(_follow(linked, "b", parents[-1], hot_rows)))
    if not parents:
        return members.select(F.col("v").alias("group_id"), F.col("v").alias("member"))
    total = parents[-1]
    for step in reversed(parents[:-1]):
        total = cut(_follow(step, "rep", total, hot_rows))
    total = total.select(F.substring_index("v", ":", 1).alias("h"), "v", "rep").select(F.expr("substr(v, length(h) + 2)").alias("v"), "rep")
    smallest = cut(total.groupBy("rep").agg(F.min("v").alias("least")))
    named = _follow(total.select("v", "rep"), "rep", smallest.select(F.col("rep").alias("v"), F.col("least").alias("rep")), hot_rows)
    return members.join(named, "v", "left").select(F.coalesce("rep", "v").alias("group_id"), F.col("v").alias("member"))
