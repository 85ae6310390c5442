"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


FOREST_NODES = 1 << 18  # nodes a task remembers


def thinned(edges: DataFrame) -> DataFrame:
    """Edges of a two-column table that join the same components: each task leaves out edges between nodes it has tied already.

    A task remembers a bounded number of nodes and then begins anew, so it may keep more edges than needed, never fewer.
    """
    def keep(batches):
        up: dict = {}

        def find(x):
            top = up.setdefault(x, x)
            while top != up[top]:
                up[x] = up[top]
                x, top = top, up[top]
            return top

        for batch in batches:
            rows = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, y = find(a), find(b)
                if x != y:
                    up[y] = x
                    rows.append(i)
            if rows:
                yield batch.take(pa.array(rows))
            if len(up) > FOREST_NODES:
                up.clear()

    return edges.mapInArrow(keep, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node id of its connected part.

    Each round every node follows, twice, the neighbour that comes first in a fresh hashed order, and the merged graph
    is the input of the next round, so a chain shrinks as fast as a star. Only minima per node are aggregated,
    partially before the shuffle, so a hub with very many edges costs no more per edge than any other node.
    """
    pairs = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"))
    label = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("rep"))
    apart = pairs.where("a <> b")
    live = cut(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    turn = 0
    while not live.isEmpty():
        turn += 1

        def rank(c: str):
            return F.xxhash64(F.lit(turn), F.col(c))

        near = live.groupBy("a").agg(F.min(rank("b")).alias("h"), F.min_by("b", rank("b")).alias("m"))
        step = near.select(F.col("a").alias("rep"), F.when(F.col("h") < rank("a"), F.col("m")).otherwise(F.col("a")).alias("up"))
        ahead = step.select(F.col("rep").alias("up"), F.col("up").alias("far"))
        parent = cut(step.join(ahead, "up").select("rep", F.col("far").alias("up")))  # two steps at once
        label = label.join(parent, "rep", "left").select("node", F.coalesce("up", "rep").alias("rep"))
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        live = cut(live.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        if turn % 8 == 0:
            label = cut(label)
    label = cut(label)
    least = label.groupBy("rep").agg(F.min("node").alias("component"))
    return label.join(least, "rep").select("node", "component")


def fold_edges(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) rows that are new or differ once edges are added to a graph whose labels (node, component) are known.

    Each end of an edge stands for its component, so only a graph of the touched components is solved, and only the nodes
    of components that merge are read out of labels. Folding batch after batch equals one run over all edges.
    """
    pairs = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = cut(ends.join(labels.select("node", "component"), "node", "left"))
    place = at.select("node", F.coalesce("component", "node").alias("of"))
    between = pairs.join(place.toDF("a", "ca"), "a").join(place.toDF("b", "cb"), "b").select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
    merged = connected_components(between).withColumnRenamed("component", "new")
    fresh = at.where("component is null").select("node").join(merged, "node").select("node", F.col("new").alias("component"))
    moved = merged.where("node <> new").select(F.col("node").alias("component"), "new")
    return fresh.unionByName(labels.select("node", "component").join(moved, "component").select("node", F.col("new").alias("component")))
