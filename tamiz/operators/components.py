"""Connected components: edges are joined where they lie, what is left in one task if it is little, else by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import cut_in_turn

#: Edges that are joined in one task instead of in rounds, and nodes that a task holds before it gives out what they are joined to.
AT_ONCE = 500_000
#: Types of nodes whose order in Python is that of Spark.
_PLAIN = {"string", "bigint", "int", "smallint", "tinyint"}


def _joined(most: int | None, roots: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Stars ``(u, v)`` that join what a task's edges join, ``v`` the smallest node; after every ``most`` nodes anew. A node without others is its own, any other smallest node only with ``roots``."""

    def stars(above: dict) -> pd.DataFrame:
        out, others = [], set()
        for u in above:
            v = u
            while above[v] != v:
                above[v] = v = above[above[v]]
            above[u] = v
            if u != v:
                out.append((u, v))
                others.add(v)
        return pd.DataFrame(out + [(u, u) for u, v in above.items() if u == v and (roots or u not in others)], columns=["u", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}
        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
                above.setdefault(u, u)
                above.setdefault(v, v)
                while above[u] != u:
                    above[u] = u = above[above[u]]
                while above[v] != v:
                    above[v] = v = above[above[v]]
                if u != v:
                    above[max(u, v)] = min(u, v)
            if most and len(above) >= most:
                yield stars(above)
                above = {}
        if above:
            yield stars(above)

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``(node, component)``, component = smallest node.

    Every task first joins the edges it holds to stars. Where at most ``AT_ONCE`` edges are left, one task joins them, as
    every round costs the driver ten jobs, however small; otherwise every round shuffles the current edges a constant
    number of times; the minimum per node is pre-aggregated, so a node with a third of all edges moves one row per map
    task, and the join back to its edges is one-to-many, which adaptive execution can split. Both give the same. Only the
    number of edges and a checksum reach the driver. Edges with a null end are ignored; self loops and repeated edges
    change nothing except that a node with only a self loop forms its own component; an empty table gives an empty
    result. Raises if it has not converged after ``max_rounds`` rounds.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kind = dict(named.dtypes)["u"]
    plain = kind in _PLAIN
    all_, path = cut_in_turn(named.mapInPandas(_joined(AT_ONCE, False), f"u {kind}, v {kind}") if plain else named.distinct(), None)
    if plain and all_.count() <= AT_ONCE:
        whole, _ = cut_in_turn(all_.coalesce(1).mapInPandas(_joined(None, True), f"u {kind}, v {kind}"), path)
        return whole.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes_alone = all_.where("u = v").select("u").distinct()
    e, path = cut_in_turn(all_.where("u != v").distinct(), None)
    before = _state(e)
    if before[0]:
        for _ in range(max_rounds):
            e, path = cut_in_turn(_small_star(_large_star(e)), path)
            now = _state(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = nodes_alone.select(F.col("u").alias("node"), F.col("u").alias("component")).join(members.unionByName(roots).select("node"), "node", "left_anti")
    return members.unionByName(roots).unionByName(alone).distinct()
