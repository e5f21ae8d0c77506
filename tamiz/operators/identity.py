"""Documents and their identity: duplicate groups, survivors, merges by several keys, the link frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.operators.components import connected_components


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last version of every key; ties by all columns; null keys are dropped."""
    cols = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, *[F.to_json(F.struct(c)) for c in cols])).alias("__r"))
    return kept.select(key, "__r.*")


def first_wins(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def same_keys(records: DataFrame) -> DataFrame:
    """``(doc_id, component)`` of ``(doc_id, keys array<string>)``: documents that share a key, directly or through others.

    The graph joins documents to keys, so a key that a third of all documents hold adds one edge a document.
    """
    edges = records.select(F.concat(F.lit("d:"), "doc_id").alias("src"), F.explode("keys").alias("k")).where("k is not null").select("src", F.concat(F.lit("k:"), "k").alias("dst")).distinct()
    found = connected_components(edges).where(F.col("node").startswith("d:"))
    named = found.select(F.substring("node", 3, 2147483647).alias("doc_id"), F.col("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = records.select("doc_id").distinct().join(named.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component"))
    return named.join(least, "component").select("doc_id", F.col("least").alias("component")).unionByName(alone)


def preference(preferred: str) -> list[tuple[str, Column]]:
    """What decides among copies, each smaller the better: well stored, with a canonical identity, not from elsewhere, of the preferred host, more articles, more text; then short id, id."""
    return [
        ("estado", (F.coalesce(F.col("estado"), F.lit("")) != "ok").cast("int")), ("canonico", F.col("canonico").isNull().cast("int")), ("origen", F.col("origen").isNotNull().cast("int")),
        ("fuente", (~F.coalesce(F.lower("url").contains(preferred), F.lit(False))).cast("int")), ("articulos", -F.coalesce("n_articulos_detectados", F.lit(0))), ("texto", -F.coalesce("n_caracteres", F.lit(0)).cast("bigint")),
    ]


def survivors(records: DataFrame, groups: DataFrame, preferred: str = "gaceta") -> DataFrame:
    """Adds ``component``, ``place`` (1 for the copy that stays), ``survivor`` and ``motivo`` to the records of a group.

    ``motivo`` names the first preference that decided against the copy with the shortest id, which one would expect to
    stay; it is null where that one stayed. Records without addresses are all of no preferred host. The survivor and the expected copy are pre-aggregated minima; places are
    ranked in a group.
    """
    keys = preference(preferred)
    if "url" not in records.columns:
        records = records.withColumn("url", F.lit(None).cast("string"))
    j = records.join(groups, "doc_id").select("*", F.struct(*[c.alias(n) for n, c in keys], F.length("doc_id").alias("largo"), F.col("doc_id").alias("id")).alias("__p"))
    best = j.groupBy("component").agg(F.min("__p").alias("__best"), F.min_by("__p", F.struct(F.length("doc_id"), "doc_id")).alias("__shortest"))
    reason = F.when(F.col("__best.id") == F.col("__shortest.id"), F.lit(None))
    for n, _ in keys:
        reason = reason.when(F.col(f"__best.{n}") != F.col(f"__shortest.{n}"), F.lit(n))
    place = F.row_number().over(Window.partitionBy("component").orderBy("__p"))
    return j.join(best, "component").select("*", place.alias("place"), F.col("__best.id").alias("survivor"), reason.otherwise(F.lit("id")).alias("motivo")).drop("__p", "__best", "__shortest")


def unique_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds ``id``: the base, with ``-2``, ``-3`` and so on from the second row of a base on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("__n", n).withColumn("id", F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__n").cast("string")))).drop("__n")


def in_degree(links: DataFrame, key: Column, preferred: Column) -> DataFrame:
    """``(key, links, sources, url, from_docs)`` of ``(doc_id, url)``: how often and from where each norm is linked.

    The address shown is a preferred one where there is any, then the shortest, then the first; at most ten sources, sorted.
    """
    k = links.where("url is not null").withColumn("key", key)
    order = F.struct((~preferred).alias("p"), F.length("url").alias("n"), "url")
    once = k.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("url"), order).alias("u"), F.min(order).alias("o"))
    g = once.groupBy("key").agg(F.sum("n").alias("links"), F.count("doc_id").alias("sources"), F.min_by("u.url", "o").alias("url"))
    # Sources are ranked within hashed parts of a key first, so that a key that a third of all rows hold fills no task.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    near = once.where("doc_id is not null").withColumn("__n", F.row_number().over(Window.partitionBy("key", part).orderBy("doc_id"))).where("__n <= 10")
    ten = near.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where("__n <= 10").groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("from_docs"))
    return g.join(ten, "key", "left").withColumn("from_docs", F.coalesce("from_docs", F.array().cast("array<string>")))


def frontier(candidates: DataFrame, attempted: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Candidates ``(key, url, links)`` above ``least`` links whose key was not attempted, most linked first."""
    new = candidates.where(F.col("links") > least).join(attempted.select("key").distinct(), "key", "left_anti")
    # A limit keeps the best of each task; a rank over all rows would need one task for everything.
    return new.orderBy(F.desc("links"), "key").limit(most) if most else new


def merge_lists(rows: DataFrame, group: str, first: list[str], order: str, sums: list[str], unions: list[str]) -> DataFrame:
    """One row a group: first values by order, numbers summed, arrays united in order of sight."""
    aggs = [F.min_by(c, order).alias(c) for c in first] + [F.sum(c).alias(c) for c in sums]
    aggs += [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(c, F.array()).alias("v")))), lambda x: x["v"]))).alias(c) for c in unions]
    return rows.groupBy(group).agg(*aggs)
