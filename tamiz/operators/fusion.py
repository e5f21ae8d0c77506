"""Rankings: reciprocal-rank fusion, collapse of copies, ranks by document, filters and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(rankings: list[DataFrame], k: int = 10, c: int = 60) -> DataFrame:
    """``(qid, row_id, score, rank)``: sum of 1/(c + rank) over the rankings; ties keep the order of first sight."""
    union = None
    for n, r in enumerate(rankings):
        part = r.select("qid", "row_id", "rank", F.lit(n).alias("src"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("qid", "row_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))), 9).alias("score"), F.min(F.struct("src", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "row_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "row_id", "score", "rank")


def fuse_lists(lists: list[DataFrame], k: int = 10, c: int = 60) -> DataFrame:
    """``(qid, row_id, score, rank)``: final lists fused by reciprocal ranks; ties go to the smaller key as text, whatever list it came from."""
    union = None
    for r in lists:
        part = r.select("qid", "row_id", "rank")
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("qid", "row_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("row_id").cast("string"))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "row_id", "score", "rank")


def _f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as multisets; zero where they share nothing."""
    held = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(held(a, w), held(b, w)))
    return F.when(common > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def overlap_f1(a: Column, b: Column) -> Column:
    """Mean F1 of the unigrams and bigrams of two short texts' tokens; zero where one has none, unigrams alone where one has one."""
    pairs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.element_at(ws, i), F.element_at(ws, i + 1)))
    one = _f1(a, b)
    two = F.when((F.size(a) > 1) & (F.size(b) > 1), _f1(pairs(a), pairs(b))).otherwise(one)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round((one + two) / 2, 6)).otherwise(F.lit(0.0))


def collapse(ranking: DataFrame, copies: DataFrame, k: int, over: int = 3) -> DataFrame:
    """Best row of each text: ``copies`` is ``(row_id, hash)``. Of the first ``over * k`` rows each hash stays once; then cut at ``k``."""
    first = ranking.where(F.col("rank") <= over * k).join(copies.select("row_id", "hash"), "row_id")
    w = Window.partitionBy("qid", "hash").orderBy("rank")
    kept = first.withColumn("n", F.row_number().over(w)).where("n = 1")
    again = Window.partitionBy("qid").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k).select("qid", "row_id", "score", "rank")


def by_document(ranking: DataFrame, rows: DataFrame) -> DataFrame:
    """``(qid, doc_id, rank)``: documents by their first row; ``rows`` is ``(row_id, doc_id)``."""
    first = ranking.join(rows.select("row_id", "doc_id"), "row_id").groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    return first.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("first", "doc_id")).alias("rank"))


def filter_or_all(ranking: DataFrame, wanted: Column, least: int) -> DataFrame:
    """Rows that are wanted; all rows of a query that has fewer than ``least`` of them. Adds ``filtered``."""
    n = F.count_if(wanted).over(Window.partitionBy("qid"))
    return ranking.withColumn("__n", n).where(wanted | (F.col("__n") < least)).withColumn("filtered", F.col("__n") >= least).drop("__n")


def cap(ranking: DataFrame, group: str, most: int, k: int) -> DataFrame:
    """At most ``most`` rows of each group (null counts as a group of its own row); then the first ``k``."""
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\u0000"), F.col("row_id").cast("string")))
    n = F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))
    kept = ranking.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "row_id"))).where(F.col("rank") <= k)


def context_budget(passages: DataFrame, cost: Column, budget: int, most: int = 8) -> DataFrame:
    """First passages of each query whose summed cost fits the budget; the first always stays. Adds ``cost`` and ``used``."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = passages.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w))
    return run.where((F.col("rank") <= most) & ((F.col("rank") == 1) | (F.col("used") <= budget)))


def signals(ranking: DataFrame) -> DataFrame:
    """Per query: rows, highest and lowest score, their difference."""
    return ranking.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))


def bridge(catalog: DataFrame) -> DataFrame:
    """``(canon, row_id)``: every row of ``(row_id, canon)`` under its full id and under its base, before ``#``."""
    ids = F.array_distinct(F.array("canon", F.split("canon", "#")[0]))
    return catalog.where("canon is not null").select(F.explode(ids).alias("canon"), "row_id")
