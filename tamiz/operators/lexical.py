"""Lexical search: postings, statistics, BM25 top-k for all queries at once, overlap of content words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.session import cut


def postings(rows: DataFrame, tokens: Column) -> DataFrame:
    """``(term, row_id, tf)`` of ``rows`` with ``row_id``; null texts and texts without tokens have no postings."""
    return rows.where("row_id is not null").select("row_id", F.explode_outer(tokens).alias("term")).where("term is not null").groupBy("term", "row_id").agg(F.count(F.lit(1)).alias("tf"))


def statistics(rows: DataFrame, tokens: Column) -> DataFrame:
    """One row: number of rows, of distinct terms and of tokens, mean length. Lengths are counted without exploding the texts."""
    sizes = rows.select(F.size(tokens).alias("dl"))
    a = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.round(F.avg("dl"), 4).alias("avgdl"))
    b = rows.select(F.explode_outer(tokens).alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return a.crossJoin(b)


def ranked(scores: DataFrame, k: int, score: str = "score", key: str = "row_id") -> DataFrame:
    """The best ``k`` rows of each ``qid``: score down, id up; adds ``rank`` from 1."""
    w = Window.partitionBy("qid").orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(rows: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k: int = 10, k1: float = 1.5, b: float = 0.75, lucene: bool = False) -> DataFrame:
    """``(qid, row_id, score, rank)``: BM25 top-k of every query over ``rows(row_id, ...)``.

    Query terms count once. ``lucene`` leaves out the factor k1 + 1. Terms are looked up only where a query has them:
    the small set of query terms is joined to the exploded tokens before they are counted, so nothing but matching
    postings is shuffled; they are written once and serve both counts. Queries without a known term get no rows; ties go to the smaller id; scores are
    rounded to six places before they are ranked.
    """
    # Tokens are made once in a step of their own; within one select they would be made again for every exploded row.
    rows = rows.where("row_id is not null").select("row_id", tokens.alias("toks")).select("row_id", "toks", F.size("toks").alias("dl"))
    terms = queries.where("qid is not null").select("qid", F.explode(F.array_distinct(query_tokens)).alias("term"))
    totals = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    asked = terms.select("term").distinct()
    # explode_outer, as explode would have the tokens made once more for a filter on their number.
    hits = cut(rows.select("row_id", "dl", F.explode_outer("toks").alias("term")).join(asked, "term", "left_semi").groupBy("term", "row_id", "dl").agg(F.count(F.lit(1)).alias("tf")))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(totals).select("term", idf.alias("idf"), "avgdl")
    gain = F.col("idf") * F.col("tf") * F.lit(1.0 if lucene else k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    scored = hits.join(weights, "term").join(terms, "term").groupBy("qid", "row_id").agg(F.round(F.sum(gain), 6).alias("score"))
    return ranked(scored.where("score > 0"), k)


def content_f1(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """``(id, f1)``: F1 of the content words of two texts, as multisets; null where a side has none."""
    side = lambda c, name: pairs.select("id", F.explode(c).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias(name))
    both = side(left, "a").join(side(right, "b"), ["id", "w"], "full")
    g = both.groupBy("id").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("common"), F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b")).otherwise(0)).alias("hit"))
    return g.where("na is not null and nb is not null").select("id", F.round(2.0 * F.col("hit") / (F.col("na") + F.col("nb")), 6).alias("f1"))
