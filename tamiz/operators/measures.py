"""Measures of runs: ranks, roll-ups, confusion, percentiles, differences, long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_measures(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Per query with relevant rows: recall and hit at each k, reciprocal rank at the first k, rank of the first hit.

    ``relevant`` is ``(qid, row_id)``; its repeats count once. Queries without a hit have measures of zero, a null first rank.
    """
    wanted = relevant.select("qid", "row_id").distinct()
    total = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranking.join(wanted, ["qid", "row_id"]).groupBy("qid").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    j = total.join(hits, "qid", "left")
    cols = [F.round(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n_relevant"), 4).alias(f"recall_{k}") for k in ks]
    cols += [(F.coalesce(F.col(f"h{k}"), F.lit(0)) > 0).cast("int").alias(f"hit_{k}") for k in ks]
    return j.select("qid", "n_relevant", F.col("first").alias("first_rank"), *cols, F.when(F.col("first") <= ks[0], F.round(1.0 / F.col("first"), 4)).otherwise(F.lit(0.0)).alias("mrr"))


def roll_up(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Means over all rows and over each column of ``by`` by itself (grouping sets); nulls count in no mean."""
    means = [F.round(F.avg(m), 4).alias(m) for m in measures]
    keys = [F.col(c) for c in by]
    return rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *means)


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: true and false positives and negatives; a null prediction counts as negative."""
    p = F.coalesce(predicted, F.lit(False))
    return rows.agg(F.count_if(actual & p).alias("tp"), F.count_if(~actual & p).alias("fp"), F.count_if(actual & ~p).alias("fn"), F.count_if(~actual & ~p).alias("tn"))


def first_failure(stages: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """Name of the first stage whose condition holds; a null condition does not hold."""
    head, *rest = stages
    return reduce(lambda c, s: c.when(s[1], F.lit(s[0])), rest, F.when(head[1], F.lit(head[0]))).otherwise(F.lit(otherwise))


def percentiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Interpolated percentiles, cut to whole numbers, and the largest value."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in at]))
    g = rows.groupBy(*by).agg(p.alias("__p"), F.max(value).alias("largest"))
    return g.select(*by, *[F.floor(F.element_at("__p", i + 1)).cast("int").alias(f"p{int(x * 100)}") for i, x in enumerate(at)], "largest")


def weighted_mean(rows: DataFrame, by: str, value: str, weights: dict[str, float]) -> DataFrame:
    """One row: the mean of the groups' means under fixed weights; groups without a weight do not count."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    means = rows.groupBy(by).agg(F.avg(value).alias("m")).withColumn("w", F.element_at(w, F.col(by))).where("w is not null")
    return means.agg(F.round(F.sum(F.col("m") * F.col("w")) / F.sum("w"), 4).alias("weighted"))


def long_form(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row a value; nulls are dropped."""
    return rows.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, "metric", "value").where("value is not null")


def difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row over the keys of both runs: rows, equal ones, mean difference and mean absolute difference."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("n_equal"), F.round(F.avg(F.col("y") - F.col("x")), 4).alias("mean_diff"), F.round(F.avg(F.abs(F.col("y") - F.col("x"))), 4).alias("mean_abs_diff"))


def softmax(values: Column) -> Column:
    """Softmax of an array of numbers; an empty array stays empty."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def ensemble(votes: DataFrame) -> DataFrame:
    """``(qid, letter, p)``: mean probability of each original letter over ``(qid, shift, letter, p)`` of several orders."""
    return votes.groupBy("qid", "letter").agg(F.round(F.avg("p"), 6).alias("p"))


def best_letter(votes: DataFrame) -> DataFrame:
    """Letter with the highest probability of each query; ties go to the first in the alphabet."""
    return votes.groupBy("qid").agg(F.min_by("letter", F.struct(-F.col("p"), "letter")).alias("letter"), F.max("p").alias("p"))


def missing_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Per group the numbers from 1 to its highest that it lacks, and how many rows repeat a number."""
    g = rows.where(F.col(number).isNotNull() & (F.col(number) > 0)).groupBy(group).agg(F.collect_set(number).alias("seen"), F.max(number).alias("top"), (F.count(F.lit(1)) - F.countDistinct(number)).alias("repeats"))
    return g.select(group, "top", "repeats", F.array_sort(F.array_except(F.sequence(F.lit(1), "top"), "seen")).alias("missing"))


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query of either ranking: rows of both, rows of one alone, and whether sets and order are the same."""
    x, y = (r.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda s: s["row_id"]).alias(n)) for r, n in ((a, "x"), (b, "y")))
    empty = F.array().cast("array<bigint>")
    j = x.join(y, "qid", "full").select("qid", F.coalesce("x", empty).alias("x"), F.coalesce("y", empty).alias("y"))
    return j.select("qid", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_except("x", "y")).alias("only_a"), F.size(F.array_except("y", "x")).alias("only_b"), (F.sort_array("x") == F.sort_array("y")).alias("same_set"), (F.col("x") == F.col("y")).alias("same_order"))


def emptiness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n_empty)``: rows whose value is null or an empty text, array or map."""
    kinds = dict(rows.dtypes)
    empty = lambda c: F.col(c).isNull() | ((F.size(c) == 0) if kinds[c].startswith(("array", "map")) else (F.col(c).cast("string") == ""))
    counted = rows.agg(*[F.count_if(empty(c)).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "n_empty")
