"""Problem 3: near-duplicate norms and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.near_duplicates import norm_groups
from tamiz.session import cut, table


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, grupo)``, one row for each grouped document of ``fuentes``; the group is named by its smallest one."""
    fuentes = table(spark, folder, "fuentes")
    ids = fuentes.where("doc_id is not null").select("doc_id").distinct()
    members = cut(norm_groups(fuentes, table(spark, folder, "leer")).join(ids, "doc_id", "left_semi"))
    first = members.groupBy("grupo").agg(F.min("doc_id").alias("primero"))
    return members.join(first, "grupo").select("doc_id", F.col("primero").alias("grupo"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, as the query is defined; ``p3_groups`` is the form that a group of any size keeps small."""
    members = cut(p3_groups(spark, folder))
    a, b = members.select("grupo", F.col("doc_id").alias("doc_id_a")), members.select("grupo", F.col("doc_id").alias("doc_id_b"))
    return a.join(b, "grupo").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL: dict[str, str] = {}
