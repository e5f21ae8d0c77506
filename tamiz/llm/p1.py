"""Problem 1: template residue, filler, error pages and demands for scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm.residue import found
from tamiz.session import table


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return found(table(spark, folder, "texto")).select("texto_id", "parrafo", "cobertura")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return found(table(spark, folder, "texto")).select("texto_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs}
SQL: dict[str, str] = {}
