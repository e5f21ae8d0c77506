"""Problem 4: fields of extracted parts that were read with the wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm.encoding import garbled
from tamiz.session import table


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "texto"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "texto")).select("texto_id", "campo").distinct()


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
