"""Problem 5: noise of scanned and printed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.scans import repaired
from tamiz.session import table


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = repaired(table(spark, folder, "texto"))
    return rows.select("texto_id", F.posexplode("parrafos").alias("k", "parrafo"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "texto"), paragraphs=False).where(F.size("ruidos") > 0).select("texto_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
SQL: dict[str, str] = {}
