"""Problem 8: sentence units of documents in ten languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm.sentences import sentences
from tamiz.session import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents"))


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
