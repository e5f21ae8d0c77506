"""Problem 6: documents in containers of 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm.packing import fill, pack, token_pieces
from tamiz.session import table


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, pieza, desde, hasta, tokens, contenedor)`` of every document."""
    return pack(token_pieces(table(spark, folder, "documents")))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """``(contenedores, minimo, tokens, llenado)``: containers used, the fewest that could hold all tokens, and the share of their room in use."""
    return fill(p6_containers(spark, folder))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
