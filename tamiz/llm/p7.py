"""Problem 7: evaluation items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm.leakage import SHORTEST, leaked, question_fields
from tamiz.session import table


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Passages with at most one word changed, put in or left out; items of six words and more."""
    return leaked(table(spark, folder, "documents"), question_fields(table(spark, folder, "preguntas")), shortest=SHORTEST)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), question_fields(table(spark, folder, "preguntas"))).where("edits = 0").select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches}
SQL = {
    "p7_found": r"""
WITH fields AS (SELECT id AS item_id, unnest([pregunta, respuesta_esperada]) AS t FROM preguntas),
iw AS (SELECT item_id, regexp_extract_all(lower(strip_accents(t)), '[\p{L}\p{N}]+') AS w FROM fields WHERE t IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM iw, unnest(range(1, len(w) - 10)) AS r(i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM dw, unnest(range(1, len(w) - 10)) AS r(i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
