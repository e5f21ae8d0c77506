"""Problem 2: spans above their limit of words, cut into overlapping pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm.splitting import norm_spans, split_spans
from tamiz.session import table


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_spans(norm_spans(table(spark, folder, "partir"), table(spark, folder, "normas"), table(spark, folder, "leer")))
    return pieces.select("tramo_id", "k", "inicio", "fin")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_spans(norm_spans(table(spark, folder, "partir"), table(spark, folder, "normas"), table(spark, folder, "leer")))
    return pieces.where("k = 1").select("tramo_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {
    "p2_found": r"""
WITH ends AS (SELECT art_id, max(list_max([b.fin FOR b IN bloques])) AS fin_art FROM normas WHERE art_id IS NOT NULL GROUP BY art_id),
texts AS (SELECT doc_id, arg_max(texto, leido) AS texto FROM leer WHERE texto IS NOT NULL GROUP BY doc_id),
once AS (SELECT tramo_id, arg_max(struct_pack(d := doc_id, a := art_id, i := inicio, f := fin, p := coalesce(palabras_encabezado, 0)), actualizado) AS r FROM partir GROUP BY tramo_id),
spans AS (SELECT tramo_id, greatest(50, 297 - r.p) AS limite, substr(texto, r.i + 1, coalesce(r.f, fin_art, length(texto)) - r.i) AS tramo
FROM once LEFT JOIN ends ON ends.art_id = r.a JOIN texts ON texts.doc_id = r.d)
SELECT tramo_id FROM spans
WHERE len(regexp_extract_all(regexp_replace(tramo, '(?s)~~.*?(~~|$)', '', 'g'), '\S+')) > limite""",
}
