"""Queries over questions and the texts of their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import text as T
from tamiz.operators import answers
from tamiz.plans.citing import bodies_sql
from tamiz.plans.measuring import _W
from tamiz.plans.retrieval import bm25_sql, bm25_topk
from tamiz.plans.textual import fold
from tamiz.session import table

AREAS = [("penal", ["delito", "penal", "pena"]), ("laboral", ["trabajador", "laboral", "empleador"]), ("civil", ["contrato", "hipoteca", "arrendamiento"]), ("tributario", ["tarifa", "impuesto", "pago"]), ("ambiental", ["ambiental", "vertimiento", "aguas"])]


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preguntas")


def query_rows(s: SparkSession, d: str) -> DataFrame:
    return answers.query_rows(_items(s, d)).select("qid", "kind", "opcion", F.md5(F.col("q").cast("binary")).alias("hash"))


def parsed_options(s: SparkSession, d: str) -> DataFrame:
    """Options written into one text and read from it again."""
    p = _items(s, d).where("opciones is not null")
    line = F.array_join(F.transform(F.array_sort(F.map_entries("opciones")), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    return p.select("id", F.explode(answers.parse_options(F.concat_ws("\n", "pregunta", line))).alias("letter", "option"))


def option_kinds(s: SparkSession, d: str) -> DataFrame:
    p = _items(s, d).where("opciones is not null").select("id", F.explode("opciones").alias("letter", "o"))
    k = answers.option_kind(F.col("o"))
    return p.select(k["kind"].alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def keyword_areas(s: SparkSession, d: str) -> DataFrame:
    p = answers.keyword_areas(_items(s, d).select("id", "pregunta"), "pregunta", AREAS)
    return p.select("id", F.array_join("areas", ",").alias("areas"))


def evidence_completion(s: SparkSession, d: str) -> DataFrame:
    p = _items(s, d).select("id", "respuesta_esperada", C.bodies(F.col("respuesta_esperada")).alias("cited"), C.bodies(F.col("legal_basis")).alias("basis"))
    return p.select("id", F.md5(F.coalesce(answers.add_evidence(F.col("respuesta_esperada"), F.col("cited"), F.col("basis")), F.lit("")).cast("binary")).alias("hash"))


def passage_blocks(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("texto"))
    return answers.passage_block(bm25_topk(s, d).join(docs, "row_id")).select("qid", F.md5(F.col("block").cast("binary")).alias("hash"))


def copies_among(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("norma_id").alias("canon"))
    return answers.copies_among(bm25_topk(s, d, 50).join(docs, "row_id"))


def uncited_sentences(s: SparkSession, d: str) -> DataFrame:
    """Answers without the sentences that cite a norm which no registered document holds."""
    p = _items(s, d).where("respuesta_esperada is not null").select("id", "respuesta_esperada", C.bodies(F.col("respuesta_esperada")).alias("cited"))
    return p.select("id", F.length(answers.drop_citing_sentences(F.col("respuesta_esperada"), F.col("cited"))).alias("left"), F.size("cited").alias("n_cited"))


_LOW = rf"trim(regexp_replace(lower({fold('pregunta')}), '\s+', ' ', 'g'))"
QUERIES = {"query_rows": query_rows, "parsed_options": parsed_options, "option_kinds": option_kinds, "keyword_areas": keyword_areas, "evidence_completion": evidence_completion, "passage_blocks": passage_blocks, "copies_among": copies_among, "uncited_sentences": uncited_sentences}
SQL = {
    "option_kinds": f"WITH o AS (SELECT unnest(map_values(opciones)) AS o FROM preguntas WHERE opciones IS NOT NULL), k AS (SELECT lower({fold('o')}) AS low, list_distinct(regexp_extract_all(o, '\\b([A-F])\\b', 1)) AS l, len(list_filter(regexp_split_to_array(o, '\\s+'), lambda x: x <> '')) AS w FROM o) SELECT CASE WHEN regexp_matches(low, 'todas las anteriores|all of the above') THEN 'all' WHEN regexp_matches(low, 'ninguna de las anteriores|none of the above') THEN 'none' WHEN len(l) >= 2 AND regexp_matches(low, '\\b(y|and|e)\\b') AND w <= 8 THEN 'combination' ELSE 'simple' END AS kind, count(*) AS n FROM k GROUP BY 1",
    "uncited_sentences": f"WITH p AS (SELECT id, {bodies_sql('respuesta_esperada')} AS c, list_filter(string_split(regexp_replace(respuesta_esperada, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM preguntas WHERE respuesta_esperada IS NOT NULL), u AS (SELECT id, c, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM p), f AS (SELECT id, string_agg(x, ' ' ORDER BY k) AS t FROM u WHERE len(list_intersect({bodies_sql('x')}, c)) = 0 GROUP BY id) SELECT p.id, length(coalesce(t, '')) AS \"left\", len(c) AS n_cited FROM p LEFT JOIN f USING (id)",
    "query_rows": "SELECT id AS qid, 'base' AS kind, NULL AS opcion, md5(concat_ws(chr(10), pregunta, array_to_string([e.value FOR e IN list_sort(map_entries(opciones))], chr(10)))) AS hash FROM preguntas UNION ALL SELECT id, 'opcion', e.key, md5(concat_ws(chr(10), pregunta, e.value)) FROM (SELECT id, pregunta, unnest(map_entries(opciones)) AS e FROM preguntas WHERE opciones IS NOT NULL)",
    "parsed_options": "SELECT id, e.key AS letter, trim(e.value) AS option FROM (SELECT id, unnest(map_entries(opciones)) AS e FROM preguntas WHERE opciones IS NOT NULL)",
    "keyword_areas": "WITH p AS (SELECT id, " + _LOW + " AS q FROM preguntas), s AS (SELECT id, [" + ", ".join(f"(-({' + '.join(f'contains(q, {chr(39)}{k}{chr(39)})::INT' for k in ks)}), {i}, '{a}')" for i, (a, ks) in enumerate(AREAS)) + "] AS x FROM p) SELECT id, coalesce(nullif(array_to_string([e[3] FOR e IN list_sort(list_filter(x, lambda e: e[1] < 0))[1:3]], ','), ''), 'general') AS areas FROM s",
    "evidence_completion": f"WITH p AS (SELECT id, respuesta_esperada AS r, {bodies_sql('respuesta_esperada')} AS c, {bodies_sql('legal_basis')} AS b FROM preguntas), n AS (SELECT id, r, list_filter(b, lambda x: NOT list_contains(c, x)) AS x FROM p) SELECT id, md5(CASE WHEN len(x) > 0 THEN coalesce(r, '') || ' [' || array_to_string(x[1:8], '; ') || ']' ELSE coalesce(r, '') END) AS hash FROM n",
    "passage_blocks": f"WITH {bm25_sql(10)} SELECT qid, md5(string_agg('[P' || rank || '] ' || row_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS hash FROM bm JOIN documents ON doc_id = row_id GROUP BY qid",
    "copies_among": f"WITH {bm25_sql(50)}, j AS (SELECT qid, rank, row_id, norma_id, first_value(row_id) OVER (PARTITION BY qid, norma_id ORDER BY rank) AS f FROM bm JOIN documents ON doc_id = row_id) SELECT qid, count(*) FILTER (f <> row_id AND norma_id IS NOT NULL) AS copies FROM j GROUP BY qid",
}
