"""Queries of delivery: chains of pages, reports, rendered answers, passages for a service, audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.text import word_count
from tamiz.operators import responding
from tamiz.plans.hybrid import _lex, _LEX, lexical_topk
from tamiz.plans.textual import words
from tamiz.session import table
from tamiz.sources import readers


def page_chains(s: SparkSession, d: str) -> DataFrame:
    """Articles of a document as pages that follow one another; a gap in the numbers ends a chain."""
    n = table(s, d, "normas").where("doc_id is not null and orden is not null").select("doc_id", "orden").distinct()
    key = lambda o: F.concat_ws("/", "doc_id", o.cast("string"))
    return readers.page_chains(n.select(key(F.col("orden")).alias("page"), key(F.col("orden") + 1).alias("next"), F.col("doc_id").alias("base")))


def segmentation_report(s: SparkSession, d: str) -> DataFrame:
    """What was segmented, in long form: one row for each measure."""
    n = table(s, d, "normas").where("art_id is not null").groupBy("art_id").agg(F.min(F.struct("doc_id", "titulo", "bloques")).alias("r")).select("art_id", "r.*")
    n = n.withColumn("w", F.aggregate("bloques", F.lit(0), lambda a, b: a + F.coalesce(word_count(b["texto"]), F.lit(0))))
    g = n.agg(F.countDistinct("doc_id").alias("documentos"), F.count(F.lit(1)).alias("articulos"), F.sum(F.size("bloques")).alias("bloques"), F.sum("w").alias("palabras"), F.max("w").alias("mayor"), F.count_if(F.trim(F.coalesce("titulo", F.lit(""))) == "").alias("sin_titulo"))
    names = ["documentos", "articulos", "bloques", "palabras", "mayor", "sin_titulo"]
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("medida"), F.col(c).cast("bigint").alias("valor")) for c in names])).alias("x")).select("x.*")


def rendered_answers(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas")
    answer = F.coalesce("respuesta_esperada", F.element_at("opciones", F.col("respuesta_correcta")))
    return p.select("id", responding.rendered(F.col("formato"), F.col("respuesta_correcta"), answer, F.col("legal_basis")).alias("texto"))


def service_passages(s: SparkSession, d: str) -> DataFrame:
    """Passages of an answer of the service: text of at most 4,000 characters, and whether it was cut."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return lexical_topk(s, d, 10).join(docs, "row_id").select("qid", "rank", F.md5(F.left("text", F.lit(4000))).alias("hash"), (F.length("text") > 4000).alias("cortado"))


def routed_answers(s: SparkSession, d: str) -> DataFrame:
    """Items by the strategy of their format; an empty answer goes to the fallback."""
    make = lambda name, c: lambda x: x.select("id", F.lit(name).alias("via"), c.alias("texto"))
    semi = F.when(F.col("id") % 4 != 0, F.col("respuesta_esperada"))
    branches = {"multiple_choice": make("letra", F.col("respuesta_correcta")), "semi_open": make("literal", semi)}
    return responding.routed(table(s, d, "preguntas"), F.col("formato"), branches, make("libre", F.col("respuesta_esperada")), F.col("texto").isNull(), make("respaldo", F.coalesce("legal_basis", F.lit("sin base"))))


def line_audit(s: SparkSession, d: str) -> DataFrame:
    """Lines of extracted parts that name a forbidden word, without those of an allowed kind."""
    lines = table(s, d, "texto").where("markdown is not null").select("texto_id", F.posexplode(F.split("markdown", "\n")).alias("n", "linea"))
    return lines.where(F.lower("linea").rlike("javascript|captcha|cookies") & ~F.lower("linea").rlike("portales|formulario")).select("texto_id", "n")


QUERIES = {"page_chains": page_chains, "segmentation_report": segmentation_report, "rendered_answers": rendered_answers, "service_passages": service_passages, "routed_answers": routed_answers, "line_audit": line_audit}
SQL = {
    "page_chains": "WITH n AS (SELECT DISTINCT doc_id, orden FROM normas WHERE doc_id IS NOT NULL AND orden IS NOT NULL), g AS (SELECT *, orden - row_number() OVER (PARTITION BY doc_id ORDER BY orden) AS g FROM n) SELECT doc_id || '/' || orden AS page, doc_id || '/' || min(orden) OVER (PARTITION BY doc_id, g) AS head, (orden - min(orden) OVER (PARTITION BY doc_id, g))::INT AS place FROM g",
    "segmentation_report": f"WITH n AS (SELECT art_id, arg_min(doc_id, (doc_id, titulo)) AS doc_id, arg_min(coalesce(titulo, ''), (doc_id, titulo)) AS titulo, arg_min(bloques, (doc_id, titulo)) AS b FROM normas WHERE art_id IS NOT NULL GROUP BY art_id), w AS (SELECT *, len(b) AS nb, coalesce(list_sum(list_transform(b, lambda x: {words('x.texto').join(['len(', ')'])})), 0)::BIGINT AS w FROM n), g AS (SELECT count(DISTINCT doc_id) AS a1, count(*) AS a2, sum(nb)::BIGINT AS a3, sum(w)::BIGINT AS a4, max(w)::BIGINT AS a5, count(*) FILTER (trim(titulo) = '') AS a6 FROM w) SELECT unnest(['documentos', 'articulos', 'bloques', 'palabras', 'mayor', 'sin_titulo']) AS medida, unnest([a1, a2, a3, a4, a5, a6]) AS valor FROM g",
    "rendered_answers": "WITH p AS (SELECT *, coalesce(respuesta_esperada, opciones[respuesta_correcta], '') AS r FROM preguntas) SELECT id, CASE WHEN formato = 'multiple_choice' THEN 'Respuesta: ' || coalesce(respuesta_correcta, '') || chr(10) || r WHEN formato = 'semi_open' THEN r || coalesce(chr(10) || 'Referencia: ' || legal_basis, '') ELSE coalesce('Marco normativo' || chr(10) || legal_basis || chr(10) || chr(10), '') || 'Análisis' || chr(10) || r END AS texto FROM p",
    "service_passages": f"WITH {_LEX}, {_lex('lx', 'pregunta', 10)} SELECT qid, rank, md5(left(text, 4000)) AS hash, length(text) > 4000 AS cortado FROM lx JOIN documents ON doc_id = row_id",
    "routed_answers": "WITH a AS (SELECT id, legal_basis, CASE formato WHEN 'multiple_choice' THEN 'letra' WHEN 'semi_open' THEN 'literal' ELSE 'libre' END AS via, CASE WHEN formato = 'multiple_choice' THEN respuesta_correcta WHEN formato = 'semi_open' AND id % 4 = 0 THEN NULL ELSE respuesta_esperada END AS texto FROM preguntas) SELECT id, CASE WHEN texto IS NULL THEN 'respaldo' ELSE via END AS via, coalesce(texto, legal_basis, 'sin base') AS texto FROM a",
    "line_audit": "WITH l AS (SELECT texto_id, unnest(string_split(markdown, chr(10))) AS linea, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS n FROM texto WHERE markdown IS NOT NULL) SELECT texto_id, n::INT AS n FROM l WHERE regexp_matches(lower(linea), 'javascript|captcha|cookies') AND NOT regexp_matches(lower(linea), 'portales|formulario')",
}
