"""Queries of segmentation, validity and constrained selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import text as T
from tamiz.operators import segments, selection
from tamiz.operators.paragraphs import blocks
from tamiz.plans.citing import _cited_hits
from tamiz.plans.retrieval import bm25_topk
from tamiz.session import table


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "leer").where("texto is not null").select("doc_id", "texto").distinct()


def article_segments(s: SparkSession, d: str) -> DataFrame:
    a = segments.segment(_texts(s, d)).where("num is not null")
    return a.select("doc_id", "num", "num_base", "titulo", F.element_at("bloques", 1)["inicio"].alias("inicio"), F.size("bloques").alias("n_blocks"))


def text_blocks(s: SparkSession, d: str) -> DataFrame:
    b = blocks(_texts(s, d).select(F.col("doc_id").alias("id"), F.col("texto").alias("text")))
    return b.select("id", "inicio", "fin", F.md5(F.col("text").cast("binary")).alias("hash"))


def number_parts(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "normas").where("num is not null").select("num").distinct()
    p = segments.number_parts(F.col("num"))
    return n.select("num", p["base"].alias("base"))


def norm_validity(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", segments.editorial_notes(F.col("texto")).alias("n"))
    v = segments.validity(F.col("n"))
    return t.select("doc_id", F.size("n").alias("notes"), v.alias("v")).select("doc_id", "notes", F.coalesce("v.derogado", F.lit(False)).alias("derogado"), F.coalesce("v.parcial", F.lit(False)).alias("parcial"))


def judgment_sections(s: SparkSession, d: str) -> DataFrame:
    return segments.judgment_sections(_texts(s, d))


def article_chunks(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "normas").select("doc_id", "num", "bloques").distinct()
    p = n.select("doc_id", F.concat(F.lit("art_"), "num").alias("art"), F.explode("bloques").alias("b")).select("doc_id", "art", "b.*").distinct()
    c = segments.chunks(p, F.col("doc_id"))
    return c.select("chunk_id", "doc_id", "posicion", "parte_k", "parte_n", "sha1_texto")


def constrained_choice(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("norma_id").alias("canon"), F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("hash"))
    hits = bm25_topk(s, d, 50)
    none = hits.where("false")
    cand = selection.candidates(none, hits, none.withColumn("opcion", F.lit(None).cast("string")), docs)
    scored = cand.join(hits.select("qid", "row_id", F.col("score").alias("puntaje")), ["qid", "row_id"], "left").join(docs.drop("hash"), "row_id")
    return selection.choose(scored)


def supported_first(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "preguntas").where("id % 100 = 0").select(F.col("id").alias("qid"), C.bodies(F.col("legal_basis")).alias("cited"))
    hits = _cited_hits(s, d).join(q, "qid")
    return selection.reorder_by_support(hits.select("qid", "row_id", "rank", F.lit(False).alias("inserted"), F.array_intersect("b", "cited").alias("supports")))


def _planted(s: SparkSession, d: str) -> DataFrame:
    """Judgments with the lines that name their authors, which the table's texts lack, and with a dissent at the end of every other one."""
    t = table(s, d, "leer").where("texto is not null").groupBy("doc_id").agg(F.min("texto").alias("texto"))
    n = F.length("texto")
    head = F.when(n % 3 == 0, "Magistrado Ponente: RUIZ PEÑA").when(n % 3 == 1, "MAGISTRADOS PONENTES\n\nDr. JUAN  RUIZ\n\nDra. ANA PEÑA\n\nVistos\n\nDr. OTRO").otherwise("Vistos\n\nDr. NADIE")
    return t.select("doc_id", F.concat(head, F.lit("\n\n"), F.col("texto"), F.when(n % 2 == 0, "\n\nSalvamento parcial de voto del magistrado\n\nNo comparto.").otherwise("")).alias("texto"))


def decision_sections(s: SparkSession, d: str) -> DataFrame:
    return segments.decision_sections(_planted(s, d))


def judgment_authors(s: SparkSession, d: str) -> DataFrame:
    return segments.authors(_planted(s, d))


QUERIES = {"decision_sections": decision_sections, "judgment_authors": judgment_authors, "article_segments": article_segments, "text_blocks": text_blocks, "number_parts": number_parts, "norm_validity": norm_validity, "judgment_sections": judgment_sections, "article_chunks": article_chunks, "constrained_choice": constrained_choice, "supported_first": supported_first}
_T = "t AS (SELECT DISTINCT doc_id, texto FROM leer WHERE texto IS NOT NULL)"
_PLANTED = "pl AS (SELECT doc_id, CASE length(texto) % 3 WHEN 0 THEN 'Magistrado Ponente: RUIZ PEÑA' WHEN 1 THEN replace('MAGISTRADOS PONENTES||Dr. JUAN  RUIZ||Dra. ANA PEÑA||Vistos||Dr. OTRO', '||', chr(10) || chr(10)) ELSE replace('Vistos||Dr. NADIE', '||', chr(10) || chr(10)) END || chr(10) || chr(10) || texto || CASE WHEN length(texto) % 2 = 0 THEN replace('||Salvamento parcial de voto del magistrado||No comparto.', '||', chr(10) || chr(10)) ELSE '' END AS texto FROM (SELECT doc_id, min(texto) AS texto FROM leer WHERE texto IS NOT NULL GROUP BY doc_id)), lb AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(texto, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM pl), bl AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS k FROM lb)"
_RE = lambda p: ("(?i)" if "(?i)" in p else "") + p.replace("(?i)", "")
SQL = {
    "decision_sections": f"WITH {_PLANTED}, e AS (SELECT doc_id, max(k) + 1 AS n, min(k) FILTER (regexp_matches(b, '{segments.DECISION}')) AS d FROM bl GROUP BY doc_id), f AS (SELECT doc_id, min(k) AS s FROM bl JOIN e USING (doc_id) WHERE k >= d AND regexp_matches(b, '{_RE(segments.DISSENT)}') GROUP BY doc_id), j AS (SELECT doc_id, n, d, s FROM e LEFT JOIN f USING (doc_id)), u AS (SELECT doc_id, 'cuerpo' AS seccion, 0 AS desde, coalesce(d, n) AS hasta FROM j UNION ALL SELECT doc_id, 'resuelve', d, coalesce(s, n) FROM j UNION ALL SELECT doc_id, 'salvamentos', s, n FROM j) SELECT doc_id, seccion, desde, hasta FROM u WHERE desde IS NOT NULL AND desde < hasta",
    "judgment_authors": f"WITH {_PLANTED}, c AS (SELECT *, regexp_matches(b, '{_RE(segments.AUTHOR)}') AS is_, regexp_matches(b, '{segments.DOCTOR}') AS dr FROM bl), r AS (SELECT *, max(CASE WHEN is_ THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS last, sum((NOT is_ AND NOT dr)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS other FROM c), h AS (SELECT r.doc_id, r.k, r.b FROM r JOIN r x ON x.doc_id = r.doc_id AND x.k = r.last WHERE r.dr AND NOT r.is_ AND r.k - r.last <= 4 AND r.other = x.other) SELECT doc_id, k, trim(regexp_extract(b, '{_RE(segments.AUTHOR)}', 1)) AS nombre FROM r WHERE is_ AND trim(regexp_extract(b, '{_RE(segments.AUTHOR)}', 1)) <> '' UNION ALL SELECT doc_id, k, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_extract(b, '{segments.DOCTOR}', 1), '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM h",
    "text_blocks": f"WITH {_T}, p AS (SELECT doc_id, string_split(texto, chr(10) || chr(10)) AS p FROM t), k AS (SELECT doc_id, p, unnest(range(0, len(p))) AS k FROM p), b AS (SELECT doc_id AS id, coalesce(list_sum(list_transform(p[:k], lambda x: length(x) + 2)), 0)::INT AS inicio, p[k + 1] AS x FROM k) SELECT id, inicio, (inicio + length(x))::INT AS fin, md5(x) AS hash FROM b WHERE x <> ''",
    "number_parts": r"SELECT DISTINCT num, TRY_CAST(regexp_extract(num, '^\s*(\d+)', 1) AS INT) AS base FROM normas WHERE num IS NOT NULL",
    "norm_validity": rf"WITH {_T}, n AS (SELECT doc_id, regexp_extract_all(texto, '(?s)\{{\{{(.*?)\}}\}}', 1) AS n FROM t) SELECT doc_id, len(n) AS notes, regexp_matches(lower(array_to_string(n, ' ')), '\bderogad[oa]\b') AS derogado, regexp_matches(lower(array_to_string(n, ' ')), '\binexequible\b') AS parcial FROM n",
    "article_chunks": "WITH n AS (SELECT DISTINCT doc_id, num, bloques FROM normas), b AS (SELECT DISTINCT doc_id, 'art_' || num AS art, b.texto AS texto, b.inicio AS inicio, b.fin AS fin FROM (SELECT doc_id, num, unnest(bloques) AS b FROM n)), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, art ORDER BY inicio, fin) AS parte_k, count(*) OVER (PARTITION BY doc_id, art) AS parte_n, row_number() OVER (PARTITION BY doc_id ORDER BY inicio, fin) - 1 AS posicion FROM b) SELECT doc_id || '#' || coalesce(art, 'preambulo') || '#p' || parte_k AS chunk_id, doc_id, posicion, parte_k, parte_n, sha1(texto) AS sha1_texto FROM c",
}
