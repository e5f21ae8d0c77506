"""Queries of document structure: parts, pages, headers, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import text as T
from tamiz.functions import urls as U
from tamiz.operators import answers, measures, segments
from tamiz.plans.citing import _items, bodies_sql
from tamiz.plans.registry import _fuentes, dup_survivor, key_sql, _SURVIVOR
from tamiz.plans.retrieval import bm25_sql, bm25_topk
from tamiz.plans.textual import fold
from tamiz.sources.readers import scan_is_unreadable, split_parts
from tamiz.sources.sinks import fingerprint
from tamiz.session import table


def part_splitter(s: SparkSession, d: str) -> DataFrame:
    """Parts written into one document with their marks and split again, with offsets."""
    t = table(s, d, "texto").where("doc_id is not null and markdown is not null").select("doc_id", "texto_id", F.btrim("markdown", F.lit("\n")).alias("m")).where("m != ''")
    marked = F.concat(F.lit("<!-- parte "), F.col("texto_id").cast("string"), F.lit(" | http://x/"), F.col("texto_id").cast("string"), F.lit(" -->\n"), F.col("m"))
    docs = t.withColumn("p", marked).groupBy("doc_id").agg(F.expr("listagg(p, '\n\n') within group (order by texto_id)").alias("cuerpo"))
    p = split_parts(docs)
    return p.select("doc_id", F.col("archivo").cast("bigint").alias("texto_id"), "url", "inicio", F.md5(F.col("texto").cast("binary")).alias("hash"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Pages made of the registry: a title, furniture, a script and the alternative addresses as links."""
    f = _fuentes(s, d).where("doc_id is not null and titulo is not null and urls_alternativas is not null").select("doc_id", "titulo", "registrado", "urls_alternativas")
    links = F.array_join(F.transform("urls_alternativas", lambda u: F.concat(F.lit('<a class="x" href="'), u, F.lit('">enlace</a>'))), " ")
    html = F.concat(F.lit("<html><head><title> "), F.col("titulo"), F.lit(" </title><script>var a = 1;</script></head><body><nav>menu</nav><p>"), F.col("titulo"), F.lit('</p><a href="javascript:void(0)">no</a> '), links, F.lit("</body></html>"))
    return f.select("doc_id", "registrado", html.alias("html"))


def outlinks(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("doc_id", F.explode(U.outlinks(F.col("html"))).alias("url"))


def page_title(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("doc_id", U.page_title(F.col("html")).alias("title")).distinct()


def strip_tags(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("doc_id", F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("hash")).distinct()


def run_comparison(s: SparkSession, d: str) -> DataFrame:
    return measures.compare_rankings(bm25_topk(s, d), bm25_topk(s, d, 10, True))


def empty_fields(s: SparkSession, d: str) -> DataFrame:
    return measures.emptiness(table(s, d, "preguntas"), ["opciones", "tema", "complejidad", "legal_basis", "respuesta_correcta", "respuesta_esperada"])


def answer_medians(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").select("formato", T.word_count(F.col("pregunta")).alias("q"), F.when(F.col("respuesta_esperada").isNotNull(), T.word_count(F.col("respuesta_esperada"))).alias("a"))
    return p.groupBy("formato").agg(F.median("q").alias("median_question"), F.median("a").alias("median_answer"))


def stage_pivot(s: SparkSession, d: str) -> DataFrame:
    f = _fuentes(s, d).select("tipo_norma", F.coalesce("estado", F.lit("none")).alias("estado"))
    return f.groupBy("tipo_norma").pivot("estado", ["ok", "error", "pendiente", "none"]).count().na.fill(0)


def largest_groups(s: SparkSession, d: str) -> DataFrame:
    g = dup_survivor(s, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("survivor").alias("survivor"))
    return g.orderBy(F.desc("n"), "component").limit(25)


def named_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions that name a norm of the corpus."""
    q = _items(s, d).select("id", F.explode_outer(C.bodies(F.concat_ws(" ", "pregunta", "legal_basis"))).alias("norma_id"))
    return q.join(_fuentes(s, d).select("norma_id").distinct(), "norma_id", "left_semi").select("id").distinct()


def relevant_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents that cite a norm of a question's basis: set overlap as an equi-join of exploded ids."""
    q = _items(s, d).select("id", F.explode_outer(C.bodies(F.col("legal_basis"))).alias("norm")).where("norm is not null")
    docs = table(s, d, "documents").select("doc_id", C.bodies(F.col("text")).alias("b")).select("doc_id", F.explode_outer("b").alias("norm")).where("norm is not null")
    return docs.join(q, "norm").select("id", "doc_id").distinct()


def context_headers(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "normas").select("art_id", "norma_id", "jerarquia", "num", "titulo", "bloques").distinct()
    h = segments.context_header(F.col("norma_id"), F.col("jerarquia"), F.col("num"), F.col("titulo"), F.lit(1), F.size("bloques"))
    return n.select("art_id", h.alias("header"))


def next_headers(s: SparkSession, d: str) -> DataFrame:
    """For every header line, the number of lines to the next one of its text; null for the last."""
    lines = table(s, d, "leer").where("texto is not null").select("doc_id", "texto").distinct().select("doc_id", F.posexplode(F.split("texto", "\n")).alias("k", "line")).where(T.is_header_line(F.col("line")))
    return lines.select("doc_id", "k", (F.lead("k").over(Window.partitionBy("doc_id").orderBy("k")) - F.col("k")).alias("lines"))


def unreadable_scans(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "texto").where("markdown is not null and metodo = 'pdf_texto'")
    return t.select("texto_id", scan_is_unreadable(F.col("markdown"), F.coalesce("paginas", F.lit(1))).alias("unreadable"))


def known_links(s: SparkSession, d: str) -> DataFrame:
    """Alternative addresses whose norm is registered, with the first document of it."""
    known = _fuentes(s, d).where("url is not null and doc_id is not null").groupBy(U.url_key(F.col("url")).alias("key")).agg(F.min("doc_id").alias("known_id"))
    links = _fuentes(s, d).select(F.explode("urls_alternativas").alias("url")).where("url is not null").distinct().withColumn("key", U.url_key(F.col("url")))
    return links.join(known, "key").select("url", "known_id")


def year_pivot(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 120).alias("y"))
    return p.select("p_partkey", T.year4(F.col("y")).alias("year"))


def table_fingerprints(s: SparkSession, d: str) -> DataFrame:
    names = {"leer": ["doc_id", "texto"], "preguntas": ["id", "pregunta"], "documents": ["doc_id", "text"]}
    out = None
    for n, cols in names.items():
        part = fingerprint(table(s, d, n), *cols).select(F.lit(n).alias("name"), "n", F.col("checksum").cast("string").alias("checksum"))
        out = part if out is None else out.unionByName(part)
    return out


def reranked(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "preguntas").where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("pregunta").alias("q"))
    pairs = bm25_topk(s, d).join(q, "qid").join(table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("texto")), "row_id")
    return answers.scored(pairs, answers.overlap_scorer).select("qid", "row_id", F.round("puntaje", 6).alias("puntaje"))


_HTML = """pages AS (SELECT doc_id, titulo, urls_alternativas AS u FROM fuentes WHERE doc_id IS NOT NULL AND titulo IS NOT NULL AND urls_alternativas IS NOT NULL)"""
QUERIES = {
    "part_splitter": part_splitter, "outlinks": outlinks, "page_title": page_title, "strip_tags": strip_tags, "run_comparison": run_comparison, "empty_fields": empty_fields, "answer_medians": answer_medians, "stage_pivot": stage_pivot, "largest_groups": largest_groups,
    "named_questions": named_questions, "relevant_documents": relevant_documents, "context_headers": context_headers, "next_headers": next_headers, "unreadable_scans": unreadable_scans, "known_links": known_links, "year_pivot": year_pivot,
    "table_fingerprints": table_fingerprints, "reranked": reranked,
}
SQL = {
    "part_splitter": "WITH t AS (SELECT doc_id, texto_id, trim(markdown, chr(10)) AS m FROM texto WHERE doc_id IS NOT NULL AND markdown IS NOT NULL AND trim(markdown, chr(10)) <> '') SELECT doc_id, texto_id, 'http://x/' || texto_id AS url, coalesce(sum(length(m) + 2) OVER (PARTITION BY doc_id ORDER BY texto_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS inicio, md5(m) AS hash FROM t",
    "outlinks": f"WITH {_HTML} SELECT doc_id, x AS url FROM (SELECT doc_id, unnest(u) AS x FROM pages) WHERE x IS NOT NULL AND x <> ''",
    "page_title": f"WITH {_HTML} SELECT DISTINCT doc_id, trim(titulo) AS title FROM pages",
    "strip_tags": rf"WITH {_HTML} SELECT DISTINCT doc_id, md5(trim(regexp_replace(titulo || ' ' || titulo || ' no ' || array_to_string(list_transform(list_filter(u, lambda x: x IS NOT NULL), lambda x: 'enlace'), ' '), '\s+', ' ', 'g'))) AS hash FROM pages",
    "run_comparison": f"WITH a AS (WITH {bm25_sql(10)} SELECT qid, list(row_id ORDER BY rank) AS x FROM bm GROUP BY qid), b AS (WITH {bm25_sql(10, True)} SELECT qid, list(row_id ORDER BY rank) AS y FROM bm GROUP BY qid) SELECT qid, len(list_intersect(x, y)) AS both, len(list_filter(x, lambda i: NOT list_contains(y, i))) AS only_a, len(list_filter(y, lambda i: NOT list_contains(x, i))) AS only_b, list_sort(x) = list_sort(y) AS same_set, x = y AS same_order FROM a JOIN b USING (qid)",
    "empty_fields": "SELECT unnest(['opciones', 'tema', 'complejidad', 'legal_basis', 'respuesta_correcta', 'respuesta_esperada']) AS \"column\", unnest([count(*) FILTER (opciones IS NULL OR cardinality(opciones) = 0), count(*) FILTER (tema IS NULL OR tema = ''), count(*) FILTER (complejidad IS NULL OR complejidad = ''), count(*) FILTER (legal_basis IS NULL OR legal_basis = ''), count(*) FILTER (respuesta_correcta IS NULL OR respuesta_correcta = ''), count(*) FILTER (respuesta_esperada IS NULL OR respuesta_esperada = '')]) AS n_empty FROM preguntas",
    "answer_medians": r"SELECT formato, median(len(list_filter(regexp_split_to_array(pregunta, '\s+'), lambda x: x <> ''))) AS median_question, median(len(list_filter(regexp_split_to_array(respuesta_esperada, '\s+'), lambda x: x <> ''))) AS median_answer FROM preguntas GROUP BY formato",
    "stage_pivot": "SELECT tipo_norma, count(*) FILTER (estado = 'ok') AS ok, count(*) FILTER (estado = 'error') AS error, count(*) FILTER (estado = 'pendiente') AS pendiente, count(*) FILTER (estado IS NULL) AS none FROM fuentes GROUP BY tipo_norma",
    "largest_groups": f"WITH {_SURVIVOR} SELECT component, count(*) AS n, min(survivor) AS survivor FROM p GROUP BY component ORDER BY n DESC, component LIMIT 25",
    "named_questions": "WITH q AS (SELECT id, unnest(" + bodies_sql("concat_ws(' ', pregunta, legal_basis)") + ") AS n FROM preguntas) SELECT DISTINCT id FROM q WHERE n IN (SELECT norma_id FROM fuentes WHERE norma_id IS NOT NULL)",
    "relevant_documents": f"WITH q AS (SELECT id, unnest({bodies_sql('legal_basis')}) AS n FROM preguntas), d AS (SELECT doc_id, unnest({bodies_sql('text')}) AS n FROM documents) SELECT DISTINCT id, doc_id FROM q JOIN d USING (n)",
    "context_headers": "SELECT DISTINCT art_id, concat_ws('. ', norma_id, nullif(jerarquia, ''), 'Artículo ' || num, nullif(titulo, ''), CASE WHEN len(bloques) > 1 THEN '(parte 1/' || len(bloques) || ')' END) AS header FROM normas",
    "next_headers": rf"WITH t AS (SELECT DISTINCT doc_id, texto FROM leer WHERE texto IS NOT NULL), l AS (SELECT doc_id, unnest(string_split(texto, chr(10))) AS line, (generate_subscripts(string_split(texto, chr(10)), 1) - 1)::INT AS k FROM t), h AS (SELECT doc_id, k FROM l WHERE regexp_matches(lower({fold('line')}), '^\s*#*\s*(articulo|art\.|capitulo|titulo|libro|seccion|paragrafo)\b')) SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k AS lines FROM h",
    "unreadable_scans": r"SELECT texto_id, (length(markdown) / greatest(coalesce(paginas, 1), 1) < 100) OR (length(markdown) - length(regexp_replace(markdown, '[^\x09\x0A\x20-\x7EÀ-ÿ“”‘’–—…]', '', 'g'))) > 0.02 * length(markdown) AS unreadable FROM texto WHERE markdown IS NOT NULL AND metodo = 'pdf_texto'",
    "known_links": f"WITH k AS (SELECT {key_sql('url')} AS key, min(doc_id) AS known_id FROM fuentes WHERE url IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1), l AS (SELECT DISTINCT url, {key_sql('url')} AS key FROM (SELECT unnest(urls_alternativas) AS url FROM fuentes) WHERE url IS NOT NULL) SELECT url, known_id FROM l JOIN k USING (key)",
    "year_pivot": "SELECT p_partkey, CASE WHEN p_partkey % 120 < 50 THEN p_partkey % 120 + 2000 WHEN p_partkey % 120 < 100 THEN p_partkey % 120 + 1900 ELSE p_partkey % 120 END AS year FROM part",
}
