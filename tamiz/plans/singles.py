"""Queries of single functions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.functions import urls as U
from tamiz.operators import answers, dense, fusion, measures
from tamiz.plans.corpus import _CAT, _catalog
from tamiz.plans.textual import words
from tamiz.session import table
from tamiz.sources import readers, sinks


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "texto").where("markdown is not null").select("texto_id", "markdown")


def stripped_controls(s: SparkSession, d: str) -> DataFrame:
    t = _parts(s, d).withColumn("t", F.concat(F.lit("\u0007a ​\tb\n"), "markdown"))
    return t.select("texto_id", F.md5(T.strip_control(F.col("t"))).alias("hash"))


def json_objects(s: SparkSession, d: str) -> DataFrame:
    """The object in a noisy model output; null where there is none."""
    p = table(s, d, "preguntas").select("id", F.expr("CASE id % 3 WHEN 0 THEN concat('Claro: {\"id\": ', id, ', \"x\": {\"y\": 1}} listo') WHEN 1 THEN concat('sin objeto ', id) END").alias("t"))
    return p.select("id", T.json_object(F.col("t")).alias("objeto"))


def judgment_urls(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas")
    return p.select("id", U.judgment_url("https://x/", F.lit("C"), F.col("id") % 1200, F.col("id") % 60 + 1970).alias("url"))


def odd_addresses(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "fuentes").where("url is not null").select("url").distinct()
    u = u.select(F.explode(F.array("url", F.concat("url", F.lit("?Login=1")))).alias("url"))
    return u.groupBy(U.looks_odd(F.col("url")).alias("rara"), U.is_normative_host(F.col("url"), ["normas", "gaceta"]).alias("normativa")).agg(F.count(F.lit(1)).alias("n"))


def catalog_bridge(s: SparkSession, d: str) -> DataFrame:
    """Rows of the catalog under their full id and under their norm."""
    return fusion.bridge(_catalog(s, d))


def byte_formats(s: SparkSession, d: str) -> DataFrame:
    head = F.expr("CASE texto_id % 4 WHEN 0 THEN unhex('255044462D312E34') WHEN 1 THEN unhex('504B030414000600') WHEN 2 THEN unhex('D0CF11E0A1B11AE1') ELSE CAST(markdown AS binary) END")
    return _parts(s, d).groupBy(readers.sniff(head).alias("formato")).agg(F.count(F.lit(1)).alias("n"))


def softmaxed(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").select("id", F.expr("array(id % 7 / 2.0D, id % 5 / 2.0D, id % 3 / 2.0D)").alias("v"))
    return p.select("id", F.transform(measures.softmax(F.col("v")), lambda x: F.round(x, 4)).alias("p"))


def distinct_keywords(s: SparkSession, d: str) -> DataFrame:
    """Keywords that differ by more than case, the first eight."""
    p = table(s, d, "preguntas").select("id", F.slice(F.split("pregunta", " "), 1, 12).alias("w"))
    return p.select("id", F.array_join(answers.distinct_ignoring_case(F.concat("w", F.transform("w", F.upper)), 8), "|").alias("claves"))


def vector_similarity(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("otro"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("otro")), 4).alias("coseno"))


def option_coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of an item's options with a passage of their own among the first eight."""
    items = table(s, d, "preguntas").where("opciones is not null").select("id", "opciones")
    p = items.select(F.col("id").alias("qid"), F.posexplode(F.sort_array(F.map_keys("opciones"))).alias("k", "opcion"))
    p = p.select("qid", "opcion", (F.col("k") * (F.col("qid") % 4 + 1) + 1).alias("rank"), F.when((F.col("qid") + F.col("k")) % 5 == 0, "hibrido").otherwise("opcion").alias("via"))
    return answers.option_coverage(p, items)


def stale_documents(s: SparkSession, d: str) -> DataFrame:
    """Registered documents that have no text any more."""
    return sinks.stale(table(s, d, "fuentes").where("doc_id is not null"), table(s, d, "leer"), "doc_id")


def expanded_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries with the longest title of every norm they name."""
    names = table(s, d, "fuentes").where("norma_id is not null and titulo is not null").select(F.col("norma_id").alias("canon"), F.concat(F.lit("Estatuto de "), "titulo").alias("name"))
    q = names.select("canon").distinct().select(F.xxhash64("canon").alias("qid"), "canon", F.concat(F.lit("Qué dice la "), F.initcap(F.regexp_replace(F.regexp_replace("canon", "_(\\d{4})$", " de $1"), "_", " ")), F.lit("?")).alias("q"))
    x = answers.expand_aliases(q.select("qid", "q"), names).join(q.select("qid", "canon"), "qid")
    return x.select("canon", F.col("q").alias("consulta"), "added")


def first_words(s: SparkSession, d: str) -> DataFrame:
    """Answers cut to two sentences and forty words by the quick splitter."""
    p = table(s, d, "preguntas").where("respuesta_esperada is not null")
    return p.select("id", T.truncate_sentences(F.concat("respuesta_esperada", F.lit(" Conforme. Así es.")), 3, 40).alias("corto"))


_SM = "list_transform(v, lambda x: exp(x - list_max(v)))"
QUERIES = {
    "stripped_controls": stripped_controls, "json_objects": json_objects, "judgment_urls": judgment_urls, "odd_addresses": odd_addresses, "catalog_bridge": catalog_bridge, "byte_formats": byte_formats, "softmaxed": softmaxed,
    "distinct_keywords": distinct_keywords, "vector_similarity": vector_similarity, "option_coverage": option_coverage, "stale_documents": stale_documents, "expanded_queries": expanded_queries, "first_words": first_words,
}
SQL = {
    "stripped_controls": r"SELECT texto_id, md5(regexp_replace(replace(chr(7) || 'a' || chr(160) || chr(8203) || chr(9) || 'b' || chr(10) || markdown, chr(160), ' '), '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}\p{Cf}]', '', 'g')) AS hash FROM texto WHERE markdown IS NOT NULL",
    "json_objects": "SELECT id, CASE id % 3 WHEN 0 THEN '{\"id\": ' || id || ', \"x\": {\"y\": 1}}' END AS objeto FROM preguntas",
    "judgment_urls": "SELECT id, 'https://x/c-' || CASE WHEN id % 1200 < 1000 THEN lpad((id % 1200)::VARCHAR, 3, '0') ELSE (id % 1200)::VARCHAR END || '-' || lpad(((id % 60 + 1970) % 100)::VARCHAR, 2, '0') || '.htm' AS url FROM preguntas",
    "odd_addresses": r"WITH u AS (SELECT unnest([url, url || '?Login=1']) AS url FROM (SELECT DISTINCT url FROM fuentes WHERE url IS NOT NULL)) SELECT regexp_matches(lower(url), '(login|session|sesion|buscar|search|captcha)') AS rara, regexp_matches(lower(regexp_extract(url, '^(?:[hH][tT][tT][pP][sS]?://)?([^/?#:\s]+)', 1)), 'normas|gaceta') AS normativa, count(*) AS n FROM u GROUP BY ALL",
    "catalog_bridge": f"WITH {_CAT} SELECT canon, row_id FROM ct UNION ALL SELECT base, row_id FROM ct",
    "byte_formats": "SELECT CASE texto_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'doc' ELSE 'html' END AS formato, count(*) AS n FROM texto WHERE markdown IS NOT NULL GROUP BY 1",
    "softmaxed": f"WITH p AS (SELECT id, [id % 7 / 2.0::DOUBLE, id % 5 / 2.0::DOUBLE, id % 3 / 2.0::DOUBLE] AS v FROM preguntas) SELECT id, list_transform({_SM}, lambda y: round(y / list_sum({_SM}), 4)) AS p FROM p",
    "distinct_keywords": "WITH p AS (SELECT id, string_split(pregunta, ' ')[1:12] AS w FROM preguntas), u AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM p), f AS (SELECT id, w, k FROM u QUALIFY row_number() OVER (PARTITION BY id, lower(w) ORDER BY k) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM f) SELECT id, string_agg(w, '|' ORDER BY k) AS claves FROM r WHERE n <= 8 GROUP BY id",
    "vector_similarity": "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) AS coseno FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "option_coverage": "WITH p AS (SELECT id, list_sort(map_keys(opciones)) AS l FROM preguntas WHERE opciones IS NOT NULL), u AS (SELECT id, len(l) AS n, unnest(range(0, len(l))) AS k FROM p) SELECT id AS qid, round(count(*) FILTER (k * (id % 4 + 1) + 1 <= 8 AND (id + k) % 5 <> 0) / any_value(n)::DOUBLE, 4) AS coverage FROM u GROUP BY id",
    "stale_documents": "SELECT DISTINCT doc_id FROM fuentes WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM leer WHERE doc_id IS NOT NULL)",
    "expanded_queries": r"WITH n AS (SELECT norma_id AS canon, 'Estatuto de ' || titulo AS name FROM fuentes WHERE norma_id IS NOT NULL AND titulo IS NOT NULL), l AS (SELECT canon, arg_max(name, (length(name), name)) AS name FROM n GROUP BY canon), q AS (SELECT canon, name, 'Qué dice la ' || upper(canon[1]) || replace(regexp_replace(canon[2:], '_(\d{4})$', ' de \1'), '_', ' ') AS q FROM l) SELECT canon, replace(q, ' de ', ' De ') || '? ' || name AS consulta, 1 AS added FROM q",
    "first_words": f"WITH p AS (SELECT id, list_filter(string_split(regexp_replace(respuesta_esperada || ' Conforme. Así es.', '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s, {words(chr(114) + 'espuesta_esperada || ' + chr(39) + ' Conforme. Así es.' + chr(39))} AS w FROM preguntas WHERE respuesta_esperada IS NOT NULL), u AS (SELECT id, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM p), r AS (SELECT id, x, k, sum(len({words('x')})) OVER (PARTITION BY id ORDER BY k) AS run FROM u), g AS (SELECT id, string_agg(x, ' ' ORDER BY k) FILTER (k <= 3 AND run <= 40) AS t FROM r GROUP BY id) SELECT p.id, coalesce(t, regexp_replace(array_to_string(w[1:40], ' '), '[.,;:]+$', '') || '.') AS corto FROM p JOIN g USING (id)",
}
