"""Queries over the registry of documents: identity, duplicates, links, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.functions import urls as U
from tamiz.operators import identity
from tamiz.operators.paragraphs import part_of
from tamiz.session import table


def _fuentes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fuentes")


def latest_records(s: SparkSession, d: str) -> DataFrame:
    r = identity.latest(_fuentes(s, d).select("doc_id", "titulo", "estado", "n_caracteres", "registrado"), "doc_id", F.col("registrado"))
    return r.select("doc_id", "titulo", "estado", "n_caracteres")


def url_keys(s: SparkSession, d: str) -> DataFrame:
    u = _fuentes(s, d).where("url is not null").select("url").distinct()
    return u.select("url", U.host(F.col("url")).alias("host"), U.url_key(F.col("url")).alias("key"))


def source_inventory(s: SparkSession, d: str) -> DataFrame:
    return _fuentes(s, d).groupBy("fuente").agg(F.countDistinct("doc_id").alias("docs"), F.sum("n_caracteres").alias("chars"), F.count_if(F.col("ocr")).alias("ocr"), F.round(F.avg("n_articulos_detectados"), 4).alias("articles"))


def area_inventory(s: SparkSession, d: str) -> DataFrame:
    a = _fuentes(s, d).select("doc_id", F.explode("areas").alias("area")).distinct()
    return a.groupBy("area").agg(F.count(F.lit(1)).alias("docs"))


def link_in_degree(s: SparkSession, d: str) -> DataFrame:
    links = _fuentes(s, d).select("doc_id", F.explode("urls_alternativas").alias("url"))
    g = identity.in_degree(links, U.url_key(F.col("url")), F.lower(F.col("url")).contains("gaceta"))
    return g.select("key", "links", "sources", "url", F.array_join("from_docs", ",").alias("from_docs"))


def frontier_round(s: SparkSession, d: str) -> DataFrame:
    links = _fuentes(s, d).select("doc_id", F.explode("urls_alternativas").alias("url"))
    cand = identity.in_degree(links, U.url_key(F.col("url")), F.lit(False)).select("key", "url", "links")
    attempted = _fuentes(s, d).where("url is not null").select(U.url_key(F.col("url")).alias("key"))
    return identity.frontier(cand, attempted, 1).select("key", "url", "links")


def dup_components(s: SparkSession, d: str) -> DataFrame:
    """Documents of one norm: the same id, the same address or the same long text, directly or through others."""
    r = _fuentes(s, d).where("doc_id is not null").select("doc_id", F.array("norma_id", F.when(F.col("url").isNotNull(), F.concat(F.lit("u:"), U.url_key(F.col("url"))))).alias("keys"))
    ids = r.select("doc_id").distinct()
    texts = table(s, d, "leer").where("texto is not null").join(ids, "doc_id", "left_semi").select("doc_id", F.array(F.concat(F.lit("t:"), T.long_text_hash(F.col("texto")))).alias("keys"))
    return identity.same_keys(r.unionByName(texts)).select("doc_id", "component")


def dup_survivor(s: SparkSession, d: str) -> DataFrame:
    cols = ["doc_id", "url", "estado", "canonico", "origen", "n_articulos_detectados", "n_caracteres", "registrado"]
    once = identity.latest(_fuentes(s, d).select(*cols), "doc_id", F.col("registrado"))
    return identity.survivors(once, dup_components(s, d)).select("doc_id", "component", "place", "survivor", "motivo")


def discarded_copies(s: SparkSession, d: str) -> DataFrame:
    x = dup_survivor(s, d).where("place > 1")
    return x.groupBy("survivor").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("discarded"))


def norm_ids(s: SparkSession, d: str) -> DataFrame:
    f = _fuentes(s, d).where("tipo_norma is not null and numero is not null and anio is not null").select("tipo_norma", "numero", "anio").distinct()
    return f.select("tipo_norma", "numero", "anio", U.norm_id(F.col("tipo_norma"), F.col("numero"), F.col("anio")).alias("id"))


def title_types(s: SparkSession, d: str) -> DataFrame:
    return _fuentes(s, d).groupBy(U.norm_type(F.col("titulo")).alias("type"), "tipo_norma").agg(F.count(F.lit(1)).alias("n"))


def unique_ids(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "texto").where("doc_id is not null").select("texto_id", "doc_id")
    return identity.unique_ids(t, "doc_id", "texto_id").select("texto_id", "id")


def merged_deliveries(s: SparkSession, d: str) -> DataFrame:
    rows = _fuentes(s, d).where("doc_id is not null").select("doc_id", "fuente", "registrado", "items_del_banco", "areas")
    m = identity.merge_lists(rows, "doc_id", ["fuente"], "registrado", ["items_del_banco"], ["areas"])
    return m.select("doc_id", "fuente", "items_del_banco", F.array_join(F.sort_array("areas"), ",").alias("areas"))


def stored_and_attempted(s: SparkSession, d: str) -> DataFrame:
    k = _fuentes(s, d).where("url is not null").select(U.url_key(F.col("url")).alias("key"), "estado")
    return k.groupBy("key").agg(F.bool_or(F.coalesce(F.col("estado") == "ok", F.lit(False))).alias("stored"))


def retry_list(s: SparkSession, d: str) -> DataFrame:
    """Documents without text whose record is missing or not ``ok``."""
    have = table(s, d, "leer").select("doc_id").distinct()
    f = identity.latest(_fuentes(s, d).select("doc_id", "estado", "registrado"), "doc_id", F.col("registrado"))
    return f.where("coalesce(estado, '') != 'ok'").join(have, "doc_id", "left_anti").select("doc_id", "estado")


def origin_filter(s: SparkSession, d: str) -> DataFrame:
    """Documents of no unwanted origin; a null origin is never left out."""
    return _fuentes(s, d).where(F.col("origen").isNull() | ~F.col("origen").isin("enriquecimiento", "enlaces")).select("doc_id", "origen").distinct()


def asof_source(s: SparkSession, d: str) -> DataFrame:
    """Address of the part in which each article begins."""
    n = table(s, d, "normas").select("art_id", "doc_id", F.element_at("bloques", 1)["inicio"].alias("inicio")).distinct()
    parts = table(s, d, "leer").select("doc_id", "partes").distinct()
    j = n.join(parts, "doc_id").where("inicio is not null and size(partes) > 0")
    return j.select("art_id", "doc_id", part_of(F.col("partes"), F.col("inicio")).alias("url"))


def late_arrivals(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "texto").where("descargado is not null and recibido is not null")
    days = F.floor((F.unix_timestamp("recibido") - F.unix_timestamp("descargado")) / 86400).alias("days")
    return t.select("metodo", days).groupBy("metodo", "days").agg(F.count(F.lit(1)).alias("n"))


def redelivered_parts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "texto").select("texto_id", "doc_id", "archivo", F.sha1(F.col("markdown").cast("binary")).alias("h"))
    n = F.min("texto_id").over(Window.partitionBy("doc_id", "archivo", "h"))
    return t.withColumn("first_id", n).where("texto_id != first_id").select("texto_id", "first_id")


_KEY = r"""CASE WHEN regexp_matches({p}, '(ley|decreto|resolucion|acuerdo|circular|sentencia|auto)[_-]0*(\d+)[_-](\d{{4}})')
THEN regexp_extract({p}, '(ley|decreto|resolucion|acuerdo|circular|sentencia|auto)[_-]0*(\d+)[_-](\d{{4}})', 1) || '_' || regexp_extract({p}, '(ley|decreto|resolucion|acuerdo|circular|sentencia|auto)[_-]0*(\d+)[_-](\d{{4}})', 2) || '_' || regexp_extract({p}, '(ley|decreto|resolucion|acuerdo|circular|sentencia|auto)[_-]0*(\d+)[_-](\d{{4}})', 3)
ELSE regexp_replace(regexp_replace({p}, '\.(html?|pdf|docx?|php|jsp)$', ''), '/$', '') END"""


def key_sql(c: str) -> str:
    return _KEY.format(p=rf"regexp_replace(regexp_replace(lower(trim({c})), '#.*$', ''), '^https?://(www\.)?', '')")


_LATEST = "l AS (SELECT * FROM fuentes WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY registrado DESC) = 1)"
_COMPONENTS = rf"""e AS (SELECT DISTINCT doc_id, norma_id AS k FROM fuentes WHERE doc_id IS NOT NULL AND norma_id IS NOT NULL UNION SELECT DISTINCT doc_id, 'u:' || {key_sql('url')} FROM fuentes WHERE doc_id IS NOT NULL AND url IS NOT NULL
UNION SELECT DISTINCT doc_id, 't:' || sha1(trim(regexp_replace(lower(texto), '\s+', ' ', 'g'))) FROM leer WHERE length(texto) >= 500 AND doc_id IN (SELECT doc_id FROM fuentes WHERE doc_id IS NOT NULL)),
pr AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (k)), rc AS (SELECT doc_id AS x, doc_id AS y FROM fuentes WHERE doc_id IS NOT NULL UNION SELECT rc.x, pr.y FROM rc JOIN pr ON pr.x = rc.y), cp AS (SELECT x AS doc_id, min(y) AS component FROM rc GROUP BY x)"""
_PREFER = "(coalesce(estado, '') <> 'ok')::INT AS p1, (canonico IS NULL)::INT AS p2, (origen IS NOT NULL)::INT AS p3, (NOT coalesce(contains(lower(url), 'gaceta'), false))::INT AS p4, -coalesce(n_articulos_detectados, 0) AS p5, -coalesce(n_caracteres, 0) AS p6"
_ORDER = "p1, p2, p3, p4, p5, p6, length(doc_id), doc_id"
_SURVIVOR = f"RECURSIVE {_COMPONENTS}, {_LATEST}, y AS (SELECT doc_id, component, {_PREFER} FROM l JOIN cp USING (doc_id)), z AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY {_ORDER}) AS place, first_value(doc_id) OVER (PARTITION BY component ORDER BY {_ORDER}) AS survivor, first_value(doc_id) OVER (PARTITION BY component ORDER BY length(doc_id), doc_id) AS expected FROM y), p AS (SELECT z.doc_id, z.component, z.place, z.survivor, CASE WHEN z.survivor = z.expected THEN NULL WHEN s.p1 <> x.p1 THEN 'estado' WHEN s.p2 <> x.p2 THEN 'canonico' WHEN s.p3 <> x.p3 THEN 'origen' WHEN s.p4 <> x.p4 THEN 'fuente' WHEN s.p5 <> x.p5 THEN 'articulos' WHEN s.p6 <> x.p6 THEN 'texto' ELSE 'id' END AS motivo FROM z JOIN y s ON s.doc_id = z.survivor JOIN y x ON x.doc_id = z.expected)"
_LINKS = f"k AS (SELECT doc_id, url, {key_sql('url')} AS key FROM (SELECT doc_id, unnest(urls_alternativas) AS url FROM fuentes) WHERE url IS NOT NULL)"

QUERIES = {
    "latest_records": latest_records, "url_key": url_keys, "source_inventory": source_inventory, "area_inventory": area_inventory, "link_in_degree": link_in_degree, "frontier_round": frontier_round, "dup_components": dup_components,
    "dup_survivor": dup_survivor, "discarded_copies": discarded_copies, "norm_ids": norm_ids, "title_types": title_types, "unique_ids": unique_ids, "merged_deliveries": merged_deliveries, "stored_and_attempted": stored_and_attempted,
    "retry_list": retry_list, "origin_filter": origin_filter, "asof_source": asof_source, "late_arrivals": late_arrivals, "redelivered_parts": redelivered_parts,
}
SQL = {
    "latest_records": f"WITH {_LATEST} SELECT doc_id, titulo, estado, n_caracteres FROM l",
    "url_key": rf"SELECT url, regexp_replace(lower(regexp_extract(url, '^(?:[hH][tT][tT][pP][sS]?://)?([^/?#:\s]+)', 1)), '^www\.', '') AS host, {key_sql('url')} AS key FROM (SELECT DISTINCT url FROM fuentes WHERE url IS NOT NULL)",
    "source_inventory": "SELECT fuente, count(DISTINCT doc_id) AS docs, sum(n_caracteres) AS chars, count(*) FILTER (ocr) AS ocr, round(avg(n_articulos_detectados), 4) AS articles FROM fuentes GROUP BY fuente",
    "area_inventory": "SELECT area, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(areas) AS area FROM fuentes) GROUP BY area",
    "link_in_degree": f"WITH {_LINKS} SELECT key, count(*) AS links, count(DISTINCT doc_id) AS sources, arg_min(url, (NOT contains(lower(url), 'gaceta'), length(url), url)) AS url, array_to_string(list_sort(list(DISTINCT doc_id))[1:10], ',') AS from_docs FROM k GROUP BY key",
    "frontier_round": f"WITH {_LINKS}, g AS (SELECT key, count(*) AS links, arg_min(url, (length(url), url)) AS url FROM k GROUP BY key HAVING count(*) > 1), a AS (SELECT DISTINCT {key_sql('url')} AS key FROM fuentes WHERE url IS NOT NULL) SELECT key, url, links FROM g WHERE key NOT IN (SELECT key FROM a)",
    "dup_components": f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, component FROM cp",
    "dup_survivor": f"WITH {_SURVIVOR} SELECT doc_id, component, place, survivor, motivo FROM p",
    "discarded_copies": f"WITH {_SURVIVOR} SELECT survivor, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS discarded FROM p WHERE place > 1 GROUP BY survivor",
    "norm_ids": r"SELECT DISTINCT tipo_norma, numero, anio, lower(tipo_norma) || '_' || CASE WHEN regexp_matches(numero, '^\d+$') THEN coalesce(nullif(ltrim(numero, '0'), ''), '0') ELSE lower(numero) END || '_' || anio AS id FROM fuentes WHERE tipo_norma IS NOT NULL AND numero IS NOT NULL AND anio IS NOT NULL",
    "title_types": r"SELECT coalesce(nullif(regexp_extract(lower(strip_accents(titulo)), '^\s*(ley|decreto|resolucion|acuerdo|circular|sentencia|auto|codigo)\b', 1), ''), 'otro') AS type, tipo_norma, count(*) AS n FROM fuentes GROUP BY ALL",
    "unique_ids": "SELECT texto_id, CASE WHEN n = 1 THEN doc_id ELSE doc_id || '-' || n END AS id FROM (SELECT texto_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY texto_id) AS n FROM texto WHERE doc_id IS NOT NULL)",
    "merged_deliveries": "WITH a AS (SELECT doc_id, list_sort(list(DISTINCT x)) AS areas FROM (SELECT doc_id, unnest(areas) AS x FROM fuentes) WHERE x IS NOT NULL GROUP BY doc_id), g AS (SELECT doc_id, arg_min_null(fuente, registrado) AS fuente, sum(items_del_banco) AS items_del_banco FROM fuentes WHERE doc_id IS NOT NULL GROUP BY doc_id) SELECT doc_id, fuente, items_del_banco, coalesce(array_to_string(areas, ','), '') AS areas FROM g LEFT JOIN a USING (doc_id)",
    "stored_and_attempted": f"SELECT {key_sql('url')} AS key, bool_or(coalesce(estado = 'ok', false)) AS stored FROM fuentes WHERE url IS NOT NULL GROUP BY 1",
    "retry_list": f"WITH {_LATEST} SELECT doc_id, estado FROM l WHERE coalesce(estado, '') <> 'ok' AND doc_id NOT IN (SELECT doc_id FROM leer WHERE doc_id IS NOT NULL)",
    "origin_filter": "SELECT DISTINCT doc_id, origen FROM fuentes WHERE origen IS NULL OR origen NOT IN ('enriquecimiento', 'enlaces')",
    "asof_source": "WITH n AS (SELECT DISTINCT art_id, doc_id, bloques[1].inicio AS inicio FROM normas), p AS (SELECT DISTINCT doc_id, partes FROM leer), j AS (SELECT art_id, doc_id, inicio, partes, list_filter(partes, lambda x: x.inicio <= n.inicio) AS b FROM n JOIN p USING (doc_id) WHERE inicio IS NOT NULL AND len(partes) > 0) SELECT art_id, doc_id, CASE WHEN len(b) > 0 THEN b[-1].url ELSE partes[1].url END AS url FROM j",
    "late_arrivals": "SELECT metodo, floor((epoch(date_trunc('second', recibido)) - epoch(date_trunc('second', descargado))) / 86400)::BIGINT AS days, count(*) AS n FROM texto WHERE descargado IS NOT NULL AND recibido IS NOT NULL GROUP BY ALL",
    "redelivered_parts": "SELECT texto_id, first_id FROM (SELECT texto_id, min(texto_id) OVER (PARTITION BY doc_id, archivo, sha1(markdown)) AS first_id FROM texto) WHERE texto_id <> first_id",
}
