"""Queries of measures, audits and batch work over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import batches, measures
from tamiz.plans.retrieval import _vectors, bm25_sql, bm25_topk
from tamiz.operators import dense
from tamiz.session import table


def ranking_measures(s: SparkSession, d: str) -> DataFrame:
    """Search among vectors; those of the same label are relevant."""
    v = _vectors(s, d)
    q = v.where("row_id % 100 = 0").select(F.col("row_id").alias("qid"), "v", "label")
    hits = dense.dense_topk(v, q, 50)
    relevant = q.select("qid", "label").join(v.select("row_id", "label"), "label").where("qid != row_id").select("qid", "row_id")
    return measures.ranking_measures(hits, relevant)


def item_roll_up(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").select("formato", "area", T.word_count(F.col("pregunta")).alias("words"), F.length("respuesta_esperada").alias("answer"))
    return measures.roll_up(p, ["formato", "area"], ["words", "answer"])


def percentiles(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("lang", T.token_estimate(F.col("text")).alias("n"))
    return measures.percentiles(t, ["lang"], "n")


def weighted_latency(s: SparkSession, d: str) -> DataFrame:
    return measures.weighted_mean(table(s, d, "events"), "event_type", "value", {"click": 289.0, "view": 633.0, "purchase": 70.0})


def confusion(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "fuentes")
    return measures.confusion(f, F.coalesce(F.array_contains("formato_origen", "pdf_ocr"), F.lit(False)), F.col("ocr"))


def failure_stage(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "fuentes").select("doc_id", "estado", "n_caracteres", "n_articulos_detectados").distinct()
    read = table(s, d, "leer").select("doc_id").distinct().withColumn("has_text", F.lit(True))
    stage = measures.first_failure([("download", F.col("estado") != "ok"), ("reading", F.col("has_text").isNull()), ("size", F.col("n_caracteres") < 1500), ("articles", F.col("n_articulos_detectados") == 0)])
    return f.join(read, "doc_id", "left").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def melt_registry(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "fuentes").where("doc_id is not null").select("doc_id", "registrado", "n_partes", "n_caracteres", "n_articulos_detectados", "items_del_banco").distinct()
    return measures.long_form(f, ["doc_id", "registrado"], ["n_partes", "n_caracteres", "n_articulos_detectados", "items_del_banco"]).drop("registrado")


def run_diff(s: SparkSession, d: str) -> DataFrame:
    return measures.difference(bm25_topk(s, d).select(F.concat_ws("-", "qid", "row_id").alias("key"), "score"), bm25_topk(s, d, 10, True).select(F.concat_ws("-", "qid", "row_id").alias("key"), "score"), "key", "score")


def missing_articles(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "normas").select("art_id", "doc_id", "num_base").distinct()
    m = measures.missing_numbers(n, "doc_id", "num_base")
    return m.select("doc_id", "top", "repeats", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


def article_audit(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "normas").select("art_id", "doc_id", "titulo", "sufijo", "bloques").distinct()
    w = F.aggregate("bloques", F.lit(0), lambda a, b: a + T.word_count(b["texto"]))
    x = n.select("doc_id", w.alias("w"), (F.coalesce("titulo", F.lit("")) == "").alias("untitled"), (F.coalesce("sufijo", F.lit("")) != "").alias("suffixed"), F.size("bloques").alias("blocks"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("articles"), F.sum("w").alias("words"), F.count_if(F.col("w") > 300).alias("over_limit"), F.count_if(F.col("w") < 10).alias("short"), F.count_if("untitled").alias("untitled"), F.count_if("suffixed").alias("suffixed"), F.sum("blocks").alias("blocks"))


def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("h"))
    g = t.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("representative")).where("n > 1")
    return t.join(g, "h").select("doc_id", "representative", "n")


def split_round_robin(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").select("id", "formato")
    return batches.split_round_robin(p, "formato", "id", 3).groupBy("part", "formato").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def pending_items(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return batches.pending(o, o.where("o_orderstatus = 'F'")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def merge_first_wins(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    parts = [e.where(f"event_type = '{k}'").groupBy("id").agg(F.min("event_id").alias("event_id")).withColumn("event_type", F.lit(k)) for k in ("purchase", "click", "view")]
    known = table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return batches.merge_parts(parts, known)[0].select("id", "event_id", "event_type")


def delivery_audit(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("id"))
    return batches.audit_ids(orders, table(s, d, "customer").select(F.col("c_custkey").alias("id"))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


ITEM_SCHEMA = {
    "required": ["id", "formato", "pregunta", "area"],
    "properties": {"id": {"type": "integer", "minimum": 1}, "formato": {"type": "string", "enum": ["multiple_choice", "semi_open", "open_ended"]}, "pregunta": {"type": "string", "minLength": 40}, "area": {"type": "string"}, "tema": {"type": "string"}, "respuesta_correcta": {"type": "string", "pattern": "^[A-E]$"}},
    "allOf": [{"if": {"formato": "multiple_choice"}, "then": ["respuesta_correcta"]}, {"if": {"formato": "open_ended"}, "then": ["respuesta_esperada", "legal_basis"]}],
}


def schema_validate(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas")
    return p.select("id", F.explode(batches.schema_errors(p, ITEM_SCHEMA)).alias("error"))


def option_counts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").where("opciones is not null")
    return p.select("id", F.explode("opciones").alias("letter", "option")).select("id", "letter", T.word_count(F.col("option")).alias("words"))


def query_texts(s: SparkSession, d: str) -> DataFrame:
    """Statement with its options, one line each in order of their letters."""
    p = table(s, d, "preguntas")
    opts = F.transform(F.array_sort(F.map_entries("opciones")), lambda e: F.concat(e["key"], F.lit(") "), e["value"]))
    return p.select("id", F.md5(F.concat_ws("\n", "pregunta", F.array_join(opts, "\n")).cast("binary")).alias("hash"))


def inferred_format(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas")
    f = F.when(F.coalesce(F.size("opciones"), F.lit(0)) > 0, "multiple_choice").when(T.word_count(F.col("pregunta")) > 120, "open_ended").otherwise("semi_open")
    return p.groupBy(f.alias("inferred"), "formato").agg(F.count(F.lit(1)).alias("n"))


def questions_asked(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").where("pregunta is not null")
    return p.select("id", F.explode(F.regexp_extract_all("pregunta", F.lit(r"¿[^?¿]+\?"), 0)).alias("question"))


def letter_ensemble(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("user_id") % 50).alias("qid"), F.substring("event_type", 1, 1).alias("letter"), F.abs("value").alias("p"))
    return measures.best_letter(measures.ensemble(e))


def segment_budget(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "partir").select("tramo_id", F.greatest(F.lit(50), F.lit(297) - F.coalesce("palabras_encabezado", F.lit(0))).alias("budget")).distinct()
    return p.groupBy("budget").agg(F.count(F.lit(1)).alias("n"))


def greedy_pack(s: SparkSession, d: str) -> DataFrame:
    """Articles' paragraphs in consecutive chunks of at most 120 words."""
    from tamiz.operators.paragraphs import pack

    b = table(s, d, "normas").select("art_id", "bloques").distinct().select(F.col("art_id").alias("id"), F.posexplode("bloques").alias("k", "b"))
    return pack(b.select("id", "k", T.word_count(F.col("b.texto")).cast("bigint").alias("words")), 120).select("id", "chunk", "first", "last", "words")


def blocks_outside_strikes(s: SparkSession, d: str) -> DataFrame:
    """Paragraph begins that lie in no struck run of their text: an interval anti-join."""
    from tamiz.operators.paragraphs import outside

    t = table(s, d, "leer").where("texto is not null").select("doc_id", "texto").distinct()
    parts = F.split("texto", "~~")
    pieces = t.select(F.col("doc_id").alias("id"), F.posexplode(parts).alias("k", "p"))
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    spans = pieces.withColumn("a", F.coalesce(F.sum(F.length("p") + 2).over(w), F.lit(0)).cast("int")).withColumn("b", (F.col("a") + F.length("p")).cast("int")).where("k % 2 = 1").select("id", "a", "b")
    n = table(s, d, "normas").select(F.col("doc_id").alias("id"), F.explode("bloques").alias("b")).select("id", F.col("b.inicio").alias("at")).distinct()
    return outside(n.join(t.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi"), spans).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


_N = "n AS (SELECT DISTINCT art_id, doc_id, num_base, titulo, sufijo, bloques FROM normas)"
_W = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
QUERIES = {
    "ranking_measures": ranking_measures, "metric_grouping_sets": item_roll_up, "percentiles": percentiles, "weighted_latency": weighted_latency, "confusion": confusion, "first_failure_stage": failure_stage, "melt_registry": melt_registry, "run_diff": run_diff,
    "missing_sequence": missing_articles, "article_audit": article_audit, "exact_duplicates": exact_duplicates, "split_round_robin": split_round_robin, "pending_items": pending_items, "merge_first_wins": merge_first_wins, "delivery_audit": delivery_audit,
    "schema_validate": schema_validate, "option_counts": option_counts, "query_texts": query_texts, "inferred_format": inferred_format, "questions_asked": questions_asked, "letter_ensemble": letter_ensemble, "segment_budget": segment_budget, "greedy_pack": greedy_pack,
    "interval_anti": blocks_outside_strikes,
}
SQL = {
    "ranking_measures": "WITH h AS (SELECT q.vec_id AS qid, e.vec_id AS row_id, q.label = e.label AND q.vec_id <> e.vec_id AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), g AS (SELECT qid, count(*) FILTER (rel) AS n_relevant, min(rank) FILTER (rel AND rank <= 50) AS first_rank, count(*) FILTER (rel AND rank <= 10) AS h10, count(*) FILTER (rel AND rank <= 50) AS h50 FROM h GROUP BY qid) SELECT qid, n_relevant, first_rank, round(h10 / n_relevant::DOUBLE, 4) AS recall_10, round(h50 / n_relevant::DOUBLE, 4) AS recall_50, (h10 > 0)::INT AS hit_10, (h50 > 0)::INT AS hit_50, CASE WHEN first_rank <= 10 THEN round(1.0::DOUBLE / first_rank, 4) ELSE 0.0 END AS mrr FROM g WHERE n_relevant > 0",
    "metric_grouping_sets": f"SELECT formato, area, grouping_id(formato, area) AS level, count(*) AS n, round(avg({_W.format(c='pregunta')}), 4) AS words, round(avg(length(respuesta_esperada)), 4) AS answer FROM preguntas GROUP BY GROUPING SETS ((), (formato), (area))",
    "percentiles": "SELECT lang, floor(quantile_cont(floor(length(text) / 3.5)::INT + 1, 0.5))::INT AS p50, floor(quantile_cont(floor(length(text) / 3.5)::INT + 1, 0.95))::INT AS p95, max(floor(length(text) / 3.5)::INT + 1) AS largest FROM documents GROUP BY lang",
    "weighted_latency": "SELECT round(sum(m * w) / sum(w), 4) AS weighted FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) JOIN (VALUES ('click', 289.0::DOUBLE), ('view', 633.0), ('purchase', 70.0)) v(t, w) ON t = event_type",
    "confusion": "SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM (SELECT coalesce(list_contains(formato_origen, 'pdf_ocr'), false) AS a, coalesce(ocr, false) AS p FROM fuentes)",
    "first_failure_stage": "SELECT CASE WHEN estado <> 'ok' THEN 'download' WHEN r.doc_id IS NULL THEN 'reading' WHEN n_caracteres < 1500 THEN 'size' WHEN n_articulos_detectados = 0 THEN 'articles' ELSE 'ok' END AS stage, count(*) AS n FROM (SELECT DISTINCT doc_id, estado, n_caracteres, n_articulos_detectados FROM fuentes) f LEFT JOIN (SELECT DISTINCT doc_id FROM leer) r ON r.doc_id = f.doc_id GROUP BY 1",
    "melt_registry": "SELECT doc_id, metric, value FROM (UNPIVOT (SELECT DISTINCT doc_id, registrado, n_partes::DOUBLE AS n_partes, n_caracteres::DOUBLE AS n_caracteres, n_articulos_detectados::DOUBLE AS n_articulos_detectados, items_del_banco::DOUBLE AS items_del_banco FROM fuentes WHERE doc_id IS NOT NULL) ON n_partes, n_caracteres, n_articulos_detectados, items_del_banco INTO NAME metric VALUE value)",
    "run_diff": f"WITH a AS (WITH {bm25_sql(10)} SELECT * FROM bm), b AS (WITH {bm25_sql(10, True)} SELECT * FROM bm) SELECT count(*) AS n, count(*) FILTER (a.score IS NOT DISTINCT FROM b.score) AS n_equal, round(avg(b.score - a.score), 4) AS mean_diff, round(avg(abs(b.score - a.score)), 4) AS mean_abs_diff FROM a JOIN b USING (qid, row_id)",
    "missing_sequence": f"WITH {_N}, g AS (SELECT doc_id, max(num_base) AS top, count(*) - count(DISTINCT num_base) AS repeats, list(DISTINCT num_base) AS seen FROM n WHERE num_base > 0 GROUP BY doc_id) SELECT doc_id, top, repeats, coalesce(array_to_string(list_filter(range(1, top + 1), lambda x: NOT list_contains(seen, x)), ','), '') AS missing FROM g",
    "article_audit": rf"WITH {_N}, x AS (SELECT doc_id, coalesce(titulo, '') = '' AS untitled, coalesce(sufijo, '') <> '' AS suffixed, len(bloques) AS blocks, coalesce(list_sum([{_W.format(c='b.texto')} FOR b IN bloques]), 0) AS w FROM n) SELECT doc_id, count(*) AS articles, sum(w) AS words, count(*) FILTER (w > 300) AS over_limit, count(*) FILTER (w < 10) AS short, count(*) FILTER (untitled) AS untitled, count(*) FILTER (suffixed) AS suffixed, sum(blocks) AS blocks FROM x GROUP BY doc_id",
    "exact_duplicates": r"WITH t AS (SELECT doc_id, sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents), g AS (SELECT h, count(*) AS n, min(doc_id) AS representative FROM t GROUP BY h HAVING count(*) > 1) SELECT doc_id, representative, n FROM t JOIN g USING (h)",
    "split_round_robin": "WITH p AS (SELECT id, formato, (row_number() OVER (ORDER BY formato NULLS FIRST, id) - 1) % 3 AS part FROM preguntas) SELECT part::INT AS part, formato, count(*) AS n, min(id) AS first FROM p GROUP BY ALL",
    "pending_items": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "merge_first_wins": "WITH u AS (SELECT user_id AS id, event_type, min(event_id) AS event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS p FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY user_id, event_type) SELECT id, event_id, event_type FROM u WHERE id IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1",
    "delivery_audit": "WITH r AS (SELECT o_custkey AS id, 'repeated' AS problem FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT DISTINCT o_custkey, 'foreign' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT problem, count(*) AS n, min(id) AS first FROM r GROUP BY problem",
    "schema_validate": "SELECT id, unnest(list_filter([CASE WHEN id < 1 THEN 'id: minimum' END, CASE WHEN id IS NULL THEN 'id: required' END, CASE WHEN formato NOT IN ('multiple_choice', 'semi_open', 'open_ended') THEN 'formato: enum' END, CASE WHEN formato IS NULL THEN 'formato: required' END, CASE WHEN length(pregunta) < 40 THEN 'pregunta: minLength' END, CASE WHEN pregunta IS NULL THEN 'pregunta: required' END, CASE WHEN area IS NULL THEN 'area: required' END, CASE WHEN NOT regexp_matches(respuesta_correcta, '^[A-E]$') THEN 'respuesta_correcta: pattern' END, CASE WHEN formato = 'multiple_choice' AND respuesta_correcta IS NULL THEN 'respuesta_correcta: required' END, CASE WHEN formato = 'open_ended' AND respuesta_esperada IS NULL THEN 'respuesta_esperada: required' END, CASE WHEN formato = 'open_ended' AND legal_basis IS NULL THEN 'legal_basis: required' END], lambda x: x IS NOT NULL)) AS error FROM preguntas",
    "option_counts": f"SELECT id, e.key AS letter, {_W.format(c='e.value')} AS words FROM (SELECT id, unnest(map_entries(opciones)) AS e FROM preguntas WHERE opciones IS NOT NULL)",
    "query_texts": "SELECT id, md5(concat_ws(chr(10), pregunta, array_to_string(list_transform(list_sort(map_entries(opciones)), lambda e: e.key || ') ' || e.value), chr(10)))) AS hash FROM preguntas",
    "inferred_format": f"SELECT CASE WHEN coalesce(cardinality(opciones), 0) > 0 THEN 'multiple_choice' WHEN {_W.format(c='pregunta')} > 120 THEN 'open_ended' ELSE 'semi_open' END AS inferred, formato, count(*) AS n FROM preguntas GROUP BY ALL",
    "questions_asked": r"SELECT id, unnest(regexp_extract_all(pregunta, '¿[^?¿]+\?')) AS question FROM preguntas WHERE pregunta IS NOT NULL",
    "letter_ensemble": "WITH e AS (SELECT user_id % 50 AS qid, event_type[1] AS letter, round(avg(abs(value)), 6) AS p FROM events GROUP BY ALL) SELECT qid, arg_min(letter, (-p, letter)) AS letter, max(p) AS p FROM e GROUP BY qid",
    "segment_budget": "SELECT budget, count(*) AS n FROM (SELECT DISTINCT tramo_id, greatest(50, 297 - coalesce(palabras_encabezado, 0)) AS budget FROM partir) GROUP BY budget",
    "greedy_pack": rf"WITH RECURSIVE {_N}, b AS (SELECT art_id AS id, unnest(bloques) AS b, generate_subscripts(bloques, 1) - 1 AS k FROM n), w AS (SELECT id, k, {_W.format(c='b.texto')} AS w FROM b), r AS (SELECT id, k, w, w AS run, 0 AS chunk FROM w WHERE k = 0 UNION ALL SELECT w.id, w.k, w.w, CASE WHEN r.run + w.w <= 120 THEN r.run + w.w ELSE w.w END, CASE WHEN r.run + w.w <= 120 THEN r.chunk ELSE r.chunk + 1 END FROM r JOIN w ON w.id = r.id AND w.k = r.k + 1) SELECT id, chunk, min(k)::INT AS first, max(k)::INT AS last, sum(w) AS words FROM r GROUP BY id, chunk",
    "interval_anti": "WITH t AS (SELECT DISTINCT doc_id, texto FROM leer WHERE texto IS NOT NULL), p AS (SELECT doc_id, string_split(texto, '~~') AS p FROM t), k AS (SELECT doc_id, p, unnest(range(0, len(p))) AS k FROM p), sp AS (SELECT doc_id, coalesce(list_sum(list_transform(p[:k], lambda x: length(x) + 2)), 0) AS a, length(p[k + 1]) AS n FROM k WHERE k % 2 = 1), pt AS (SELECT DISTINCT doc_id, b.inicio AS at FROM (SELECT doc_id, unnest(bloques) AS b FROM normas) WHERE doc_id IN (SELECT doc_id FROM t)) SELECT doc_id AS id, count(*) AS n FROM pt WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = pt.doc_id AND sp.a <= pt.at AND pt.at < sp.a + sp.n) GROUP BY doc_id",
}
