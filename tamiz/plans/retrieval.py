"""Queries of lexical and dense search, fusion and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import dense, fusion, lexical
from tamiz.session import table

# The queries of a search are the evaluation items whose id is divisible by 100, against all rows.
_TOK = "list_filter(regexp_extract_all(lower(translate({c}, '" + T.ACCENTED + "', '" + T.FOLDED + r"')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1)"


def tok(c: str) -> str:
    return _TOK.format(c=c)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", "norma_id", "area")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preguntas").where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("pregunta").alias("q"), "area")


def bm25_topk(spark: SparkSession, d: str, k: int = 10, lucene: bool = False) -> DataFrame:
    k1 = 1.2 if lucene else 1.5
    return lexical.bm25(_corpus(spark, d), _items(spark, d), T.tokens(F.col("text")), T.tokens(F.col("q")), k, k1, lucene=lucene)


def bm25_lucene_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d, lucene=True)


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.statistics(_corpus(spark, d), T.tokens(F.col("text")))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Terms of at least three texts; all rows are counted, the threshold is what the report, like its SQL, asks for."""
    p = lexical.postings(_corpus(spark, d), T.tokens(F.col("text")))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where("df >= 3")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), "label")


def dense_topk(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = _vectors(spark, d)
    hits = dense.dense_topk(v, v.where("row_id % 100 = 0").select(F.col("row_id").alias("qid"), "v"), k)
    return hits.select("qid", "row_id", F.round("score", 4).alias("score"))


def dense_label_recall(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    hits = dense.dense_topk(v, v.where("row_id % 100 = 0").select(F.col("row_id").alias("qid"), "v"), 10)
    labels = v.select("row_id", "label")
    j = hits.join(labels, "row_id").join(labels.select(F.col("row_id").alias("qid"), F.col("label").alias("wanted")), "qid")
    return j.groupBy("qid").agg(F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 4).alias("precision_at_10"), F.min(F.when((F.col("label") == F.col("wanted")) & (F.col("qid") != F.col("row_id")), F.col("rank"))).alias("first_other"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf([bm25_topk(spark, d, 30), bm25_topk(spark, d, 30, lucene=True)], 10)


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("row_id", F.sha1(F.col("text").cast("binary")).alias("hash"))


def collapse_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.collapse(bm25_topk(spark, d, 30), _copies(spark, d), 10)


def documents_of_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = _corpus(spark, d).select("row_id", F.coalesce("norma_id", F.lit("")).alias("doc_id"))
    return fusion.by_document(bm25_topk(spark, d, 30), rows)


def filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d, 30).join(_corpus(spark, d).select("row_id", F.col("area").alias("row_area")), "row_id").join(_items(spark, d).select("qid", "area"), "qid")
    return fusion.filter_or_all(hits, F.coalesce(F.col("area") == F.col("row_area"), F.lit(False)), 3).select("qid", "row_id", "rank", "filtered")


def cap_per_norm(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d, 50).join(_corpus(spark, d).select("row_id", "norma_id"), "row_id")
    return fusion.cap(hits, "norma_id", 2, 10).select("qid", "row_id", "rank")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d, 10).join(_corpus(spark, d).select("row_id", "text"), "row_id")
    return fusion.context_budget(hits, T.token_estimate(F.col("text")), 1500).select("qid", "row_id", "rank", "cost", "used")


def retrieval_signals(spark: SparkSession, d: str) -> DataFrame:
    return fusion.signals(bm25_topk(spark, d, 10))


def content_f1(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "preguntas").where("respuesta_esperada is not null").select("id", "pregunta", "respuesta_esperada")
    return lexical.content_f1(p, T.tokens(F.col("pregunta")), T.tokens(F.col("respuesta_esperada")))


def distinct_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = _corpus(spark, d).select("row_id", "text", F.sha1(F.col("text").cast("binary")).alias("hash"))
    done = dense.encode_distinct(rows, "hash", "text", dense.hashing_encoder)
    return done.groupBy("hash").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("v").alias("n_vectors"), F.min("row_id").alias("representative"))


def bm25_sql(k: int, lucene: bool = False) -> str:
    k1, top = (1.2, "1.0") if lucene else (1.5, "2.5")
    return f"""
toks AS (SELECT doc_id AS row_id, {tok("text")} AS t FROM documents),
lens AS (SELECT row_id, len(t) AS dl FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
qs AS (SELECT DISTINCT id AS qid, unnest({tok("pregunta")}) AS term FROM preguntas WHERE id % 100 = 0),
tf AS (SELECT term, row_id, count(*) AS tf FROM (SELECT row_id, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM qs) GROUP BY term, row_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT qid, row_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {top} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term) JOIN qs USING (term) JOIN lens USING (row_id), tot GROUP BY qid, row_id),
bm AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


_DENSE = """
WITH hits AS (SELECT q.vec_id AS qid, e.vec_id AS row_id, e.label, q.label AS wanted, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM hits QUALIFY rank <= 10)
"""

QUERIES = {
    "bm25_topk": bm25_topk, "bm25_lucene_topk": bm25_lucene_topk, "bm25_stats": bm25_stats, "term_frequencies": term_frequencies, "dense_topk": dense_topk, "dense_label_recall": dense_label_recall, "rrf_fusion": rrf_fusion,
    "collapse_topk": collapse_topk, "documents_of_ranking": documents_of_ranking, "filter_fallback": filter_fallback, "cap_per_norm": cap_per_norm, "context_budget": context_budget, "retrieval_signals": retrieval_signals,
    "content_f1": content_f1, "distinct_encode": distinct_encode,
}
SQL = {
    "bm25_topk": f"WITH {bm25_sql(10)} SELECT qid, row_id, score, rank FROM bm",
    "bm25_lucene_topk": f"WITH {bm25_sql(10, True)} SELECT qid, row_id, score, rank FROM bm",
    "bm25_stats": f"WITH t AS (SELECT {tok('text')} AS t FROM documents) SELECT (SELECT count(*) FROM t) AS n_docs, (SELECT coalesce(sum(len(t)), 0) FROM t) AS n_tokens, (SELECT round(avg(len(t)), 4) FROM t) AS avgdl, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM t)) AS n_terms",
    "term_frequencies": f"WITH p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf) AS cf FROM p GROUP BY term HAVING count(*) >= 3",
    "dense_topk": _DENSE + "SELECT qid, row_id, round(score, 4) AS score FROM top",
    "dense_label_recall": _DENSE + "SELECT qid, round(avg((label = wanted)::DOUBLE), 4) AS precision_at_10, min(CASE WHEN label = wanted AND qid <> row_id THEN rank END) AS first_other FROM top GROUP BY qid",
    "rrf_fusion": f"WITH a AS (WITH {bm25_sql(30)} SELECT * FROM bm), b AS (WITH {bm25_sql(30, True)} SELECT * FROM bm), u AS (SELECT qid, row_id, rank, 0 AS src FROM a UNION ALL SELECT qid, row_id, rank, 1 FROM b), f AS (SELECT qid, row_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((src, rank)) AS seen FROM u GROUP BY qid, row_id) SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, row_id) AS rank FROM f QUALIFY rank <= 10",
    "collapse_topk": f"WITH {bm25_sql(30)}, h AS (SELECT bm.*, row_number() OVER (PARTITION BY qid, sha1(text) ORDER BY rank) AS n FROM bm JOIN documents ON doc_id = row_id), k AS (SELECT * FROM h WHERE n = 1) SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY k.rank) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k.rank) <= 10",
    "documents_of_ranking": f"WITH {bm25_sql(30)}, f AS (SELECT qid, coalesce(norma_id, '') AS doc_id, min(rank) AS first FROM bm JOIN documents d ON d.doc_id = row_id GROUP BY ALL) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY first, doc_id) AS rank FROM f",
    "filter_fallback": f"WITH {bm25_sql(30)}, j AS (SELECT bm.qid, row_id, rank, coalesce(d.area = p.area, false) AS ok FROM bm JOIN documents d ON d.doc_id = row_id JOIN preguntas p ON p.id = qid), n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY qid) AS n FROM j) SELECT qid, row_id, rank, n >= 3 AS filtered FROM n WHERE ok OR n < 3",
    "cap_per_norm": f"WITH {bm25_sql(50)}, j AS (SELECT bm.*, row_number() OVER (PARTITION BY qid, coalesce(norma_id, chr(1) || row_id) ORDER BY rank) AS n FROM bm JOIN documents ON doc_id = row_id), k AS (SELECT * FROM j WHERE n <= 2) SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY k.rank, row_id) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k.rank, row_id) <= 10",
    "context_budget": f"WITH {bm25_sql(10)}, j AS (SELECT qid, row_id, rank, floor(length(text) / 3.5)::INT + 1 AS cost FROM bm JOIN documents ON doc_id = row_id), u AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS used FROM j) SELECT qid, row_id, rank, cost, used FROM u WHERE rank <= 8 AND (rank = 1 OR used <= 1500)",
    "retrieval_signals": f"WITH {bm25_sql(10)} SELECT qid, count(*) AS n, max(score) AS best, min(score) AS worst, round(max(score) - min(score), 6) AS spread FROM bm GROUP BY qid",
    "content_f1": f"WITH p AS (SELECT * FROM preguntas WHERE respuesta_esperada IS NOT NULL), a AS (SELECT id, w, count(*) AS a FROM (SELECT id, unnest({tok('pregunta')}) AS w FROM p) GROUP BY ALL), b AS (SELECT id, w, count(*) AS b FROM (SELECT id, unnest({tok('respuesta_esperada')}) AS w FROM p) GROUP BY ALL), j AS (SELECT coalesce(a.id, b.id) AS id, a, b FROM a FULL JOIN b ON a.id = b.id AND a.w = b.w) SELECT id, round(2.0::DOUBLE * sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE 0 END) / (sum(a) + sum(b)), 6) AS f1 FROM j GROUP BY id HAVING sum(a) IS NOT NULL AND sum(b) IS NOT NULL",
    "distinct_encode": "SELECT sha1(text) AS hash, count(*) AS n_rows, 1 AS n_vectors, min(doc_id) AS representative FROM documents GROUP BY 1",
}
