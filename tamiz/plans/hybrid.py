"""Queries over stored indexes: lexical, dense and fused search of all evaluation items, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import dense, fusion, index
from tamiz.plans.textual import legal_sql, overlap_sql
from tamiz.session import shared_path, table

_PATHS: dict[tuple[str, str], str] = {}


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "text")


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preguntas").select(F.col("id").alias("qid"), F.col("pregunta").alias("q"))


def lexical_index(s: SparkSession, d: str) -> str:
    """Path of the stored index of ``documents``; built once for a session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _PATHS:
        path = shared_path(s)
        index.save_lexical(_documents(s, d), T.legal_tokens(F.col("text")), path)
        _PATHS[key] = path
    return _PATHS[key]


def lexical_topk(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    return index.search(s, lexical_index(s, d), _items(s, d), T.legal_tokens(F.col("q")), k)


def index_statistics(s: SparkSession, d: str) -> DataFrame:
    path = lexical_index(s, d)
    terms = s.read.parquet(f"{path}/terms").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    stats = s.read.parquet(f"{path}/stats").select("n_docs", F.round("avgdl", 4).alias("avgdl"))
    return stats.join(terms)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """The table has no vectors of documents or items: each takes the one whose number its id leaves over 500."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("m"), F.col("embedding").alias("v"))


def _dense(s: SparkSession, d: str, k: int) -> DataFrame:
    v = _vectors(s, d)
    of = lambda df, key: df.select(key, F.pmod(F.col(key), F.lit(500)).alias("m")).join(v, "m").select(key, "v")
    return dense.dense_topk(of(_documents(s, d), "row_id"), of(_items(s, d), "qid"), k)


def dense_items_topk(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d, 10).select("qid", "row_id", "rank")


def hybrid_topk(s: SparkSession, d: str) -> DataFrame:
    """Lexical and dense ranking of all evaluation items, fused by reciprocal ranks."""
    return fusion.rrf([lexical_topk(s, d, 50), _dense(s, d, 50)], 10)


def fused_final_lists(s: SparkSession, d: str) -> DataFrame:
    """Final list of the question and final list of its expansion, fused by row; ties go to the smaller key as text."""
    path = lexical_index(s, d)
    wide = table(s, d, "preguntas").select(F.col("id").alias("qid"), F.concat_ws(" ", "pregunta", "tema", "legal_basis").alias("q"))
    a, b = lexical_topk(s, d, 10), index.search(s, path, wide, T.legal_tokens(F.col("q")), 10)
    return fusion.fuse_lists([a, b], 10)


def content_overlap(s: SparkSession, d: str) -> DataFrame:
    """Mean F1 of unigrams and bigrams of a question and its expected answer."""
    p = table(s, d, "preguntas").where("respuesta_esperada is not null").select("id", T.overlap_tokens(F.col("pregunta")).alias("a"), T.overlap_tokens(F.col("respuesta_esperada")).alias("b"))
    return p.select("id", fusion.overlap_f1(F.col("a"), F.col("b")).alias("f1"))


_LEX = f"""
toks AS (SELECT doc_id AS row_id, {legal_sql("text")} AS t FROM documents), lens AS (SELECT row_id, len(t) AS dl FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
pst AS (SELECT term, row_id, count(*) AS tf FROM (SELECT row_id, unnest(t) AS term FROM toks) GROUP BY term, row_id), df AS (SELECT term, count(*) AS df FROM pst GROUP BY term)"""


def _lex(name: str, q: str, k: int) -> str:
    return f"""
{name}q AS (SELECT DISTINCT id AS qid, unnest({legal_sql(q)}) AS term FROM preguntas),
{name}s AS (SELECT qid, row_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM pst JOIN df USING (term) JOIN {name}q USING (term) JOIN lens USING (row_id), tot GROUP BY qid, row_id),
{name} AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM {name}s WHERE score > 0 QUALIFY rank <= {k})"""


def _dns(k: int) -> str:
    return f"""
dv AS (SELECT doc_id AS row_id, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id % 500), qv AS (SELECT id AS qid, embedding::DOUBLE[] AS v FROM preguntas JOIN embeddings ON vec_id = id % 500),
dd AS (SELECT qid, row_id, round(list_inner_product(qv.v, dv.v), 6) AS score FROM qv, dv), dn AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM dd QUALIFY rank <= {k})"""


_F1 = "coalesce(2.0::DOUBLE * sum(least(x, y)) / nullif(any_value({a}) + any_value({b}), 0), 0)"
QUERIES = {"lexical_topk": lexical_topk, "index_statistics": index_statistics, "dense_items_topk": dense_items_topk, "hybrid_topk": hybrid_topk, "fused_final_lists": fused_final_lists, "content_overlap": content_overlap}
SQL = {
    "lexical_topk": f"WITH {_LEX}, {_lex('lx', 'pregunta', 10)} SELECT qid, row_id, score, rank FROM lx",
    "index_statistics": f"WITH {_LEX} SELECT n AS n_docs, round(avgdl, 4) AS avgdl, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM pst) AS n_postings FROM tot",
    "dense_items_topk": f"WITH {_dns(10)} SELECT qid, row_id, rank FROM dn",
    "hybrid_topk": f"WITH {_LEX}, {_lex('lx', 'pregunta', 50)}, {_dns(50)}, u AS (SELECT qid, row_id, rank, 0 AS src FROM lx UNION ALL SELECT qid, row_id, rank, 1 FROM dn), f AS (SELECT qid, row_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((src, rank)) AS seen FROM u GROUP BY qid, row_id) SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, row_id) AS rank FROM f QUALIFY rank <= 10",
    "fused_final_lists": f"WITH {_LEX}, {_lex('la', 'pregunta', 10)}, {_lex('lb', chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', pregunta, tema, legal_basis)', 10)}, u AS (SELECT qid, row_id, rank FROM la UNION ALL SELECT qid, row_id, rank FROM lb), f AS (SELECT qid, row_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY qid, row_id) SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id::VARCHAR) AS rank FROM f QUALIFY rank <= 10",
    "content_overlap": f"""WITH p AS (SELECT id, {overlap_sql('pregunta')} AS a, {overlap_sql('respuesta_esperada')} AS b FROM preguntas WHERE respuesta_esperada IS NOT NULL),
g AS (SELECT id, 1 AS n, unnest(a) AS w, 1 AS x, 0 AS y FROM p UNION ALL SELECT id, 1, unnest(b), 0, 1 FROM p UNION ALL SELECT id, 2, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])), 1, 0 FROM p UNION ALL SELECT id, 2, unnest(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])), 0, 1 FROM p),
c AS (SELECT id, n, w, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL), f AS (SELECT id, n, coalesce(2.0::DOUBLE * sum(least(x, y)) / nullif(sum(x) + sum(y), 0), 0) AS f FROM c GROUP BY id, n)
SELECT p.id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round((coalesce((SELECT f FROM f WHERE f.id = p.id AND n = 1), 0) + CASE WHEN len(a) > 1 AND len(b) > 1 THEN coalesce((SELECT f FROM f WHERE f.id = p.id AND n = 2), 0) ELSE coalesce((SELECT f FROM f WHERE f.id = p.id AND n = 1), 0) END) / 2, 6) END AS f1 FROM p""",
}
