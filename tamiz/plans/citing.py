"""Queries over citations: who cites what, demand, support, coverage, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import text as T
from tamiz.plans.retrieval import bm25_sql, bm25_topk
from tamiz.session import table


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preguntas").select("id", "formato", "pregunta", "respuesta_esperada", "legal_basis", "area")


def cited_norms(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "leer").where("texto is not null").select("doc_id", "texto").distinct().select("doc_id", C.bodies(F.col("texto")).alias("b"))
    return t.select("doc_id", F.explode_outer("b").alias("cited")).where("cited is not null")


def cited_articles(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "leer").where("texto is not null").select("doc_id", "texto").distinct().select("doc_id", C.articles(F.col("texto")).alias("b"))
    return t.select("doc_id", F.explode_outer("b").alias("cited")).where("cited is not null")


def citation_in_degree(s: SparkSession, d: str) -> DataFrame:
    """Norms cited by at least three documents; all rows are counted, the threshold is what the report, like its SQL, asks for."""
    return cited_norms(s, d).groupBy("cited").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 3")


def demanded_norms(s: SparkSession, d: str) -> DataFrame:
    q = _items(s, d).select("id", "area", C.bodies(F.col("legal_basis")).alias("b")).select("id", "area", F.explode("b").alias("norm"))
    have = table(s, d, "fuentes").where("estado = 'ok'").select(F.col("norma_id").alias("norm")).distinct().withColumn("in_corpus", F.lit(True))
    g = q.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("id"))).cast("array<string>"), ",").alias("ids"), F.array_join(F.sort_array(F.collect_set("area")), ",").alias("areas"))
    return g.join(have, "norm", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def missing_norms(s: SparkSession, d: str) -> DataFrame:
    return demanded_norms(s, d).where("not in_corpus").select("norm", "n")


def basis_articles(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("id", F.explode(C.articles(F.col("legal_basis"))).alias("article"))


def _cited_hits(s: SparkSession, d: str) -> DataFrame:
    """Ranked documents with the norms they cite; only these few are searched for citations."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return bm25_topk(s, d).join(docs, "row_id").withColumn("b", C.bodies(F.col("text"))).drop("text")


def support_antijoin(s: SparkSession, d: str) -> DataFrame:
    """Norms that an answer names and no retrieved document of its question does."""
    hits = _cited_hits(s, d)
    evidence = hits.select(F.col("qid").alias("id"), F.explode("b").alias("norm")).distinct()
    cited = _items(s, d).where("id % 100 = 0").select("id", F.explode(C.bodies(F.concat_ws(" ", "respuesta_esperada", "legal_basis"))).alias("norm"))
    return cited.join(evidence, ["id", "norm"], "left_anti")


def citation_coverage(s: SparkSession, d: str) -> DataFrame:
    hits = _cited_hits(s, d)
    found = hits.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("found"))
    wanted = _items(s, d).where("id % 100 = 0").select(F.col("id").alias("qid"), C.bodies(F.col("legal_basis")).alias("wanted"))
    return wanted.join(found, "qid", "left").select("qid", F.size("wanted").alias("n_wanted"), C.coverage(F.col("wanted"), F.coalesce("found", F.array().cast("array<string>"))).alias("coverage"))


def direct_articles(s: SparkSession, d: str) -> DataFrame:
    """The first two article rows of every norm that a question's basis names."""
    q = _items(s, d).select(F.col("id").alias("qid"), F.explode(C.bodies(F.col("legal_basis"))).alias("norma_id"))
    n = table(s, d, "normas").where("norma_id is not null").select("norma_id", "art_id").distinct()
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("norma_id").orderBy("art_id"))).where("k <= 2")
    return q.distinct().join(n, "norma_id").select("qid", "norma_id", "art_id", "k")


def ngram_leakage(s: SparkSession, d: str) -> DataFrame:
    """Questions and documents that share runs of twelve words: how many distinct ones."""
    grams = lambda df, c, key: df.select(key, T.tokens(F.col(c)).alias("t")).select(key, F.explode_outer(F.array_distinct(T.ngram_hashes(F.col("t"), 12))).alias("g")).where("g is not null")
    q = grams(_items(s, d).select("id", "pregunta"), "pregunta", "id")
    # The questions' runs are few; joined before anything is shuffled, they let only runs of theirs through.
    docs = grams(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id").join(q.select("g").distinct(), "g", "left_semi")
    return docs.join(q, "g").groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))


def most_leaked(s: SparkSession, d: str) -> DataFrame:
    x = ngram_leakage(s, d)
    return x.groupBy("id").agg(F.count(F.lit(1)).alias("docs"), F.max("shared").alias("most"), F.min_by("doc_id", F.struct(-F.col("shared"), "doc_id")).alias("doc_id")).orderBy(F.desc("docs"), "id").limit(10)


_B = r"list_distinct(list_transform(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '\b(?:ley|decreto|resolucion|acuerdo|circular|sentencia|auto)\s+(?:no\.?\s*)?\d+\s+de\s+\d{{4}}'), lambda x: regexp_extract(x, '^[a-z]+') || '_' || coalesce(nullif(ltrim(regexp_extract(x, '(\d+)\s+de', 1), '0'), ''), '0') || '_' || regexp_extract(x, '(\d{{4}})$', 1)))"
_ALIAS_CASE = "CASE " + " ".join(f"WHEN regexp_matches(x, '^{k}_') THEN '{v}'" for k, v in C.ALIASES.items()) + " ELSE x END"
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(strip_accents(coalesce({{c}}, ''))), '\\b({'|'.join(n.replace('.', chr(92) + '.') for n in names)})($|[^\\w])') THEN '{code}' END" for code, names in C.CODE_NAMES.items()) + "], lambda x: x IS NOT NULL)"
_J = r"list_transform(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '\b(?:c|t|su)-\d+(?:\s+de\s+\d{{4}}|/\d{{2}})'), lambda x: 'sentencia_' || upper(regexp_extract(x, '^(c|t|su)', 1)) || '-' || coalesce(nullif(ltrim(regexp_extract(x, '-(\d+)', 1), '0'), ''), '0') || '_' || CASE WHEN contains(x, '/') THEN CASE WHEN regexp_extract(x, '/(\d{{2}})', 1)::INT < 50 THEN '20' ELSE '19' END || regexp_extract(x, '/(\d{{2}})', 1) ELSE regexp_extract(x, '(\d{{4}})$', 1) END)"


def bodies_sql(c: str) -> str:
    return f"list_distinct(list_concat(list_transform({_B.format(c=c)}, lambda x: {_ALIAS_CASE}), {_J.format(c=c)}, {_NAMED.format(c=c)}))"


_A = r"list_transform(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '\bart(?:iculo|\.)\s+\d+[a-z]?\s+(?:de\s+(?:la|el)\s+|del\s+)(?:ley|decreto|resolucion|acuerdo|circular|sentencia|auto)\s+(?:no\.?\s*)?\d+\s+de\s+\d{{4}}'), lambda x: regexp_extract(x, '(ley|decreto|resolucion|acuerdo|circular|sentencia|auto)\s', 1) || '_' || coalesce(nullif(ltrim(regexp_extract(x, '(\d+)\s+de\s+\d{{4}}$', 1), '0'), ''), '0') || '_' || regexp_extract(x, '(\d{{4}})$', 1) || '#art_' || upper(regexp_extract(x, '^art(?:iculo|\.)\s+(\d+[a-z]?)', 1)))"
_A2 = r"list_transform(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '\b(?:ley|decreto|resolucion|acuerdo|circular|sentencia|auto)\s+(?:no\.?\s*)?\d+\s+de\s+\d{{4}},\s+art(?:iculo|\.)\s+\d+[a-z]?'), lambda x: regexp_extract(x, '^([a-z]+)', 1) || '_' || coalesce(nullif(ltrim(regexp_extract(x, '(\d+)\s+de\s', 1), '0'), ''), '0') || '_' || regexp_extract(x, 'de\s+(\d{{4}}),', 1) || '#art_' || upper(regexp_extract(x, '(\d+[a-z]?)$', 1)))"
_ALIAS_ART = "CASE " + " ".join(f"WHEN regexp_matches(x, '^{k}_') THEN '{v}#' || string_split(x, '#')[2]" for k, v in C.ALIASES.items()) + " ELSE x END"


def articles_sql(c: str) -> str:
    return f"list_distinct(list_transform(list_concat({_A.format(c=c)}, {_A2.format(c=c)}), lambda x: {_ALIAS_ART}))"


_T = "t AS (SELECT DISTINCT doc_id, texto FROM leer WHERE texto IS NOT NULL)"
_CITED = f"{_T}, cited AS (SELECT doc_id, unnest({bodies_sql('texto')}) AS cited FROM t)"
_DEMAND = f"q AS (SELECT id, area, unnest({bodies_sql('legal_basis')}) AS norm FROM preguntas), have AS (SELECT DISTINCT norma_id FROM fuentes WHERE estado = 'ok'), g AS (SELECT norm, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids, coalesce(array_to_string(list_sort(list(DISTINCT area) FILTER (area IS NOT NULL)), ','), '') AS areas FROM q GROUP BY norm), dm AS (SELECT *, coalesce(norm IN (SELECT norma_id FROM have WHERE norma_id IS NOT NULL), false) AS in_corpus FROM g)"
_GRAMS = r"""
qt AS (SELECT id, list_filter(regexp_extract_all(lower(strip_accents(pregunta)), '[\p{L}\p{N}]+'), lambda x: length(x) > 1) AS w FROM preguntas),
dt AS (SELECT doc_id, list_filter(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), lambda x: length(x) > 1) AS w FROM documents),
qg AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS g FROM qt, unnest(range(1, len(w) - 10)) AS r(i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM dt, unnest(range(1, len(w) - 10)) AS r(i)),
lk AS (SELECT id, doc_id, count(*) AS shared FROM qg JOIN dg USING (g) GROUP BY id, doc_id)"""
_HITB = f"WITH {bm25_sql(10)}, hb AS (SELECT DISTINCT qid AS id, unnest({bodies_sql('text')}) AS norm FROM bm JOIN documents ON doc_id = row_id)"
QUERIES = {
    "cited_norms": cited_norms, "cited_articles": cited_articles, "citation_in_degree": citation_in_degree, "demanded_norms": demanded_norms, "missing_norms": missing_norms, "basis_articles": basis_articles, "support_antijoin": support_antijoin,
    "citation_coverage": citation_coverage, "direct_articles": direct_articles, "ngram_leakage": ngram_leakage, "most_leaked": most_leaked,
}
SQL = {
    "cited_norms": f"WITH {_CITED} SELECT doc_id, cited FROM cited",
    "cited_articles": f"WITH {_T} SELECT doc_id, unnest({articles_sql('texto')}) AS cited FROM t",
    "citation_in_degree": f"WITH {_CITED} SELECT cited, count(DISTINCT doc_id) AS docs FROM cited GROUP BY cited HAVING count(DISTINCT doc_id) >= 3",
    "demanded_norms": f"WITH {_DEMAND} SELECT norm, n, ids, areas, in_corpus FROM dm",
    "missing_norms": f"WITH {_DEMAND} SELECT norm, n FROM dm WHERE NOT in_corpus",
    "basis_articles": f"SELECT id, unnest({articles_sql('legal_basis')}) AS article FROM preguntas",
    "support_antijoin": f"{_HITB}, c AS (SELECT id, unnest({bodies_sql(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', respuesta_esperada, legal_basis)')}) AS norm FROM preguntas WHERE id % 100 = 0) SELECT id, norm FROM c ANTI JOIN hb USING (id, norm)",
    "citation_coverage": f"{_HITB}, w AS (SELECT id AS qid, {bodies_sql('legal_basis')} AS wanted FROM preguntas WHERE id % 100 = 0), f AS (SELECT id AS qid, list(norm) AS found FROM hb GROUP BY id) SELECT qid, len(wanted) AS n_wanted, CASE WHEN len(wanted) > 0 THEN round(len(list_intersect(wanted, coalesce(found, []))) / len(wanted)::DOUBLE, 4) END AS coverage FROM w LEFT JOIN f USING (qid)",
    "direct_articles": f"WITH q AS (SELECT DISTINCT id AS qid, unnest({bodies_sql('legal_basis')}) AS norma_id FROM preguntas), n AS (SELECT norma_id, art_id, row_number() OVER (PARTITION BY norma_id ORDER BY art_id) AS k FROM (SELECT DISTINCT norma_id, art_id FROM normas WHERE norma_id IS NOT NULL) QUALIFY k <= 2) SELECT qid, norma_id, art_id, k FROM q JOIN n USING (norma_id)",
    "ngram_leakage": f"WITH {_GRAMS} SELECT id, doc_id, shared FROM lk",
    "most_leaked": f"WITH {_GRAMS} SELECT id, count(*) AS docs, max(shared) AS most, arg_min(doc_id, (-shared, doc_id)) AS doc_id FROM lk GROUP BY id ORDER BY docs DESC, id LIMIT 10",
}
