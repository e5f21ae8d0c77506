"""Queries over the sentences of legal texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import legal as L
from tamiz.plans.citing import bodies_sql
from tamiz.session import table


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "leer").where("texto is not null").groupBy("doc_id").agg(F.min("texto").alias("texto"))


def legal_sentences(s: SparkSession, d: str) -> DataFrame:
    return L.sentence_spans(_texts(s, d), "doc_id", "texto").select("doc_id", "k", "inicio", "fin", F.md5(F.col("texto").cast("binary")).alias("hash"))


def norm_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences that name a norm."""
    return L.sentence_spans(_texts(s, d), "doc_id", "texto").where(L.names_norm(F.col("texto"))).select("doc_id", "k", "inicio", "fin")


def _answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preguntas").where("respuesta_esperada is not null").select("id", F.concat_ws(" ", "respuesta_esperada", F.concat(F.lit("Según la "), F.col("legal_basis"), F.lit(".")), F.lit("La sala lo confirmó; Terminó la audiencia.")).alias("texto"))


def shortened_answers(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).select("id", L.shortened(F.col("texto"), 2, 40).alias("corto"))


def removed_citations(s: SparkSession, d: str) -> DataFrame:
    """Answers without the sentences that name a norm the corpus does not hold; what is left, and how many went."""
    have = table(s, d, "fuentes").where("estado = 'ok' and norma_id is not null").select("norma_id").distinct()
    parts = _answers(s, d).select("id", F.posexplode(L.sentences(F.col("texto"))).alias("k", "p"))
    named = parts.select("id", "k", F.explode(C.bodies(F.col("p"))).alias("norma_id"))
    bad = named.join(have, "norma_id", "left_anti").select("id", "k").distinct().withColumn("bad", F.lit(True))
    kept = parts.join(bad, ["id", "k"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bad").isNull(), F.struct("k", "p")))), lambda x: x["p"]), " ")
    return kept.groupBy("id").agg(text.alias("texto"), F.count("bad").alias("quitadas"))


def hierarchical_pieces(s: SparkSession, d: str) -> DataFrame:
    """Blocks of articles in pieces of at most 40 standing words."""
    blocks = table(s, d, "normas").where("art_id is not null").groupBy("art_id").agg(F.min("bloques").alias("b")).select("art_id", F.posexplode("b").alias("bloque", "x"))
    return L.pieces(blocks.select("art_id", "bloque", F.col("x.inicio").alias("inicio"), F.col("x.texto").alias("texto")), 40)


_HIDE = f"'{L.MARKS}', chr(1) || chr(2) || chr(3) || chr(4)"
_SHOW = f"chr(1) || chr(2) || chr(3) || chr(4), '{L.MARKS}'"


def parts_sql(c: str) -> str:
    """The parts of ``sentence_parts`` as a DuckDB list."""
    t = f"list_aggregate(list_transform(regexp_extract_all({c}, '{L.PROTECTED}', 1), lambda x: CASE WHEN x LIKE '{{{{%' OR x LIKE '~~%' THEN translate(x, {_HIDE}) ELSE x END), 'string_agg', '')"
    for pattern in L.VETOES:
        t = f"regexp_replace({t}, '{pattern}', '\\1' || chr(1), 'g')"
    t = f"regexp_replace({t}, '{L.CANDIDATE}', '\\1' || chr(6) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(6)), lambda x: translate(x, {_SHOW})), lambda x: x <> '')"


def _cut_sql(parts: str, source: str, keys: str) -> str:
    """Rows of a list of consecutive parts with their starts."""
    return f"SELECT {keys}, k, p, coalesce(sum(length(p)) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS st FROM (SELECT {keys}, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS k FROM (SELECT {keys}, {parts} AS ps FROM {source}))"


_SENTS = f"t AS (SELECT doc_id, min(texto) AS texto FROM leer WHERE texto IS NOT NULL GROUP BY doc_id), c AS ({_cut_sql(parts_sql('texto'), 't', 'doc_id')}), se AS (SELECT doc_id, k::INT AS k, st AS inicio, regexp_replace(p, '\\s+$', '') AS texto FROM c)"
_ANS = "an AS (SELECT id, concat_ws(' ', respuesta_esperada, 'Según la ' || legal_basis || '.', 'La sala lo confirmó; Terminó la audiencia.') AS texto FROM preguntas WHERE respuesta_esperada IS NOT NULL)"
_ASENTS = f"{_ANS}, ac AS ({_cut_sql(parts_sql('texto'), 'an', 'id')}), ap AS (SELECT id, k, regexp_replace(p, '\\s+$', '') AS p FROM ac WHERE trim(p) <> '')"
_WORDS = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
_STANDING = _WORDS.format(c=r"trim(regexp_replace(regexp_replace(regexp_replace(texto, '(?s)~~.*?(?:~~|$)', ' ', 'g'), '\s+', ' ', 'g'), ' ([.,;:])', '\1', 'g'))")


def _level_sql(name: str, source: str, parts: str, forced: bool) -> str:
    return f"""{name}a AS (SELECT *, {_STANDING} > 40 AS ov FROM {source}), {name}b AS (SELECT *, CASE WHEN ov THEN {parts} ELSE [texto] END AS ps FROM {name}a),
{name}c AS (SELECT art_id, bloque, inicio, forzado, ov, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM {name}b),
{name}d AS (SELECT *, inicio + coalesce(sum(length(p)) OVER (PARTITION BY art_id, bloque, inicio ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS st FROM {name}c),
{name} AS (SELECT art_id, bloque, st AS inicio, CASE WHEN ov THEN regexp_replace(p, '\\s+$', '') ELSE p END AS texto, forzado OR (ov AND {str(forced).lower()}) AS forzado FROM {name}d WHERE trim(p) <> '')"""


_CLAUSES = r"list_filter(string_split(regexp_replace(texto, '([;:]\s+)', '\1' || chr(6), 'g'), chr(6)), lambda x: x <> '')"
_BYWORDS = r"regexp_extract_all(texto, '(?s)(\s*(?:\S+\s*){1,40})', 1)"
QUERIES = {"legal_sentences": legal_sentences, "norm_sentences": norm_sentences, "shortened_answers": shortened_answers, "removed_citations": removed_citations, "hierarchical_pieces": hierarchical_pieces}
SQL = {
    "legal_sentences": f"WITH {_SENTS} SELECT doc_id, k, inicio, (inicio + length(texto))::INT AS fin, md5(texto) AS hash FROM se WHERE texto <> ''",
    "norm_sentences": f"WITH {_SENTS} SELECT doc_id, k, inicio, (inicio + length(texto))::INT AS fin FROM se WHERE regexp_matches(texto, '{L.MENTION}')",
    "shortened_answers": f"WITH {_ASENTS}, w AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY k) AS n, sum({_WORDS.format(c='p')}) OVER (PARTITION BY id ORDER BY k) AS run FROM ap), f AS (SELECT id, string_agg(p, ' ' ORDER BY n) FILTER (run <= 40) AS fit, min(p) FILTER (n = 1) AS first FROM w WHERE n <= 2 GROUP BY id) SELECT an.id, coalesce(fit, regexp_replace(array_to_string(regexp_split_to_array(trim(first), '\\s+')[1:40], ' '), '[\\s.,;:]+$', '') || '.', '') AS corto FROM an LEFT JOIN f USING (id)",
    "removed_citations": f"WITH {_ASENTS}, have AS (SELECT DISTINCT norma_id FROM fuentes WHERE estado = 'ok' AND norma_id IS NOT NULL), nm AS (SELECT id, k, unnest({bodies_sql('p')}) AS norma_id FROM ap), bad AS (SELECT DISTINCT id, k, true AS bad FROM nm ANTI JOIN have USING (norma_id)) SELECT id, coalesce(string_agg(p, ' ' ORDER BY k) FILTER (bad IS NULL), '') AS texto, count(bad) AS quitadas FROM ap LEFT JOIN bad USING (id, k) GROUP BY id",
    "hierarchical_pieces": f"WITH nb AS (SELECT art_id, min(bloques) AS b FROM normas WHERE art_id IS NOT NULL GROUP BY art_id), bl AS (SELECT art_id, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS bloque FROM nb), p0 AS (SELECT art_id, bloque::INT AS bloque, x.inicio AS inicio, x.texto AS texto, false AS forzado FROM bl WHERE trim(x.texto) <> ''), {_level_sql('p1', 'p0', parts_sql('texto'), False)}, {_level_sql('p2', 'p1', _CLAUSES, True)}, {_level_sql('p3', 'p2', _BYWORDS, True)} SELECT art_id, bloque, inicio, (inicio + length(texto))::INT AS fin, forzado FROM p3",
}
