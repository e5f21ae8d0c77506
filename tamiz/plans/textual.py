"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import paragraphs
from tamiz.session import table

_FOLD = f"translate({{c}}, '{T.ACCENTED}', '{T.FOLDED}')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def fold(c: str) -> str:
    return _FOLD.format(c=c)


def _texts(s: SparkSession, d: str) -> DataFrame:
    """One row for each document and text; copies are told by a hash, so that a text's bytes are compared nowhere."""
    return table(s, d, "leer").where("texto is not null").groupBy("doc_id", F.xxhash64("texto")).agg(F.first("texto").alias("texto")).select("doc_id", "texto")


def accent_fold(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", F.sha1(F.lower(T.fold(F.col("texto"))).cast("binary")).alias("hash"))


def normalised_titles(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "fuentes").where("titulo is not null").select("titulo").distinct()
    return t.select("titulo", T.normal(F.col("titulo")).alias("normal"), T.slug(F.col("titulo")).alias("slug"))


def strip_struck(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).where(F.col("texto").contains("~~"))
    return t.select("doc_id", F.sha1(T.strip_struck(F.col("texto")).cast("binary")).alias("hash"))


def word_counts(s: SparkSession, d: str) -> DataFrame:
    c = F.col("texto")
    return _texts(s, d).select("doc_id", T.word_count(c).alias("n_words"), T.token_estimate(c).alias("n_tokens"), F.length(c).alias("n_chars"))


def text_fingerprint(s: SparkSession, d: str) -> DataFrame:
    c = F.col("texto")
    return _texts(s, d).select("doc_id", F.sha1(c.cast("binary")).alias("exact"), T.text_hash(c).alias("loose"), T.long_text_hash(c, 3000).alias("long_only"))


def legal_token_counts(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", T.legal_tokens(F.col("texto")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


def content_words(s: SparkSession, d: str) -> DataFrame:
    """Content words of at least five texts; all rows are counted, the threshold is what the report, like its SQL, asks for."""
    t = _texts(s, d).select("doc_id", F.explode_outer(T.content_words(F.col("texto"))).alias("w"))
    return t.where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


def sentence_split_simple(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", T.simple_sentences(F.col("texto")).alias("p"))
    return t.select("doc_id", F.size("p").alias("n"), F.array_max(F.transform("p", F.length)).alias("longest"))


def clause_split(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", T.clauses(F.col("texto")).alias("p"))
    return t.select("doc_id", F.size("p").alias("n"), F.array_max(F.transform("p", F.length)).alias("longest"))


def fixed_word_chunks(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", F.posexplode(T.fixed_chunks(F.col("texto"), 200)).alias("k", "t"))
    return t.select("doc_id", "k", T.word_count(F.col("t")).alias("n_words"), F.md5(F.col("t").cast("binary")).alias("hash"))


def truncated_answers(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").where("respuesta_esperada is not null")
    return p.select("id", T.truncate_sentences(F.col("respuesta_esperada"), 2, 40).alias("short"))


def join_broken_lines(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "texto").where("markdown is not null and metodo = 'pdf_texto'").select(F.col("texto_id").alias("id"), F.col("markdown").alias("text"))
    return paragraphs.join_lines(t).select("id", "k", F.md5(F.col("text").cast("binary")).alias("hash"))


def page_lines(s: SparkSession, d: str) -> DataFrame:
    """Short lines that stand on more than half of the pages of a part of at least four pages."""
    t = table(s, d, "texto").where("markdown is not null").select(F.col("texto_id").alias("id"), F.col("markdown").alias("text"))
    return paragraphs.repeated_lines(t).select("id", "line", "n_pages", "pages")


def dehyphenated(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "texto").where(F.col("metodo").isin("pdf_ocr", "pdf_texto"))
    return t.select("texto_id", F.md5(T.dehyphenate(F.col("markdown")).cast("binary")).alias("hash"))


def upper_titles(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "normas").select("art_id", "bloques").distinct().select("art_id", F.posexplode("bloques").alias("k", "b"))
    return b.where(T.is_upper_title(F.col("b.texto"))).select("art_id", "k", F.col("b.texto").alias("title"))


def header_lines(s: SparkSession, d: str) -> DataFrame:
    lines = _texts(s, d).select("doc_id", F.posexplode(F.split("texto", "\n")).alias("k", "line"))
    return lines.where(T.is_header_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))


def struck_share(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", F.size(F.filter(F.split("texto", "~~"), lambda x: x != "")).alias("parts"), (F.size(F.split("texto", "~~")) - 1).alias("marks"))
    return t.where("marks > 0").select("doc_id", "parts", "marks", (F.col("marks") % 2 == 1).alias("unclosed"))


def letter_rotations(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").where("opciones is not null").select("id", F.sort_array(F.map_keys("opciones")).alias("l"))
    return p.select("id", F.posexplode(F.transform(T.cyclic_orders(F.col("l"), 3), lambda x: F.array_join(x, ""))).alias("k", "letters"))


def number_format(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"))
    return t.select("lang", T.miles(F.col("chars")).alias("chars_text"))


def five_grams_shared(s: SparkSession, d: str) -> DataFrame:
    """Runs of five words that stand in at least twenty norms' texts; all rows are counted, the threshold is what the report, like its SQL, asks for."""
    # One row a document, so that a run is counted, and pre-aggregated, without a distinct over runs and documents.
    docs = table(s, d, "leer").where("texto is not null").groupBy("doc_id").agg(F.collect_set("texto").alias("x"))
    runs = docs.select(F.transform("x", lambda x: T.tokens(x)).alias("t")).select(F.array_distinct(F.flatten(F.transform("t", lambda t: T.ngrams(t, 5)))).alias("g"))
    return runs.select(F.explode_outer("g").alias("g")).where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


def legal_sql(c: str) -> str:
    """Index tokens as a DuckDB list."""
    t = f"lower({fold(c)})"
    for pattern, to in T.LEGAL_RULES:
        t = f"regexp_replace({t}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return rf"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda x: x <> '_' AND x NOT IN ({', '.join(f"'{w}'" for w in T.INDEX_STOPWORDS)}))"


def overlap_sql(c: str) -> str:
    """Content tokens for measures of overlap as a DuckDB list."""
    return rf"list_filter(regexp_extract_all(lower({fold(c)}), '[\p{{L}}\p{{N}}_]+'), lambda x: (length(x) > 1 OR regexp_matches(x, '^\d$')) AND x NOT IN ({_STOP}))"


_T = "t AS (SELECT DISTINCT doc_id, texto FROM leer WHERE texto IS NOT NULL)"
_WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


def words(c: str) -> str:
    return _WORDS.format(c=c)


QUERIES = {
    "accent_fold": accent_fold, "normalised_titles": normalised_titles, "strip_struck": strip_struck, "word_counts": word_counts, "text_fingerprint": text_fingerprint, "legal_token_counts": legal_token_counts, "content_words": content_words,
    "sentence_split_simple": sentence_split_simple, "clause_split": clause_split, "fixed_word_chunks": fixed_word_chunks, "truncated_answers": truncated_answers, "join_broken_lines": join_broken_lines, "repeated_page_lines": page_lines,
    "dehyphenated": dehyphenated, "upper_titles": upper_titles, "header_lines": header_lines, "struck_share": struck_share, "letter_rotations": letter_rotations, "number_format": number_format, "five_grams_shared": five_grams_shared,
}
_TOKENS = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1)"
SQL = {
    "accent_fold": f"WITH {_T} SELECT doc_id, sha1(lower({fold('texto')})) AS hash FROM t",
    "normalised_titles": rf"SELECT titulo, trim(regexp_replace(lower({fold('titulo')}), '\s+', ' ', 'g')) AS normal, coalesce(nullif(trim(regexp_replace(lower({fold('titulo')}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'doc') AS slug FROM (SELECT DISTINCT titulo FROM fuentes WHERE titulo IS NOT NULL)",
    "strip_struck": rf"WITH {_T} SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(texto, '(?s)~~.*?(?:~~|$)', ' ', 'g'), '\s+', ' ', 'g'), ' ([.,;:])', '\1', 'g'))) AS hash FROM t WHERE contains(texto, '~~')",
    "word_counts": f"WITH {_T} SELECT doc_id, len({words('texto')}) AS n_words, floor(length(texto) / 3.5)::INT + 1 AS n_tokens, length(texto) AS n_chars FROM t",
    "text_fingerprint": rf"WITH {_T}, h AS (SELECT doc_id, texto, sha1(trim(regexp_replace(lower(texto), '\s+', ' ', 'g'))) AS loose FROM t) SELECT doc_id, sha1(texto) AS exact, loose, CASE WHEN length(texto) >= 3000 THEN loose END AS long_only FROM h",
    "legal_token_counts": f"WITH {_T}, k AS (SELECT doc_id, {legal_sql('texto')} AS t FROM t) SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM k",
    "content_words": rf"WITH {_T}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower({fold('texto')}), '[\p{{L}}\p{{N}}]+')) AS w FROM t) SELECT w, count(*) AS df FROM w WHERE length(w) >= 4 AND w NOT IN ({_STOP}) GROUP BY w HAVING count(*) >= 5",
    "sentence_split_simple": rf"WITH {_T}, p AS (SELECT doc_id, list_filter(string_split(regexp_replace(texto, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM t) SELECT doc_id, len(p) AS n, list_max(list_transform(p, lambda x: length(x))) AS longest FROM p",
    "clause_split": rf"WITH {_T}, p AS (SELECT doc_id, list_filter(string_split(regexp_replace(texto, '([;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM t) SELECT doc_id, len(p) AS n, list_max(list_transform(p, lambda x: length(x))) AS longest FROM p",
    "fixed_word_chunks": f"WITH {_T}, w AS (SELECT doc_id, {words('texto')} AS w FROM t), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 199) // 200)) AS k FROM w) SELECT doc_id, k::INT AS k, len(w[k * 200 + 1:k * 200 + 200]) AS n_words, md5(array_to_string(w[k * 200 + 1:k * 200 + 200], ' ')) AS hash FROM c",
    "dehyphenated": r"SELECT texto_id, md5(regexp_replace(markdown, '([a-záéíóúñ])-\n([a-záéíóúñ])', '\1\2', 'g')) AS hash FROM texto WHERE metodo IN ('pdf_ocr', 'pdf_texto')",
    "join_broken_lines": r"""
WITH l AS (SELECT texto_id AS id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM texto WHERE metodo = 'pdf_texto' AND markdown IS NOT NULL),
f AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY n) AS prev FROM l),
g AS (SELECT id, n, trim(line) AS line, sum(CASE WHEN prev IS NULL OR trim(prev) = '' OR trim(line) = '' OR regexp_matches(trim(prev), '[.:;?!]$') OR NOT regexp_matches(trim(line), '^[a-záéíóúñü]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS grp FROM f),
p AS (SELECT id, grp, string_agg(line, ' ' ORDER BY n) AS text FROM g WHERE line <> '' GROUP BY id, grp)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY grp) - 1)::INT AS k, md5(text) AS hash FROM p""",
    "repeated_page_lines": r"""
WITH pg AS (SELECT texto_id AS id, unnest(string_split(regexp_replace(markdown, '<!-- pagina \d+ -->', chr(1), 'g'), chr(1))) AS page, generate_subscripts(string_split(regexp_replace(markdown, '<!-- pagina \d+ -->', chr(1), 'g'), chr(1)), 1) AS p FROM texto WHERE markdown IS NOT NULL),
q AS (SELECT * FROM pg WHERE trim(page, ' ' || chr(10)) <> ''), tot AS (SELECT id, count(*) AS pages FROM q GROUP BY id HAVING count(*) >= 4),
l AS (SELECT id, p, trim(unnest(string_split(page, chr(10)))) AS line FROM q)
SELECT l.id, line, count(DISTINCT p) AS n_pages, any_value(pages) AS pages FROM l JOIN tot USING (id) WHERE line <> '' AND length(line) <= 80 GROUP BY l.id, line HAVING count(DISTINCT p) * 2 > any_value(pages)""",
    "upper_titles": r"WITH n AS (SELECT DISTINCT art_id, bloques FROM normas), b AS (SELECT art_id, unnest(bloques) AS b, generate_subscripts(bloques, 1) - 1 AS k FROM n) SELECT art_id, k::INT AS k, b.texto AS title FROM b WHERE length(b.texto) <= 250 AND NOT contains(b.texto, chr(10)) AND length(regexp_replace(b.texto, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(b.texto, '[^\p{Lu}]', '', 'g')) > 0.8 * length(regexp_replace(b.texto, '[^\p{L}]', '', 'g'))",
    "header_lines": rf"WITH {_T}, l AS (SELECT doc_id, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) - 1 AS k FROM t) SELECT doc_id, count(*) AS n, min(k)::INT AS first FROM l WHERE regexp_matches(lower({fold('line')}), '^\s*#*\s*(articulo|art\.|capitulo|titulo|libro|seccion|paragrafo)\b') GROUP BY doc_id",
    "struck_share": f"WITH {_T}, p AS (SELECT doc_id, len(list_filter(string_split(texto, '~~'), lambda x: x <> '')) AS parts, len(string_split(texto, '~~')) - 1 AS marks FROM t) SELECT doc_id, parts, marks, marks % 2 = 1 AS unclosed FROM p WHERE marks > 0",
    "letter_rotations": "WITH p AS (SELECT id, list_sort(map_keys(opciones)) AS l FROM preguntas WHERE opciones IS NOT NULL), k AS (SELECT id, l, unnest(range(0, least(3, len(l)))) AS k FROM p) SELECT id, k::INT AS k, array_to_string(list_concat(l[k + 1:], l[:k]), '') AS letters FROM k",
    "number_format": "SELECT lang, replace(format('{:,}', sum(n_chars)::BIGINT), ',', '.') AS chars_text FROM documents GROUP BY lang",
    "five_grams_shared": f"WITH {_T}, k AS (SELECT doc_id, {_TOKENS.format(c=fold('texto'))} AS w FROM t), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM k, unnest(range(1, len(w) - 3)) AS r(i)) SELECT g, count(DISTINCT doc_id) AS n FROM g GROUP BY g HAVING count(DISTINCT doc_id) >= 20",
}
