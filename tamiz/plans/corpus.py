"""Queries that tie items, norms and documents together, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import urls as U
from tamiz.operators import identity, lookup
from tamiz.plans.citing import articles_sql, bodies_sql
from tamiz.plans.hybrid import _lex, _LEX, lexical_topk
from tamiz.plans.registry import key_sql
from tamiz.session import table


def _basis(s: SparkSession, d: str) -> DataFrame:
    """Items with their basis; so that norms of the corpus are named, too, the text of one document and an article of its norm are part of it."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("k"), "text", F.concat(F.lit("Artículo 2 de la "), C.readable(F.col("norma_id"))).alias("own"))
    p = table(s, d, "preguntas").select("id", "formato", "area", "legal_basis", (F.col("id") % 100 + 1000000).alias("k"))
    return p.join(docs, "k", "left").select("id", "formato", "area", F.concat_ws(" ", "legal_basis", "text", "own").alias("basis"))


def _named(s: SparkSession, d: str) -> DataFrame:
    """Named articles, then named norms of which no article is, each in order of their ids."""
    b = _basis(s, d).select("id", F.array_sort(C.articles(F.col("basis"))).alias("a"), F.array_sort(C.bodies(F.col("basis"))).alias("b"))
    rest = F.filter("b", lambda x: ~F.exists("a", lambda y: F.split(y, "#")[0] == x))
    return b.select(F.col("id").alias("qid"), F.posexplode(F.concat("a", rest)).alias("n", "ident"))


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "normas").where("art_id is not null and norma_id is not null").select(F.col("art_id").alias("row_id"), F.concat("norma_id", F.lit("#art_"), F.upper(F.coalesce("num", F.lit("")))).alias("canon")).distinct()


def _ranking(s: SparkSession, d: str) -> DataFrame:
    """A ranking that does not follow the ids: rows of the named norms by a hash of item and row."""
    named = _named(s, d).select("qid", F.split("ident", "#")[0].alias("base")).distinct()
    rows = _catalog(s, d).select("row_id", F.split("canon", "#")[0].alias("base"))
    key = F.md5(F.concat_ws("-", F.col("qid").cast("string"), F.col("row_id").cast("string")))
    return named.join(rows, "base").select("qid", "row_id", F.row_number().over(Window.partitionBy("qid").orderBy(key)).alias("rank"))


def direct_lookup(s: SparkSession, d: str) -> DataFrame:
    return lookup.direct_rows(_named(s, d), _catalog(s, d), _ranking(s, d))


def oracle_context(s: SparkSession, d: str) -> DataFrame:
    """Up to two rows of every named id, of a norm without an article its first ones, eight in all."""
    first = _catalog(s, d).select("row_id", "canon").unionByName(_catalog(s, d).select("row_id", F.split("canon", "#")[0].alias("canon"))).distinct()
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("canon").orderBy("row_id"))).where("k <= 2").withColumnRenamed("canon", "ident")
    once = _named(s, d).join(top, "ident").groupBy("qid", "row_id").agg(F.min(F.struct("n", "k")).alias("o"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).where("n <= 8").select("qid", "row_id", "n")


def named_in_corpus(s: SparkSession, d: str) -> DataFrame:
    return lookup.named_in_corpus(_named(s, d), _catalog(s, d))


def readable_names(s: SparkSession, d: str) -> DataFrame:
    """Names of the registered norms; null where reading the name gives another norm."""
    f = table(s, d, "fuentes").where("norma_id is not null").select("norma_id").distinct()
    return f.select("norma_id", C.readable(F.col("norma_id")).alias("nombre"))


def supported_citations(s: SparkSession, d: str) -> DataFrame:
    """For every norm that a document's text names, the first document of that norm that names it itself."""
    docs = table(s, d, "documents").where("norma_id is not null").select("doc_id", "norma_id", F.concat_ws(" ", "text", C.readable(F.col("norma_id"))).alias("t"), "text")
    cited = _basis(s, d).select(F.col("id").alias("qid"), F.explode(C.bodies(F.col("basis"))).alias("cuerpo")).select("qid", "cuerpo", F.lit(0).alias("n"), F.col("cuerpo").alias("ident"))
    catalog = docs.select(F.col("doc_id").alias("row_id"), F.col("norma_id").alias("canon"), C.bodies(F.when(F.col("doc_id") % 3 != 0, F.col("t")).otherwise(F.col("text"))).alias("nombra"))
    return lookup.supporting_row(cited, catalog)


def covered_norms(s: SparkSession, d: str) -> DataFrame:
    """Named norms and whether the registry holds them, by number or by the name that the number stands for."""
    keys = _basis(s, d).select(F.explode(C.bodies(F.concat_ws(" ", "basis", F.lit("Ley 1480 de 2011, Código Civil, estatuto tributario")))).alias("clave")).distinct()
    exact = table(s, d, "fuentes").where("norma_id is not null").select(F.col("norma_id").alias("clave"))
    slugs = s.createDataFrame([("codigo_civil",), ("estatuto_consumidor",)], "clave string")
    return lookup.covered(keys, exact, slugs, C.ALIASES).select("clave", "cubierta")


def cited_bodies(s: SparkSession, d: str) -> DataFrame:
    """All norms that texts name, with the number of documents and the first of them."""
    t = table(s, d, "leer").where("texto is not null").select("doc_id", F.explode(C.bodies(F.col("texto"))).alias("norma"))
    return t.groupBy("norma").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("primero"))


def relevance_classes(s: SparkSession, d: str) -> DataFrame:
    """Items by what their basis names: nothing, nothing that a text of the corpus names, or something."""
    have = cited_bodies(s, d).select("norma", F.lit(True).alias("h"))
    b = _basis(s, d).select("id", F.when(F.col("id") % 9 == 0, F.lit("")).when(F.col("id") % 4 == 0, F.lit("Ley 1 de 1801")).otherwise(F.col("basis")).alias("basis"))
    j = b.select("id", F.explode_outer(C.bodies(F.col("basis"))).alias("norma")).join(have, "norma", "left")
    g = j.groupBy("id").agg(F.count("norma").alias("n"), F.count("h").alias("h"))
    return g.select("id", F.when(F.col("n") == 0, "sin_citas").when(F.col("h") == 0, "fuera_del_corpus").otherwise("evaluable").alias("grupo"))


def relevant_texts(s: SparkSession, d: str) -> DataFrame:
    """Documents that are or name a norm of an item's basis: set overlap as an equi-join of exploded ids."""
    q = _basis(s, d).select("id", F.explode(C.bodies(F.col("basis"))).alias("norma"))
    named = F.array_compact(F.array_union(C.bodies(F.col("texto")), F.array("norma_id")))
    t = table(s, d, "leer").where("texto is not null").select("doc_id", F.explode(named).alias("norma"))
    return q.join(t, "norma").select("id", "doc_id").distinct()


def merged_targets(s: SparkSession, d: str) -> DataFrame:
    """One row for all entries with the same id or the same address, directly or through others: items summed, areas united."""
    f = table(s, d, "fuentes").where("doc_id is not null")
    keys = f.select("doc_id", F.array(F.concat(F.lit("u:"), F.lower(F.regexp_replace("url", "#.*$", "")))).alias("keys"))
    rows = f.join(identity.same_keys(keys), "doc_id")
    sums = rows.groupBy("component").agg(F.sum("items_del_banco").alias("items"), F.count(F.lit(1)).alias("entradas"))
    areas = rows.select("component", F.explode("areas").alias("area")).distinct().groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("area")), ",").alias("areas"))
    return sums.join(areas, "component", "left").select(F.col("component").alias("doc_id"), "items", "entradas", F.coalesce("areas", F.lit("")).alias("areas"))


def manifest_counts(s: SparkSession, d: str) -> DataFrame:
    """Documents with text: spans and articles of each, and the first title there is."""
    have = table(s, d, "leer").select("doc_id").distinct()
    spans = table(s, d, "partir").groupBy("doc_id").agg(F.countDistinct("tramo_id").alias("tramos"))
    arts = table(s, d, "normas").groupBy("doc_id").agg(F.countDistinct("art_id").alias("articulos"), F.min_by("titulo", F.when(F.trim("titulo") != "", F.struct("orden", "art_id"))).alias("t_art"))
    reg = table(s, d, "fuentes").where("titulo is not null").groupBy("doc_id").agg(F.min("titulo").alias("t_reg"))
    j = have.join(spans, "doc_id", "left").join(arts, "doc_id", "left").join(reg, "doc_id", "left")
    return j.select("doc_id", F.coalesce("tramos", F.lit(0)).alias("tramos"), F.coalesce("articulos", F.lit(0)).alias("articulos"), F.coalesce("t_art", "t_reg", "doc_id").alias("titulo"))


def pair_hits(s: SparkSession, d: str) -> DataFrame:
    """For every item and norm of its basis that documents hold: where the norm first stands in the item's ranking, and how often."""
    docs = table(s, d, "documents").where("norma_id is not null").select(F.col("doc_id").alias("row_id"), F.col("norma_id").alias("norma"))
    pairs = _basis(s, d).select(F.col("id").alias("qid"), F.explode(C.bodies(F.col("basis"))).alias("norma")).join(docs.select("norma").distinct(), "norma", "left_semi")
    hits = lexical_topk(s, d, 10).join(docs, "row_id").groupBy("qid", "norma").agg(F.min("rank").alias("posicion"), F.count(F.lit(1)).alias("veces"))
    return pairs.join(hits, ["qid", "norma"], "left").select("qid", "norma", "posicion", F.coalesce("veces", F.lit(0)).alias("veces"))


def area_coverage(s: SparkSession, d: str) -> DataFrame:
    """By area: items and the mean share of their basis' norms that the registry holds."""
    have = table(s, d, "fuentes").where("norma_id is not null").select(F.col("norma_id").alias("norma")).distinct().withColumn("h", F.lit(1))
    j = _basis(s, d).select("id", "area", F.explode(C.bodies(F.col("basis"))).alias("norma")).join(have, "norma", "left")
    g = j.groupBy("id", "area").agg((F.count("h") / F.count("norma")).alias("c"))
    return g.groupBy("area").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("c"), 4).alias("cobertura"))


def canonical_ids(s: SparkSession, d: str) -> DataFrame:
    """Canonical id of a document: the one it brings, else the norm its title names, a code before a number, else its own id."""
    f = table(s, d, "fuentes").where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("canonico", "titulo"), "registrado").alias("r")).select("doc_id", "r.*")
    named = F.array_sort(F.transform(C.bodies(F.col("titulo")), lambda b: F.struct(b.rlike(r"\d").alias("numbered"), b.alias("b"))))
    return f.select("doc_id", F.coalesce(F.array_join("canonico", "_"), F.get(named, F.lit(0))["b"], "doc_id").alias("canon"))


def completed_metadata(s: SparkSession, d: str) -> DataFrame:
    """Records whose empty fields are filled from their title or id, and which ones were."""
    f = table(s, d, "fuentes").where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("titulo", "tipo_norma", "numero", "anio", "fuente", "url"), "registrado").alias("r")).select("doc_id", "r.*")
    title = F.coalesce("titulo", F.regexp_replace("doc_id", "_", " "))
    pattern = r"(?i)^(ley|decreto|resoluci[oó]n|acuerdo|circular|sentencia|auto)\s+(\w+)\s+(?:de\s+)?(\d{4})"
    part = lambda k: F.nullif(F.regexp_extract(title, pattern, k), F.lit(""))
    host = F.nullif(U.host(F.col("url")), F.lit(""))
    new = {"titulo": title, "tipo_norma": F.lower(part(1)), "numero": part(2), "anio": part(3).cast("int"), "fuente": host}
    filled = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull() & v.isNotNull(), F.lit(c)) for c, v in new.items()])), ",")
    return f.select("doc_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in new.items()], filled.alias("deducidos"))


def enumerated_articles(s: SparkSession, d: str) -> DataFrame:
    """Articles that are listed before their norm (``artículos 5, 6 y 7 de la Ley 3 de 1990``), one row each."""
    t = table(s, d, "preguntas").select("id", F.concat(F.lit("Según los artículos "), (F.col("id") % 40).cast("string"), F.lit(", "), (F.col("id") % 7).cast("string"), F.lit(" y 9A de la Ley "), (F.col("id") % 500).cast("string"), F.lit(" de 1990; arts. 3 y 4 del Decreto 7 de 2001.")).alias("t"))
    return t.select("id", F.explode(C.enumerated(F.col("t"))).alias("articulo"))


def bare_laws(s: SparkSession, d: str) -> DataFrame:
    """Codes that are named by the number of their law alone."""
    t = table(s, d, "preguntas").select("id", F.concat_ws(" ", F.lit("Conforme a la Ley"), F.element_at(F.array(F.lit("599"), F.lit("1564"), F.lit("77"), F.lit("1098")), (F.col("id") % 4 + 1).cast("int")), F.lit("y a la ley 906.")).alias("t"))
    return t.select("id", F.explode(C.bare(F.col("t"))).alias("norma"))


def passages_out(s: SparkSession, d: str) -> DataFrame:
    """Passages as delivered: the first ten, scores to five places, score by place in the list, no field without a value."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "norma_id", "area")
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    j = lexical_topk(s, d, 10).join(docs, "row_id").withColumn("por_lugar", n - F.col("rank"))
    fields = F.array_compact(F.array(F.lit("row_id"), F.when(F.col("norma_id").isNotNull(), F.lit("norma_id")), F.when(F.col("area").isNotNull(), F.lit("area"))))
    return j.select("qid", "rank", "row_id", (F.floor(F.col("score") * 100000 + 0.5) / 100000).alias("score"), "por_lugar", F.array_join(fields, ",").alias("campos"))


def option_passages(s: SparkSession, d: str) -> DataFrame:
    """Passages of an item's options under the letters of a rotation; only those of options or direct ones, where there are any."""
    p = table(s, d, "preguntas").where("opciones is not null").select("id", F.sort_array(F.map_keys("opciones")).alias("l"))
    x = p.select("id", "l", F.posexplode(F.concat("l", F.array(F.lit(None).cast("string"), F.lit(None).cast("string")))).alias("k", "opcion")).withColumn("opcion", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("opcion")))
    x = x.withColumn("via", F.when((F.col("k") == F.size("l")) & (F.col("id") % 2 == 0), "directo").otherwise("hibrido"))
    keep = F.col("opcion").isNotNull() | (F.col("via") == "directo")
    kept = x.withColumn("any", F.bool_or(keep).over(Window.partitionBy("id"))).where(keep | ~F.col("any"))
    moved = F.element_at("l", (F.pmod(F.array_position("l", F.col("opcion")) - 1 + 1, F.size("l")) + 1).cast("int"))
    return kept.select("id", "k", F.when(F.col("opcion").isNotNull(), moved).alias("opcion"), "via")


def right_options(s: SparkSession, d: str) -> DataFrame:
    """Text of the right option, and the line of a delivery that abstains from everything."""
    p = table(s, d, "preguntas").where("opciones is not null")
    return p.select("id", F.element_at("opciones", F.col("respuesta_correcta")).alias("correcta"), F.lit(True).alias("abstencion"), F.lit("").alias("justificacion"))


def runs_by_text(s: SparkSession, d: str) -> DataFrame:
    """Two runs whose ids differ, joined by the text of the question."""
    p = table(s, d, "preguntas").where("pregunta is not null").select("id", F.md5("pregunta").alias("h"))
    a, b = p.groupBy("h").agg(F.min("id").alias("id_a")), p.where("id % 5 <> 0").groupBy("h").agg(F.min(F.col("id") + 10000).alias("id_b"))
    return a.join(b, "h", "left").select("id_a", "id_b")


def chosen_files(s: SparkSession, d: str) -> DataFrame:
    """Parts whose file is no note, of the documents with an even number of files."""
    t = table(s, d, "texto").where("archivo is not null and doc_id is not null and not archivo like '%.notas.md'").select("doc_id", "archivo").distinct()
    wanted = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0").select("doc_id")
    return t.join(wanted, "doc_id", "left_semi")


def source_names(s: SparkSession, d: str) -> DataFrame:
    """Addresses by the source that the end of their host belongs to; the host itself where none is known."""
    known = s.createDataFrame([("garantias.example", "Tribunal"), ("normas.example", "Compilación")], "fin string, nombre string")
    u = table(s, d, "fuentes").where("url is not null").select("url").distinct().withColumn("host", U.host(F.col("url"))).withColumn("fin", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    return u.join(known, "fin", "left").groupBy(F.coalesce("nombre", "host").alias("nombre")).agg(F.count(F.lit(1)).alias("n"))


_NAME = "CASE WHEN regexp_matches({c}, '^[a-z]+_[0-9]+_[0-9]{{4}}$') THEN (CASE string_split({c}, '_')[1] WHEN 'resolucion' THEN 'Resolución' ELSE upper(string_split({c}, '_')[1][1]) || string_split({c}, '_')[1][2:] END) || ' ' || string_split({c}, '_')[2] || ' de ' || string_split({c}, '_')[3] END"


def _readable_sql(c: str) -> str:
    n = _NAME.format(c=c)
    return f"CASE WHEN len({bodies_sql(n)}) = 1 AND list_contains({bodies_sql(n)}, {c}) THEN {n} END"


_B = f"bs AS (SELECT p.id, p.formato, p.area, concat_ws(' ', p.legal_basis, d.text, 'Artículo 2 de la ' || {_readable_sql('d.norma_id')}) AS basis FROM preguntas p LEFT JOIN documents d ON d.doc_id = 1000000 + p.id % 100)"
_BB = f"{_B}, bb AS (SELECT id, area, unnest({bodies_sql('basis')}) AS norma FROM bs)"
_NAMED = f"{_B}, na AS (SELECT id, list_sort({articles_sql('basis')}) AS a, list_sort({bodies_sql('basis')}) AS b FROM bs), nb AS (SELECT id, list_concat(a, list_filter(b, lambda x: len(list_filter(a, lambda y: string_split(y, '#')[1] = x)) = 0)) AS l FROM na), nm AS (SELECT id AS qid, unnest(l) AS ident, generate_subscripts(l, 1) - 1 AS n FROM nb)"
_CAT = "ct AS (SELECT DISTINCT art_id AS row_id, norma_id || '#art_' || upper(coalesce(num, '')) AS canon, norma_id AS base FROM normas WHERE art_id IS NOT NULL AND norma_id IS NOT NULL)"
_ENUM = r"regexp_extract_all(lower(strip_accents({c})), '\bart(?:iculo|iculos|s\.|\.)\s+\d+[a-z]?(?:(?:\s*,\s*|\s+y\s+)\d+[a-z]?)*\s+(?:de\s+(?:la|el)\s+|del\s+)(?:ley|decreto|resolucion|acuerdo|circular|sentencia|auto)\s+\d+\s+de\s+\d{{4}}')"
_FIRST = "(SELECT * FROM fuentes WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY registrado) = 1)"
QUERIES = {
    "direct_lookup": direct_lookup, "oracle_context": oracle_context, "named_in_corpus": named_in_corpus, "readable_names": readable_names, "supported_citations": supported_citations, "covered_norms": covered_norms, "cited_bodies": cited_bodies,
    "relevance_classes": relevance_classes, "relevant_texts": relevant_texts, "merged_targets": merged_targets, "manifest_counts": manifest_counts, "pair_hits": pair_hits, "area_coverage": area_coverage, "canonical_ids": canonical_ids, "completed_metadata": completed_metadata,
    "enumerated_articles": enumerated_articles, "bare_laws": bare_laws, "passages_out": passages_out, "option_passages": option_passages, "right_options": right_options, "runs_by_text": runs_by_text, "chosen_files": chosen_files, "source_names": source_names,
}
SQL = {
    "direct_lookup": f"WITH {_NAMED}, {_CAT}, rk AS (SELECT qid, row_id, base, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || '-' || row_id)) AS rank FROM (SELECT DISTINCT qid, string_split(ident, '#')[1] AS base FROM nm) JOIN ct USING (base)), f2 AS (SELECT canon, row_id, row_number() OVER (PARTITION BY canon ORDER BY row_id) AS k FROM ct QUALIFY k <= 2), ex AS (SELECT qid, n, f2.row_id, k FROM nm JOIN f2 ON canon = ident WHERE contains(ident, '#')), rs AS (SELECT * FROM nm ANTI JOIN ex USING (qid, n)), nr AS (SELECT rs.qid, n, row_id, row_number() OVER (PARTITION BY rs.qid, n ORDER BY rank, row_id) AS k FROM rs JOIN rk ON rk.qid = rs.qid AND base = string_split(ident, '#')[1] QUALIFY k <= 2), o AS (SELECT qid, row_id, min((n, k)) AS o FROM (SELECT * FROM ex UNION ALL SELECT * FROM nr) GROUP BY qid, row_id) SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY o, row_id) AS n FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY o, row_id) <= 4",
    "oracle_context": f"WITH {_NAMED}, {_CAT}, fx AS (SELECT canon AS ident, row_id FROM ct UNION SELECT base, row_id FROM ct), t2 AS (SELECT ident, row_id, row_number() OVER (PARTITION BY ident ORDER BY row_id) AS k FROM fx QUALIFY k <= 2), o AS (SELECT qid, row_id, min((n, k)) AS o FROM nm JOIN t2 USING (ident) GROUP BY qid, row_id) SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY o) AS n FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY o) <= 8",
    "named_in_corpus": f"WITH {_NAMED}, {_CAT}, h AS (SELECT DISTINCT base FROM ct) SELECT qid, count(*) AS nombradas, count(h.base) AS en_corpus, count(*) - count(h.base) AS sin_corpus FROM nm LEFT JOIN h ON h.base = string_split(ident, '#')[1] GROUP BY qid",
    "readable_names": f"SELECT norma_id, {_readable_sql('norma_id')} AS nombre FROM (SELECT DISTINCT norma_id FROM fuentes WHERE norma_id IS NOT NULL)",
    "supported_citations": f"WITH {_BB}, c AS (SELECT doc_id, norma_id, {bodies_sql('t')} AS nb, row_number() OVER (PARTITION BY norma_id ORDER BY doc_id) AS k FROM (SELECT doc_id, norma_id, CASE WHEN doc_id % 3 <> 0 THEN concat_ws(' ', text, {_readable_sql('norma_id')}) ELSE text END AS t FROM documents WHERE norma_id IS NOT NULL)) SELECT id AS qid, norma AS cuerpo, min(doc_id) AS row_id FROM bb JOIN c ON norma_id = norma AND k <= 30 AND list_contains(nb, norma) GROUP BY id, norma",
    "covered_norms": f"WITH {_B}, k AS (SELECT DISTINCT unnest({bodies_sql('b2')}) AS clave FROM (SELECT concat_ws(' ', basis, 'Ley 1480 de 2011, Código Civil, estatuto tributario') AS b2 FROM bs)) SELECT clave, clave IN (SELECT norma_id FROM fuentes WHERE norma_id IS NOT NULL) OR clave IN ('codigo_civil', 'estatuto_consumidor') AS cubierta FROM k",
    "cited_bodies": f"SELECT norma, count(DISTINCT doc_id) AS docs, min(doc_id) AS primero FROM (SELECT doc_id, unnest({bodies_sql('texto')}) AS norma FROM leer WHERE texto IS NOT NULL) GROUP BY norma",
    "relevance_classes": f"WITH {_B}, h AS (SELECT DISTINCT unnest({bodies_sql('texto')}) AS norma FROM leer WHERE texto IS NOT NULL), b2 AS (SELECT id, CASE WHEN id % 9 = 0 THEN '' WHEN id % 4 = 0 THEN 'Ley 1 de 1801' ELSE basis END AS b FROM bs), n AS (SELECT id, unnest({bodies_sql('b')}) AS norma FROM b2), g AS (SELECT id, count(*) AS n, count(h.norma) AS h FROM n LEFT JOIN h USING (norma) GROUP BY id) SELECT b2.id, CASE WHEN coalesce(n, 0) = 0 THEN 'sin_citas' WHEN h = 0 THEN 'fuera_del_corpus' ELSE 'evaluable' END AS grupo FROM b2 LEFT JOIN g USING (id)",
    "relevant_texts": f"WITH {_BB}, t AS (SELECT doc_id, unnest(list_append({bodies_sql('texto')}, norma_id)) AS norma FROM leer WHERE texto IS NOT NULL) SELECT DISTINCT id, doc_id FROM bb JOIN t USING (norma)",
    "merged_targets": "WITH RECURSIVE e AS (SELECT DISTINCT doc_id, lower(regexp_replace(url, '#.*$', '')) AS k FROM fuentes WHERE doc_id IS NOT NULL AND url IS NOT NULL), pr AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (k)), rc AS (SELECT doc_id AS x, doc_id AS y FROM fuentes WHERE doc_id IS NOT NULL UNION SELECT rc.x, pr.y FROM rc JOIN pr ON pr.x = rc.y), cp AS (SELECT x AS doc_id, min(y) AS component FROM rc GROUP BY x), r AS (SELECT component, items_del_banco, areas FROM fuentes JOIN cp USING (doc_id)), a AS (SELECT component, array_to_string(list_sort(list(DISTINCT x)), ',') AS areas FROM (SELECT component, unnest(areas) AS x FROM r) WHERE x IS NOT NULL GROUP BY component) SELECT component AS doc_id, sum(items_del_banco) AS items, count(*) AS entradas, coalesce(any_value(a.areas), '') AS areas FROM r LEFT JOIN a USING (component) GROUP BY component",
    "manifest_counts": "WITH h AS (SELECT DISTINCT doc_id FROM leer), s AS (SELECT doc_id, count(DISTINCT tramo_id) AS tramos FROM partir GROUP BY doc_id), a AS (SELECT doc_id, count(DISTINCT art_id) AS articulos, arg_min(titulo, (orden, art_id)) FILTER (trim(titulo) <> '') AS t FROM normas GROUP BY doc_id), r AS (SELECT doc_id, min(titulo) AS t FROM fuentes WHERE titulo IS NOT NULL GROUP BY doc_id) SELECT h.doc_id, coalesce(tramos, 0) AS tramos, coalesce(articulos, 0) AS articulos, coalesce(a.t, r.t, h.doc_id) AS titulo FROM h LEFT JOIN s USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id)",
    "pair_hits": f"WITH {_LEX}, {_lex('lx', 'pregunta', 10)}, {_BB}, pr AS (SELECT id AS qid, norma FROM bb WHERE norma IN (SELECT norma_id FROM documents WHERE norma_id IS NOT NULL)), ht AS (SELECT qid, norma_id AS norma, min(rank) AS posicion, count(*) AS veces FROM lx JOIN documents ON doc_id = row_id WHERE norma_id IS NOT NULL GROUP BY ALL) SELECT qid, norma, posicion, coalesce(veces, 0) AS veces FROM pr LEFT JOIN ht USING (qid, norma)",
    "area_coverage": f"WITH {_BB}, h AS (SELECT DISTINCT norma_id AS norma, 1 AS h FROM fuentes WHERE norma_id IS NOT NULL), g AS (SELECT id, area, count(h)::DOUBLE / count(norma) AS c FROM bb LEFT JOIN h USING (norma) GROUP BY id, area) SELECT area, count(*) AS items, round(avg(c), 4) AS cobertura FROM g GROUP BY area",
    "canonical_ids": f"WITH f AS {_FIRST}, n AS (SELECT doc_id, canonico, {bodies_sql('titulo')} AS b FROM f) SELECT doc_id, coalesce(array_to_string(canonico, '_'), list_sort(list_filter(b, lambda x: NOT regexp_matches(x, '[0-9]')))[1], list_sort(b)[1], doc_id) AS canon FROM n",
    "completed_metadata": rf"WITH f AS {_FIRST}, t AS (SELECT *, coalesce(titulo, replace(doc_id, '_', ' ')) AS tt FROM f), x AS (SELECT *, nullif(regexp_extract(tt, '(?i)^(ley|decreto|resoluci[oó]n|acuerdo|circular|sentencia|auto)\s+(\w+)\s+(?:de\s+)?(\d{{4}})', ['a', 'b', 'c']).a, '') AS xa, nullif(regexp_extract(tt, '(?i)^(ley|decreto|resoluci[oó]n|acuerdo|circular|sentencia|auto)\s+(\w+)\s+(?:de\s+)?(\d{{4}})', 2), '') AS xb, nullif(regexp_extract(tt, '(?i)^(ley|decreto|resoluci[oó]n|acuerdo|circular|sentencia|auto)\s+(\w+)\s+(?:de\s+)?(\d{{4}})', 3), '') AS xc, nullif(regexp_replace(lower(regexp_extract(url, '^(?:[hH][tT][tT][pP][sS]?://)?([^/?#:\s]+)', 1)), '^www\.', ''), '') AS xh FROM t) SELECT doc_id, tt AS titulo, coalesce(tipo_norma, lower(xa)) AS tipo_norma, coalesce(numero, xb) AS numero, coalesce(anio, xc::INT) AS anio, coalesce(fuente, xh) AS fuente, array_to_string(list_filter([CASE WHEN titulo IS NULL THEN 'titulo' END, CASE WHEN tipo_norma IS NULL AND xa IS NOT NULL THEN 'tipo_norma' END, CASE WHEN numero IS NULL AND xb IS NOT NULL THEN 'numero' END, CASE WHEN anio IS NULL AND xc IS NOT NULL THEN 'anio' END, CASE WHEN fuente IS NULL AND xh IS NOT NULL THEN 'fuente' END], lambda z: z IS NOT NULL), ',') AS deducidos FROM x",
    "enumerated_articles": rf"WITH t AS (SELECT id, 'Según los artículos ' || (id % 40) || ', ' || (id % 7) || ' y 9A de la Ley ' || (id % 500) || ' de 1990; arts. 3 y 4 del Decreto 7 de 2001.' AS t FROM preguntas), m AS (SELECT id, unnest({_ENUM.format(c='t')}) AS m FROM t), n AS (SELECT id, regexp_extract(m, '(ley|decreto)\s+(\d+)\s+de\s+(\d{{4}})$', 1) || '_' || coalesce(nullif(ltrim(regexp_extract(m, '(\d+)\s+de\s+\d{{4}}$', 1), '0'), ''), '0') || '_' || regexp_extract(m, '(\d{{4}})$', 1) AS b, unnest(regexp_extract_all(regexp_extract(m, '^art[a-z.]+\s+(.*?)\s+(?:de\s+(?:la|el)|del)\s', 1), '\d+[a-z]?')) AS a FROM m) SELECT DISTINCT id, b || '#art_' || upper(a) AS articulo FROM n",
    "bare_laws": r"WITH t AS (SELECT id, 'Conforme a la Ley ' || ['599', '1564', '77', '1098'][id % 4 + 1] || ' y a la ley 906.' AS t FROM preguntas), m AS (SELECT id, unnest(regexp_extract_all(lower(t), '\bley\s+(\d+)', 1)) AS n FROM t) SELECT DISTINCT id, CASE n WHEN '599' THEN 'codigo_penal' WHEN '906' THEN 'codigo_procedimiento_penal' WHEN '1564' THEN 'codigo_general_proceso' WHEN '1098' THEN 'codigo_infancia' END AS norma FROM m WHERE n IN ('599', '906', '1564', '1098')",
    "passages_out": f"WITH {_LEX}, {_lex('lx', 'pregunta', 10)} SELECT qid, rank, row_id, floor(score * 100000 + 0.5) / 100000 AS score, count(*) OVER (PARTITION BY qid) - rank AS por_lugar, 'row_id' || CASE WHEN norma_id IS NOT NULL THEN ',norma_id' ELSE '' END || CASE WHEN area IS NOT NULL THEN ',area' ELSE '' END AS campos FROM lx JOIN documents ON doc_id = row_id",
    "option_passages": "WITH p AS (SELECT id, list_sort(map_keys(opciones)) AS l FROM preguntas WHERE opciones IS NOT NULL), q AS (SELECT id, l, list_concat(l, [NULL::VARCHAR, NULL::VARCHAR]) AS m FROM p), x AS (SELECT id, l, generate_subscripts(m, 1) - 1 AS k, unnest(m) AS o FROM q), y AS (SELECT id, l, k, CASE WHEN id % 3 = 0 THEN NULL ELSE o END AS o, CASE WHEN k = len(l) AND id % 2 = 0 THEN 'directo' ELSE 'hibrido' END AS via FROM x), z AS (SELECT *, bool_or(o IS NOT NULL OR via = 'directo') OVER (PARTITION BY id) AS any_ FROM y) SELECT id, k::INT AS k, CASE WHEN o IS NOT NULL THEN l[list_position(l, o) % len(l) + 1] END AS opcion, via FROM z WHERE o IS NOT NULL OR via = 'directo' OR NOT any_",
    "right_options": "SELECT id, opciones[respuesta_correcta] AS correcta, true AS abstencion, '' AS justificacion FROM preguntas WHERE opciones IS NOT NULL",
    "runs_by_text": "WITH p AS (SELECT id, md5(pregunta) AS h FROM preguntas WHERE pregunta IS NOT NULL), a AS (SELECT h, min(id) AS id_a FROM p GROUP BY h), b AS (SELECT h, min(id + 10000) AS id_b FROM p WHERE id % 5 <> 0 GROUP BY h) SELECT id_a, id_b FROM a LEFT JOIN b USING (h)",
    "chosen_files": "WITH t AS (SELECT DISTINCT doc_id, archivo FROM texto WHERE archivo IS NOT NULL AND doc_id IS NOT NULL AND archivo NOT LIKE '%.notas.md') SELECT doc_id, archivo FROM t WHERE doc_id IN (SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) % 2 = 0)",
    "source_names": r"WITH u AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '^(?:[hH][tT][tT][pP][sS]?://)?([^/?#:\s]+)', 1)), '^www\.', '') AS host FROM fuentes WHERE url IS NOT NULL) SELECT CASE WHEN regexp_matches(host, '(^|\.)garantias\.example$') THEN 'Tribunal' WHEN regexp_matches(host, '(^|\.)normas\.example$') THEN 'Compilación' ELSE host END AS nombre, count(*) AS n FROM u GROUP BY 1",
}
