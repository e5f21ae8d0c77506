"""Queries that score answers, with their SQL. The tables hold no answers: they are made from the items by the same rule on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.operators import scoring as S
from tamiz.plans.citing import bodies_sql
from tamiz.session import table

# Answers: of nine items in ten; every seventh abstains; every third closed one says A; every fourth free one cites another norm.
_ANSWER = [
    "id", "id % 7 = 0 AS abstencion", "CASE WHEN id % 3 = 0 THEN 'A' ELSE respuesta_correcta END AS letra",
    "concat_ws(' ', respuesta_esperada, CASE WHEN id % 4 = 0 THEN 'Decreto 5 de 1999' ELSE legal_basis END) AS texto",
    "concat_ws(' ', CASE WHEN id % 3 <> 1 THEN legal_basis ELSE 'Ley 1 de 1990' END, CASE WHEN id % 8 = 0 THEN 'Decreto 5 de 1999' END) AS pasajes",
]


def _answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preguntas").where("id % 10 <> 0").selectExpr(*_ANSWER)


def _rows(s: SparkSession, d: str) -> DataFrame:
    key = table(s, d, "preguntas").select("id", "formato", F.col("respuesta_correcta").alias("correcta"), C.bodies(F.col("legal_basis")).alias("ref"))
    said = _answers(s, d).select("id", "abstencion", "letra", C.bodies(F.col("texto")).alias("dadas"), C.bodies(F.col("pasajes")).alias("evidencia"))
    return S.with_answers(key, said)


def closed_score(s: SparkSession, d: str) -> DataFrame:
    return S.closed(_rows(s, d).where("formato = 'multiple_choice'"))


def citation_score(s: SparkSession, d: str) -> DataFrame:
    return S.citations(_rows(s, d))


def abstention_score(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d).where((F.col("formato") == "multiple_choice") | (F.size("ref") > 0))
    return S.abstention(rows, F.when(F.col("formato") == "multiple_choice", F.col("letra") == F.col("correcta")).otherwise(F.arrays_overlap("ref", "dadas")))


def total_score(s: SparkSession, d: str) -> DataFrame:
    return S.total([("cerradas", closed_score(s, d)), ("citas", citation_score(s, d)), ("abstencion", abstention_score(s, d)), ("correccion", None)])


def error_matrix(s: SparkSession, d: str) -> DataFrame:
    """One row for each item: what was asked, said, right, cited, in the corpus and supported."""
    have = table(s, d, "fuentes").where("estado = 'ok' and norma_id is not null").select(F.col("norma_id").alias("norma")).distinct()
    rows = _rows(s, d)
    held = rows.select("id", F.explode("ref").alias("norma")).join(have, "norma", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("en_corpus"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    said = F.col("enviada") & ~F.col("abstencion")
    right = F.when(F.col("formato") == "multiple_choice", F.coalesce(F.col("letra") == F.col("correcta"), F.lit(False)))
    return rows.join(held, "id", "left").select(
        "id", "formato", "enviada", "abstencion", F.when(said, right).alias("acierto"), n(F.col("ref")).alias("n_ref"), F.when(said, n(F.col("dadas"))).alias("n_citadas"), F.when(said, n(F.array_intersect("dadas", "ref"))).alias("n_aciertos"),
        F.when(said, n(F.array_except("dadas", "evidencia"))).alias("n_sin_respaldo"), F.coalesce("en_corpus", F.lit(0)).alias("en_corpus"),
    )


def policy_accuracy(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "preguntas").where("formato = 'multiple_choice'").selectExpr("respuesta_correcta AS correcta", "CASE WHEN id % 3 = 0 THEN 'A' ELSE respuesta_correcta END AS final", "CASE WHEN id % 5 = 0 THEN 'B' ELSE respuesta_correcta END AS razonada", "CASE WHEN id % 2 = 0 THEN respuesta_correcta END AS resolver")
    return S.policy_accuracy(rows, ["final", "razonada", "resolver"])


def letter_measures(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas").where("opciones is not null and respuesta_correcta is not null").select("id", F.col("respuesta_correcta").alias("correcta"), F.explode("opciones").alias("letra", "o"))
    p = p.select("id", "correcta", "letra", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("perm"))
    return S.letter_measures(p.withColumn("p", F.expr("((id * 7 + ascii(letra) * 13 + perm * 5) % 97) / 97.0D")))


def judge_noise(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "preguntas")
    a = p.selectExpr("id", "respuesta_esperada AS texto", "CAST(id % 11 AS double) / 10 AS nota")
    b = p.where("id % 9 <> 0").selectExpr("id", "CASE WHEN id % 4 = 0 THEN pregunta ELSE respuesta_esperada END AS texto", "CAST(id % 13 AS double) / 10 AS nota")
    return S.judge_noise(a, b)


def throughput(s: SparkSession, d: str) -> DataFrame:
    return S.throughput(table(s, d, "preguntas").selectExpr("CAST(id % 40 AS double) / 2 AS segundos", "legal_basis IS NOT NULL AS valida", "id % 7 = 0 AS abstencion"), 992)


def applied_verification(s: SparkSession, d: str) -> DataFrame:
    """Items with what was generated and retrieved; passages of the retrieval where there are any, else those delivered with the answer."""
    items = table(s, d, "preguntas").select("id", "formato")
    made = _answers(s, d).select("id", "abstencion", F.when(~F.col("abstencion"), F.col("texto")).alias("salida"), F.col("pasajes").alias("p_entrega"))
    found = table(s, d, "preguntas").where("id % 6 <> 0").select("id", F.col("legal_basis").alias("p_busqueda"))
    j = items.join(made, "id", "left").join(found, "id", "left")
    return j.select("id", "formato", "salida", F.coalesce("p_busqueda", "p_entrega").alias("pasajes"), F.when(F.col("p_busqueda").isNotNull(), "busqueda").when(F.col("p_entrega").isNotNull(), "entrega").alias("origen"))


def verification_summary(s: SparkSession, d: str) -> DataFrame:
    """By reason of abstention: items, cited norms, those without support, items that have any."""
    rows = _rows(s, d).where("enviada").withColumn("motivo", F.when(F.col("abstencion"), "abstencion").when(F.size("dadas") == 0, "sin_citas").otherwise("respondida"))
    loose = F.size(F.array_except("dadas", "evidencia"))
    return rows.groupBy("motivo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("dadas")).alias("citas"), F.sum(loose).alias("sin_respaldo"), F.count_if(loose > 0).alias("items_sin_respaldo"))


def kept_revisions(s: SparkSession, d: str) -> DataFrame:
    """Revision of a draft, or the draft where the revision is empty or has less than half of its words."""
    p = table(s, d, "preguntas").where("respuesta_esperada is not null").select("id", F.col("respuesta_esperada").alias("borrador"), F.expr("CASE WHEN id % 3 = 0 THEN substring(respuesta_esperada, 1, 60) WHEN id % 3 = 1 THEN '' ELSE concat(respuesta_esperada, ' Conforme.') END").alias("revision"))
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    keep = (F.trim("revision") != "") & (n(F.col("revision")) >= 0.5 * n(F.col("borrador")))
    return p.select("id", keep.alias("revisada"), F.md5(F.when(keep, F.col("revision")).otherwise(F.col("borrador"))).alias("hash"))


def answer_texts(s: SparkSession, d: str) -> DataFrame:
    """Text that citations are read from, and text that is judged, by the format of the item."""
    p = table(s, d, "preguntas")
    closed = F.col("formato") == "multiple_choice"
    cited = F.when(closed, F.coalesce("respuesta_correcta", F.lit(""))).when(F.col("formato") == "semi_open", F.concat_ws(" ", F.coalesce("respuesta_esperada", F.lit("")), F.coalesce("legal_basis", F.lit("")))).otherwise(F.concat_ws(" ", F.coalesce("legal_basis", F.lit("")), F.coalesce("respuesta_esperada", F.lit("")), F.coalesce("tema", F.lit(""))))
    judged = F.when(F.col("formato") == "semi_open", F.coalesce("respuesta_esperada", F.lit(""))).otherwise(F.concat_ws(" ", F.coalesce("legal_basis", F.lit("")), F.coalesce("respuesta_esperada", F.lit("")), F.coalesce("tema", F.lit(""))))
    return p.select("id", F.md5(cited).alias("citado"), F.md5(judged).alias("juzgado"))


def completed_choices(s: SparkSession, d: str) -> DataFrame:
    """Closed answers made whole: the letter given, else that of the best evidence, else the first option; a reason for every other option."""
    p = table(s, d, "preguntas").where("opciones is not null").select("id", "opciones", F.expr("CASE WHEN id % 2 = 0 THEN respuesta_correcta END").alias("letra"))
    evidence = p.where("id % 3 = 0").select("id", F.explode("opciones").alias("opcion", "t")).withColumn("puntaje", F.expr("CASE WHEN ascii(opcion) % 5 = 0 THEN NULL ELSE (id * ascii(opcion)) % 17 END"))
    best = evidence.groupBy("id").agg(F.min_by("opcion", F.struct(-F.coalesce("puntaje", F.lit(0)), "opcion")).alias("mejor"))
    first = F.sort_array(F.map_keys("opciones"))[0]
    j = p.join(best, "id", "left").withColumn("final", F.coalesce("letra", "mejor", first))
    rest = F.filter(F.sort_array(F.map_keys("opciones")), lambda x: x != F.col("final"))
    return j.select("id", "final", F.array_join(rest, ",").alias("descartadas"), (F.col("letra").isNull() & F.col("mejor").isNotNull()).alias("por_evidencia"))


_P = "WITH an AS (SELECT " + ", ".join(_ANSWER) + " FROM preguntas WHERE id % 10 <> 0)"
_R = f"""{_P}, sd AS (SELECT id, abstencion, letra, {bodies_sql('texto')} AS dadas, {bodies_sql('pasajes')} AS evidencia, true AS enviada FROM an),
rw AS (SELECT p.id, formato, respuesta_correcta AS correcta, {bodies_sql('legal_basis')} AS ref, coalesce(abstencion, false) AS abstencion, letra, coalesce(dadas, []) AS dadas, coalesce(evidencia, []) AS evidencia, coalesce(enviada, false) AS enviada FROM preguntas p LEFT JOIN sd USING (id))"""
_CLOSED = "SELECT count(*) AS n, count(*) FILTER (enviada AND NOT abstencion AND letra = correcta) AS aciertos FROM rw WHERE formato = 'multiple_choice'"
_EXC = "len(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
_HIT, _OTHER = "list_intersect(dadas, ref)", "list_filter(dadas, lambda z: NOT list_contains(ref, z))"
_CIT = f"""SELECT count(*) AS items, sum(len(ref)) AS n_ref, sum(s * len(dadas)) AS n_citadas, sum(s * len({_HIT})) AS aciertos, sum(s * len(list_intersect({_HIT}, evidencia))) AS aciertos_respaldados, sum(s * {_EXC.format(a=_HIT, b='evidencia')}) AS aciertos_sin_respaldo,
sum(s * len(list_intersect({_OTHER}, evidencia))) AS incorrectas, sum(s * {_EXC.format(a=_OTHER, b='evidencia')}) AS citas_sin_respaldo FROM (SELECT *, (enviada AND NOT abstencion)::INT AS s FROM rw WHERE len(ref) > 0)"""
_CIT2 = "SELECT *, (aciertos_respaldados + 0.5 * aciertos_sin_respaldo)::DOUBLE / n_ref AS r, citas_sin_respaldo::DOUBLE / n_citadas AS l"
_ABS = "SELECT count(*) FILTER (enviada AND abstencion AND NOT ok) AS abstuvo_bien, count(*) FILTER (enviada AND abstencion AND ok) AS abstuvo_de_mas, count(*) FILTER (enviada AND NOT abstencion AND ok) AS respondio_bien, count(*) FILTER (NOT enviada OR (NOT abstencion AND NOT ok)) AS respondio_mal FROM (SELECT *, coalesce(CASE WHEN formato = 'multiple_choice' THEN letra = correcta ELSE len(list_intersect(ref, dadas)) > 0 END, false) AS ok FROM rw WHERE formato = 'multiple_choice' OR len(ref) > 0)"
_ABS2 = "SELECT *, (respondio_bien + 0.5 * (abstuvo_bien + abstuvo_de_mas))::DOUBLE / (abstuvo_bien + abstuvo_de_mas + respondio_bien + respondio_mal) AS c"
_W = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
QUERIES = {
    "closed_score": closed_score, "citation_score": citation_score, "abstention_score": abstention_score, "total_score": total_score, "error_matrix": error_matrix, "policy_accuracy": policy_accuracy, "letter_measures": letter_measures, "judge_noise": judge_noise,
    "throughput": throughput, "applied_verification": applied_verification, "verification_summary": verification_summary, "kept_revisions": kept_revisions, "answer_texts": answer_texts, "completed_choices": completed_choices,
}
SQL = {
    "closed_score": f"{_R}, c AS ({_CLOSED}) SELECT n, aciertos, round(aciertos / n::DOUBLE, 4) AS exactitud, round(20 * aciertos / n::DOUBLE, 2) AS puntos FROM c",
    "citation_score": f"{_R}, c AS ({_CIT}), e AS ({_CIT2} FROM c) SELECT items, n_ref, n_citadas, aciertos, aciertos_respaldados, aciertos_sin_respaldo, incorrectas, citas_sin_respaldo, round(r, 4) AS recall, round(l, 4) AS tasa_sin_respaldo, round(greatest(0, r - 2 * l), 4) AS indice, round(20 * greatest(0, r - 2 * l), 2) AS puntos FROM e",
    "abstention_score": f"{_R}, a AS ({_ABS}), e AS ({_ABS2} FROM a) SELECT abstuvo_bien, abstuvo_de_mas, respondio_bien, respondio_mal, round(c, 4) AS calibracion, round(10 * c, 2) AS puntos FROM e",
    "total_score": f"{_R}, c1 AS ({_CLOSED}), c2 AS ({_CIT}), c3 AS ({_CIT2} FROM c2), c4 AS ({_ABS}), c5 AS ({_ABS2} FROM c4) SELECT round((SELECT round(20 * aciertos / n::DOUBLE, 2) FROM c1) + (SELECT round(20 * greatest(0, r - 2 * l), 2) FROM c3) + (SELECT round(10 * c, 2) FROM c5), 2) AS obtenidos, 50.0::DOUBLE AS posibles",
    "error_matrix": f"{_R}, hv AS (SELECT DISTINCT norma_id FROM fuentes WHERE estado = 'ok' AND norma_id IS NOT NULL), hl AS (SELECT id, count(*) AS k FROM (SELECT id, unnest(ref) AS norma_id FROM rw) SEMI JOIN hv USING (norma_id) GROUP BY id), x AS (SELECT rw.*, enviada AND NOT abstencion AS s, coalesce(k, 0) AS k FROM rw LEFT JOIN hl USING (id)) SELECT id, formato, enviada, abstencion, CASE WHEN s AND formato = 'multiple_choice' THEN coalesce(letra = correcta, false) END AS acierto, len(ref) AS n_ref, CASE WHEN s THEN len(dadas) END AS n_citadas, CASE WHEN s THEN len({_HIT}) END AS n_aciertos, CASE WHEN s THEN {_EXC.format(a='dadas', b='evidencia')} END AS n_sin_respaldo, k AS en_corpus FROM x",
    "policy_accuracy": "WITH p AS (SELECT respuesta_correcta AS c, CASE WHEN id % 3 = 0 THEN 'A' ELSE respuesta_correcta END AS f, CASE WHEN id % 5 = 0 THEN 'B' ELSE respuesta_correcta END AS r, CASE WHEN id % 2 = 0 THEN respuesta_correcta END AS s FROM preguntas WHERE formato = 'multiple_choice'), u AS (SELECT 'final' AS politica, c, f AS l FROM p UNION ALL SELECT 'razonada', c, r FROM p UNION ALL SELECT 'resolver', c, s FROM p) SELECT politica, count(*) AS n, count(*) FILTER (l = c) AS aciertos, round(avg(coalesce(l = c, false)::INT), 4) AS exactitud FROM u GROUP BY politica",
    "letter_measures": "WITH o AS (SELECT id, respuesta_correcta AS c, unnest(map_keys(opciones)) AS l FROM preguntas WHERE opciones IS NOT NULL AND respuesta_correcta IS NOT NULL), p AS (SELECT id, c, l, perm, ((id * 7 + ascii(l) * 13 + perm * 5) % 97) / 97.0::DOUBLE AS p FROM o, range(3) AS r(perm)), m AS (SELECT id, c, l, avg(p) AS p FROM p GROUP BY ALL), b AS (SELECT id, c, arg_min(l, (-p, l)) AS ens, max(p) FILTER (l = c) AS g FROM m GROUP BY id, c), q AS (SELECT id, c, perm, arg_min(l, (-greatest(p, 1e-6), l)) AS ens, max(p) FILTER (l = c) AS g FROM p GROUP BY id, c, perm) SELECT (SELECT count(*) FROM b) AS n, (SELECT round(avg((ens = c)::INT), 4) FROM b) AS exactitud, (SELECT round(avg(g), 4) FROM b) AS p_gold_medio, (SELECT round(avg((ens = c)::INT), 4) FROM q) AS exactitud_por_permutacion, (SELECT round(avg(-ln(greatest(g, 1e-6))), 4) FROM q) AS nll_medio",
    "judge_noise": "WITH j AS (SELECT id, respuesta_esperada AS ta, CASE WHEN id % 4 = 0 THEN pregunta ELSE respuesta_esperada END AS tb, (id % 13)::DOUBLE / 10 - (id % 11)::DOUBLE / 10 AS d FROM preguntas WHERE id % 9 <> 0) SELECT count(*) AS n, round(avg(d), 4) AS diferencia, count(*) FILTER (ta IS NOT DISTINCT FROM tb) AS n_iguales, round(avg(abs(d)) FILTER (ta IS NOT DISTINCT FROM tb), 4) AS ruido, round(avg(d) FILTER (ta IS NOT DISTINCT FROM tb), 4) AS sesgo FROM j",
    "throughput": "SELECT count(*) AS n, round(avg((id % 40)::DOUBLE / 2), 3) AS s_por_item, round(avg((id % 40)::DOUBLE / 2) * 992 / 3600, 3) AS horas, count(legal_basis) AS validas, count(*) FILTER (id % 7 = 0) AS abstenciones FROM preguntas",
    "applied_verification": f"{_P}, b AS (SELECT id, legal_basis AS pb FROM preguntas WHERE id % 6 <> 0) SELECT p.id, formato, CASE WHEN NOT abstencion THEN texto END AS salida, coalesce(pb, pasajes) AS pasajes, CASE WHEN pb IS NOT NULL THEN 'busqueda' WHEN pasajes IS NOT NULL THEN 'entrega' END AS origen FROM preguntas p LEFT JOIN an USING (id) LEFT JOIN b USING (id)",
    "verification_summary": f"{_R} SELECT CASE WHEN abstencion THEN 'abstencion' WHEN len(dadas) = 0 THEN 'sin_citas' ELSE 'respondida' END AS motivo, count(*) AS n, sum(len(dadas)) AS citas, sum({_EXC.format(a='dadas', b='evidencia')}) AS sin_respaldo, count(*) FILTER ({_EXC.format(a='dadas', b='evidencia')} > 0) AS items_sin_respaldo FROM rw WHERE enviada GROUP BY 1",
    "kept_revisions": f"WITH p AS (SELECT id, respuesta_esperada AS b, CASE WHEN id % 3 = 0 THEN substring(respuesta_esperada, 1, 60) WHEN id % 3 = 1 THEN '' ELSE respuesta_esperada || ' Conforme.' END AS r FROM preguntas WHERE respuesta_esperada IS NOT NULL), k AS (SELECT *, trim(r) <> '' AND {_W.format(c='r')} >= 0.5 * {_W.format(c='b')} AS keep FROM p) SELECT id, keep AS revisada, md5(CASE WHEN keep THEN r ELSE b END) AS hash FROM k",
    "answer_texts": "WITH p AS (SELECT id, formato, coalesce(respuesta_correcta, '') AS c, coalesce(respuesta_esperada, '') AS e, coalesce(legal_basis, '') AS l, coalesce(tema, '') AS t FROM preguntas) SELECT id, md5(CASE formato WHEN 'multiple_choice' THEN c WHEN 'semi_open' THEN e || ' ' || l ELSE l || ' ' || e || ' ' || t END) AS citado, md5(CASE formato WHEN 'semi_open' THEN e ELSE l || ' ' || e || ' ' || t END) AS juzgado FROM p",
    "completed_choices": "WITH p AS (SELECT id, opciones, list_sort(map_keys(opciones)) AS ks, CASE WHEN id % 2 = 0 THEN respuesta_correcta END AS letra FROM preguntas WHERE opciones IS NOT NULL), e AS (SELECT id, unnest(ks) AS o FROM p WHERE id % 3 = 0), b AS (SELECT id, arg_min(o, (-coalesce(CASE WHEN ascii(o) % 5 = 0 THEN NULL ELSE (id * ascii(o)) % 17 END, 0), o)) AS mejor FROM e GROUP BY id), f AS (SELECT p.id, ks, letra, mejor, coalesce(letra, mejor, ks[1]) AS final FROM p LEFT JOIN b USING (id)) SELECT id, final, array_to_string(list_filter(ks, lambda x: x <> final), ',') AS descartadas, letra IS NULL AND mejor IS NOT NULL AS por_evidencia FROM f",
}
