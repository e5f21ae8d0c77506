"""Operators on small inputs: ties, nulls, repeats, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import text as T
from tamiz.operators import answers, batches, components, dense, fusion, identity, lexical, measures, paragraphs, segments, selection
from tamiz.operators.components import connected_components


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [
    [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)], [(1, k) for k in range(2, 30)], [(1, 2), (2, 3), (3, 1)], [(5, 5), (7, 8)], [(1, 2), (1, 2), (2, 1)],
    [(random.Random(1).randrange(60), random.Random(k).randrange(60)) for k in range(50)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute_components(edges)


@pytest.mark.parametrize("at_once", [1, 7, 500_000])
def test_components_joined_in_one_task_and_in_rounds(spark, monkeypatch, at_once):
    """Rounds of many edges and the one task of few give the same, for numbers and names, wherever edges lie and tasks begin anew."""
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(900, 900), (460, 460)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(5)
    assert sorted(connected_components(df).collect()) == sorted(brute_components(edges).items())
    names = [(f"ñ{a}" if a % 2 else f"\U00010000{a}", f"ñ{b}" if b % 2 else f"\uffee{b}") for a, b in edges]
    df = spark.createDataFrame(names, "src string, dst string").repartition(5)
    assert sorted(connected_components(df).collect()) == sorted(brute_components(names).items())


def test_components_of_few_edges_take_few_jobs(spark):
    """Jobs and their plans stay in the driver's memory: a chain is joined in one task, not in rounds of ten jobs."""
    df = spark.createDataFrame([(k, k + 1) for k in range(500)], "src bigint, dst bigint")
    spark.sparkContext.setJobGroup("few-edges", "components")
    try:
        assert {r.component for r in connected_components(df).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 8


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "src bigint, dst bigint")
    assert connected_components(df).count() == 0
    assert connected_components(df.where("false")).count() == 0


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.normal(c), t="  ÁRBOL \n y  ñu ") == "arbol y nu"
    assert one(spark, T.slug(c), t="Ley 5ª de 1990!") == "ley_5_de_1990"
    assert one(spark, T.slug(c), t="¡!") == "doc"
    assert one(spark, T.strip_struck(c), t="uno ~~dos~~ , tres ~~cuatro") == "uno, tres"
    assert one(spark, T.word_count(c), t=None) == 0
    assert one(spark, T.legal_tokens(c), t="La C-355 y el artículo 1o.") == ["c355", "355", "articulo", "1"]
    assert one(spark, T.truncate_sentences(c, 2, 5), t="Uno dos. Tres cuatro. Cinco.") == "Uno dos. Tres cuatro."
    assert one(spark, T.truncate_sentences(c, 2, 2), t="Uno dos, tres cuatro.") == "Uno dos."
    assert one(spark, T.clean_lines(c), t="# **Título**\n\n\n\n|--|--|\n. texto <nota al pie>\n") == "Título\n\ntexto {{nota al pie}}"
    assert one(spark, T.json_object(c), t='ruido {"a": {"b": 1}} fin') == '{"a": {"b": 1}}'
    assert one(spark, T.strip_control(c), t="a​b\x07c d\ne") == "abc d\ne"


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "id int, w array<string>")
    got = {r.id: r.g for r in df.select("id", T.ngrams(F.col("w"), 2).alias("g")).collect()}
    assert got == {1: ["a b", "b c"], 2: [], 3: []}


@pytest.mark.parametrize("text, bodies, arts", [
    ("artículo 12 de la Ley 100 de 1993 y Decreto 07 de 2001", ["ley_100_1993", "decreto_7_2001"], ["ley_100_1993#art_12"]),
    ("Ley 599 de 1999", ["codigo_penal"], []), ("sentencia C-355 de 2006 y T-012/98", ["sentencia_C-355_2006", "sentencia_T-12_1998"], []), ("el Código Civil", ["codigo_civil"], []),
    ("Ley 6562 de 2016, art. 175", ["ley_6562_2016"], ["ley_6562_2016#art_175"]), ("nada que citar", [], []), (None, [], []),
])
def test_citations(spark, text, bodies, arts):
    assert sorted(one(spark, C.bodies(F.col("t")), t=text)) == sorted(bodies)
    assert one(spark, C.articles(F.col("t")), t=text) == arts


def test_fusion_keeps_order_of_sight_on_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "qid bigint, row_id bigint, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "qid bigint, row_id bigint, rank int")
    assert [r.row_id for r in fusion.rrf([a, b]).orderBy("rank").collect()] == [10, 20]


def test_collapse_and_cap(spark):
    r = spark.createDataFrame([(1, k, 1.0 / k, k) for k in range(1, 7)], "qid bigint, row_id bigint, score double, rank int")
    h = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "d")], "row_id bigint, hash string")
    assert [x.row_id for x in fusion.collapse(r, h, 3).orderBy("rank").collect()] == [1, 3, 4]
    g = r.join(h, "row_id")
    assert [x.row_id for x in fusion.cap(g, "hash", 1, 10).orderBy("rank").collect()] == [1, 3, 4, 6]


def test_budget_always_keeps_the_first(spark):
    p = spark.createDataFrame([(1, k, 100) for k in range(1, 11)], "qid bigint, rank int, c int")
    assert fusion.context_budget(p, F.col("c"), 250).count() == 2
    assert fusion.context_budget(p, F.col("c"), 50).count() == 1
    assert fusion.context_budget(p, F.col("c"), 5000).count() == 8


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(200)] + [(900, None)], "row_id bigint, v array<float>")
    q = df.where("row_id % 50 = 0").withColumnRenamed("row_id", "qid")
    got = {(r.qid, r.rank): r.row_id for r in dense.dense_topk(df, q, 5).collect()}
    for i in range(0, 200, 50):
        s = np.round(v[i].astype(np.float64) @ v.astype(np.float64).T, 6)
        assert [got[i, k + 1] for k in range(5)] == list(np.lexsort((np.arange(200), -s))[:5])
    assert dense.dense_topk(df, q.where("false"), 5).count() == 0
    assert dense.dense_topk(df.where("false"), q, 5).count() == 0


def test_bm25_without_matches(spark):
    rows = spark.createDataFrame([(1, "uno dos"), (2, None), (3, "")], "row_id bigint, text string")
    q = spark.createDataFrame([(7, "dos"), (8, "nada"), (9, None)], "qid bigint, q string")
    got = lexical.bm25(rows, q, T.tokens(F.col("text")), T.tokens(F.col("q"))).collect()
    assert [(r.qid, r.row_id, r["rank"]) for r in got] == [(7, 1, 1)]


def test_distinct_texts_are_encoded_once(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, None, None)], "row_id bigint, h string, t string")
    got = {r.row_id: r.v for r in dense.encode_distinct(rows, "h", "t", dense.hashing_encoder).collect()}
    assert got[1] == got[2] and got[1] != got[3] and got[4] is None


def test_choice_keeps_directs_and_caps_norms(spark):
    rows = [(1, 1, "directo", None, -5.0, "ley_1", "d1")] + [(1, k, "hibrido", None, 10.0 - k, "ley_2", "d2") for k in range(2, 7)] + [(1, k, "opcion", "A", 0.5, f"ley_{k}", f"d{k}") for k in (8, 9)]
    got = [r.row_id for r in selection.choose(spark.createDataFrame(rows, selection.CANDIDATE), final=5).orderBy("rank").collect()]
    assert 1 in got and 8 in got and len(got) == 5
    assert sorted(got)[:1] == [1]


def test_segments():
    text = "Preámbulo.\n\nCAPÍTULO I\n\nOBJETO\n\nARTÍCULO 1o. DEFINICIONES. Uno.\n\nDos.\n\nARTÍCULO 2A. Tres.\n\nARTÍCULO 90. cita.\n\nArtículo 3 bis. Cuatro."
    rows = list(segments.articles_of(text))
    assert [(r[1], r[4], len(r[6])) for r in rows] == [("1", "DEFINICIONES", 2), ("2A", "", 2), ("3bis", "", 1), (None, "", 1)]
    assert rows[0][5] == "CAPÍTULO I OBJETO"
    for r in rows:
        for t, a, b in r[6]:
            assert text[a:b] == t
    assert list(segments.articles_of("")) == []


def test_lines_blocks_and_packing(spark):
    t = spark.createDataFrame([(1, "Una línea\nque sigue.\nOtra\n\nfin"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.k, r.text) for r in paragraphs.join_lines(t).orderBy("id", "k").collect()] == [(1, 0, "Una línea que sigue."), (1, 1, "Otra"), (1, 2, "fin")]
    assert [(r.inicio, r.fin) for r in paragraphs.blocks(t).orderBy("inicio").collect()] == [(0, 25), (27, 30)]
    p = spark.createDataFrame([(1, k, w) for k, w in enumerate([50, 60, 30, 200, 10])], "id int, k int, words bigint")
    assert [(r.first, r.last, r.words) for r in paragraphs.pack(p, 120).orderBy("chunk").collect()] == [(0, 1, 110), (2, 2, 30), (3, 3, 200), (4, 4, 10)]


def test_survivors_and_ids(spark):
    schema = "doc_id string, estado string, canonico array<string>, origen string, n_articulos_detectados int, n_caracteres int"
    r = spark.createDataFrame([("b", "ok", ["x"], None, 3, 10), ("a", None, ["x"], None, 9, 99), ("c", "ok", None, None, 9, 99)], schema)
    g = r.select("doc_id", F.lit("g").alias("component"))
    assert {x.doc_id: x.place for x in identity.survivors(r, g).collect()} == {"b": 1, "c": 2, "a": 3}
    u = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "b string, n int")
    assert sorted(x.id for x in identity.unique_ids(u, "b", "n").collect()) == ["x", "x-2", "y"]


def test_same_keys(spark):
    r = spark.createDataFrame([("a", ["1", "2"]), ("b", ["2"]), ("c", ["3", None]), ("d", None), ("e", ["1"])], "doc_id string, keys array<string>")
    assert {x.doc_id: x.component for x in identity.same_keys(r).collect()} == {"a": "a", "b": "a", "e": "a", "c": "c", "d": "d"}


def test_batches(spark):
    items = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(31)], "id bigint, f string")
    parts = [r["count"] for r in batches.split_round_robin(items, "f", "id", 3).groupBy("part").count().collect()]
    assert sorted(parts) == [10, 10, 11]
    a = spark.createDataFrame([(1, "x"), (99, "y")], "id bigint, v string")
    b = spark.createDataFrame([(1, "z"), (2, "w")], "id bigint, v string")
    kept, foreign = batches.merge_parts([a, b], items)
    assert {r.id: r.v for r in kept.collect()} == {1: "x", 2: "w"} and [r.id for r in foreign.collect()] == [99]
    assert batches.pending(items, a).count() == 30


def test_schema_errors(spark):
    df = spark.createDataFrame([(1, None, True), (2, "ab", False)], "id bigint, t string, flag boolean")
    e = batches.schema_errors(df, {"required": ["t"], "properties": {"t": {"type": "string", "minLength": 3}, "flag": {"type": "integer"}}})
    assert [sorted(r.e) for r in df.orderBy("id").select(e.alias("e")).collect()] == [["flag: type", "t: required"], ["flag: type", "t: minLength"]]


def test_measures(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "id int, v array<double>")
    assert abs(sum(df.select(measures.softmax(F.col("v")).alias("s")).first().s) - 1) < 1e-12
    votes = spark.createDataFrame([(1, 0, "A", 0.5), (1, 1, "A", 0.3), (1, 0, "B", 0.4), (1, 1, "B", 0.4)], "qid int, shift int, letter string, p double")
    assert measures.best_letter(measures.ensemble(votes)).first().letter == "A"


def test_answers(spark):
    o = one(spark, answers.parse_options(F.col("t")), t="¿Cuál?\nA) uno\nB) dos\nC) tres")
    assert o == {"A": "uno", "B": "dos", "C": "tres"}
    assert one(spark, answers.parse_options(F.col("t")), t="A) uno B) dos") is None
    assert one(spark, answers.letter_of(F.col("t")), t="La respuesta es b) porque") == "B"
    assert one(spark, answers.option_kind(F.col("t"))["kind"], t="Todas las anteriores") == "all"
    assert one(spark, answers.drop_citing_sentences(F.col("t"), F.array(F.lit("ley_1_2000"))), t="Rige la Ley 1 de 2000. Otra cosa.") == "Otra cosa."
    assert one(spark, answers.distinct_ignoring_case(F.split("t", ","), 3), t="Uno,uno,DOS,tres,cuatro") == ["Uno", "DOS", "tres"]
    q = spark.createDataFrame([(1, "según la Ley 1 de 2000"), (2, None)], "qid int, q string")
    n = spark.createDataFrame([("ley_1_2000", "Estatuto Menor"), ("ley_1_2000", "EM")], "canon string, name string")
    assert {r.qid: r.added for r in answers.expand_aliases(q, n).collect()} == {1: 1, 2: 0}


def test_failing_generators_give_rows(spark):
    def bad(prompts):
        raise RuntimeError

    p = spark.createDataFrame([(1, "x")], "id bigint, prompt string")
    r = answers.generated(p, bad, lambda t: True).first()
    assert (r.id, r.output, r.ok) == (1, None, False)
    r = answers.generated(p, lambda s: s + "!", lambda t: t.endswith("!")).first()
    assert (r.output, r.ok) == ("x!", True)
