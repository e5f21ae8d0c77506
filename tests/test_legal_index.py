"""Legal sentences, pieces, stored indexes, look-ups, scores."""

import math

import pytest
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import legal as L
from tamiz.functions import text as T
from tamiz.operators import fusion, index, lookup, responding, scoring


@pytest.mark.parametrize("text, want", [
    ("El juez citó el art. 33 del código. La sala calló.", ["El juez citó el art. 33 del código.", "La sala calló."]),
    ("Según el C.P.P. El juez decidió; La parte calló! Fin", ["Según el C.P.P. El juez decidió;", "La parte calló!", "Fin"]),
    ("ARTÍCULO 17. COMPETENCIA. El juez decide.", ["ARTÍCULO 17. COMPETENCIA.", "El juez decide."]),
    ("La ley {{Modificada. Ver nota}} rige. El dr. Ruiz firmó.", ["La ley {{Modificada. Ver nota}} rige.", "El dr. Ruiz firmó."]),
    ("Vale ~~uno. Dos~~ tres. Cuatro.", ["Vale ~~uno. Dos~~ tres.", "Cuatro."]), ("Costó 1.500 pesos. (Así fue.) “Fin.” Otro.", ["Costó 1.500 pesos.", "(Así fue.)", "“Fin.”", "Otro."]), ("", []), (None, []), ("   ", []),
])
def test_legal_sentences(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert df.select(L.sentences(F.col("t"))).first()[0] == want
    rows = L.sentence_spans(df, "id", "t").orderBy("k").collect()
    assert [r.texto for r in rows] == want and all(text[r.inicio : r.fin] == r.texto for r in rows)


def test_very_long_text(spark):
    t = "El juez decidirá el art. 5 del código. " * 5000
    df = spark.createDataFrame([(1, t)], "id int, t string")
    r = L.sentence_spans(df, "id", "t").agg(F.count(F.lit(1)), F.max("fin")).first()
    assert tuple(r) == (5000, len(t.rstrip()))


def test_pieces_by_level(spark):
    block = "Uno dos tres. " + "Cuatro cinco seis; " * 3 + "siete ocho. " + " ".join(f"w{k}" for k in range(20)) + " ~~" + "x " * 50 + "~~"
    df = spark.createDataFrame([(1, 0, 100, block), (1, 1, 900, "Corto."), (2, 0, 0, None), (2, 1, 0, " ")], "art_id int, bloque int, inicio int, texto string")
    rows = L.pieces(df, 6).orderBy("art_id", "bloque", "inicio").collect()
    assert [(r.inicio, r.fin, r.forzado) for r in rows if r.bloque == 1] == [(900, 906, False)]
    cut = [(block[r.inicio - 100 : r.fin - 100], r.forzado) for r in rows if r.bloque == 0]
    assert cut[0] == ("Uno dos tres.", False) and all(len(t.replace("~", "").split()) <= 60 for t, _ in cut) and any(f for _, f in cut)
    assert "".join("".join(t.split()) for t, _ in cut) == "".join(block.split())


def test_shortened(spark):
    df = spark.createDataFrame([("Uno dos. Tres cuatro. Cinco.",), ("a b c d e f g, h",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(L.shortened(F.col("t"), 2, 4)).collect()] == ["Uno dos. Tres cuatro.", "a b c d.", "", ""]


def test_legal_tokens(spark):
    df = spark.createDataFrame([("La Sentencia C-0355 de 2006 y SU355, artículo 1o. de la ley",), (None,)], "t string")
    assert [r[0] for r in df.select(T.legal_tokens(F.col("t"))).collect()] == [["sentencia", "c355", "355", "2006", "su355", "355", "articulo", "1", "ley"], []]


def test_readable_enumerated_bare(spark):
    df = spark.createDataFrame([("ley_472_1998", "arts. 5, 6 y 7A de la Ley 0472 de 1998", "la Ley 599 y la ley 77"), ("codigo_civil", None, None)], "n string, e string, b string")
    a, b = df.select(C.readable(F.col("n")), C.enumerated(F.col("e")), C.bare(F.col("b"))).collect()
    assert tuple(a) == ("Ley 472 de 1998", ["ley_472_1998#art_5", "ley_472_1998#art_6", "ley_472_1998#art_7A"], ["codigo_penal"]) and tuple(b) == (None, [], [])


def test_stored_index(spark, tmp_path):
    rows = spark.createDataFrame([(0, "la sentencia C-355 de la corte"), (1, "proceso verbal sumario 391"), (2, "otra cosa"), (3, None), (4, "")], "row_id bigint, text string")
    path = str(tmp_path / "i")
    assert index.rebuild(rows, T.legal_tokens(F.col("text")), path) and not index.rebuild(rows, T.legal_tokens(F.col("text")), path)
    q = spark.createDataFrame([(1, "C-355"), (2, "verbal sumario 391"), (3, "nada conocido"), (4, None)], "qid bigint, q string")
    got = {(r.qid, r.rank): r.row_id for r in index.search(spark, path, q, T.legal_tokens(F.col("q")), 3).collect()}
    assert got == {(1, 1): 0, (2, 1): 1}
    index.guard(rows, path)
    with pytest.raises(RuntimeError, match="other rows"):
        index.guard(rows.where("row_id > 0"), path)
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0])], "row_id bigint, v array<float>")
    index.save_vectors(v, str(tmp_path / "v"))
    index.guard(v, str(tmp_path / "v"))
    assert sorted((r.row_id, r.v) for r in index.load_vectors(spark, str(tmp_path / "v")).collect()) == [(1, [0.0, 1.0]), (2, [1.0, 0.0])]


def test_direct_rows(spark):
    named = spark.createDataFrame([(1, 0, "ley_1_1990#art_2"), (1, 1, "ley_1_1990"), (1, 2, "ley_9_1999"), (2, 0, "ley_1_1990#art_77")], "qid bigint, n int, ident string")
    catalog = spark.createDataFrame([(10, "ley_1_1990#art_2"), (11, "ley_1_1990#art_2"), (12, "ley_1_1990#art_2"), (13, "ley_1_1990#art_3"), (14, None)], "row_id bigint, canon string")
    ranking = spark.createDataFrame([(1, 13, 1), (1, 10, 2), (2, 12, 5), (2, 13, 6), (2, 11, 9)], "qid bigint, row_id bigint, rank int")
    got = sorted((r.qid, r.n, r.row_id) for r in lookup.direct_rows(named, catalog, ranking).collect())
    assert got == [(1, 1, 10), (1, 2, 11), (1, 3, 13), (2, 1, 12), (2, 2, 13)]
    assert {(r.qid, r.nombradas, r.sin_corpus) for r in lookup.named_in_corpus(named, catalog).collect()} == {(1, 3, 1), (2, 1, 0)}
    assert lookup.direct_rows(named.where("false"), catalog, ranking).count() == 0


def test_scores(spark):
    key = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", []), (3, "C", ["z"]), (4, "D", ["z"])], "id bigint, correcta string, ref array<string>")
    said = spark.createDataFrame([(1, False, "A", ["x", "q", "r"], ["x", "r"]), (2, True, "B", [], []), (3, None, "A", ["z"], [])], "id bigint, abstencion boolean, letra string, dadas array<string>, evidencia array<string>")
    rows = scoring.with_answers(key, said)
    assert tuple(scoring.closed(rows).first()) == (4, 1, 0.25, 5.0)
    c = scoring.citations(rows).first().asDict()
    assert (c["items"], c["n_ref"], c["n_citadas"], c["aciertos_respaldados"], c["aciertos_sin_respaldo"], c["incorrectas"], c["citas_sin_respaldo"]) == (3, 4, 4, 1, 1, 1, 1) and c["recall"] == 0.375 and c["puntos"] == 0.0
    a = scoring.abstention(rows, F.col("letra") == F.col("correcta")).first().asDict()
    assert (a["abstuvo_bien"], a["abstuvo_de_mas"], a["respondio_bien"], a["respondio_mal"], a["calibracion"]) == (0, 1, 1, 2, 0.375)
    assert tuple(scoring.total([("cerradas", scoring.closed(rows)), ("correccion", None)]).first()) == (5.0, 20.0)
    empty = rows.where("false")
    assert tuple(scoring.closed(empty).first()) == (0, 0, 0.0, 0.0) and scoring.citations(empty).first().puntos == 0.0


def test_overlap_and_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a"]), ([], ["a"]), (["x", "x"], ["x"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(fusion.overlap_f1(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx((2 / 3 + 0.5) / 2, abs=1e-6), 1.0, 0.0, pytest.approx(2 / 3, abs=1e-6)]


def test_two_phases_and_letters(spark):
    class Echo:
        def think(self, prompts):
            return prompts * 3

        def answer(self, prompts, thoughts):
            return thoughts.str.len().astype(str)

    df = spark.createDataFrame([(1, "ab"), (2, "abcdef")], "id bigint, prompt string")
    assert sorted((r.id, r.pensado, r.respuesta, r.cortado) for r in responding.two_phases(df, Echo(), 6).collect()) == [(1, "ababab", "6", False), (2, "abcdef", "6", True)]
    p = {(r.id, r.letra): r.p for r in responding.letter_probabilities(df, lambda prompts, letters: [[0.0, math.log(3)] for _ in prompts], ["A", "B"]).collect()}
    assert p[1, "A"] == pytest.approx(0.25) and p[2, "B"] == pytest.approx(0.75)


def test_respond(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, q string")
    assert responding.respond(df, lambda x: x.withColumn("p", F.lit("texto"))).first().p == "texto"
    out = responding.respond(df, lambda x: x, lambda i, p: i.withColumn("r", F.upper("q")), lambda m: m.select("id", F.concat(F.lit("R: "), "r").alias("t")))
    assert out.first().t == "R: A"
