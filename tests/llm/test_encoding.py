import pytest

from tamiz.llm import encoding as E

CLEAN = [
    "La comisión de tarifas verificará la póliza de cumplimiento según la clasificación de la Resolución 12 de 1990, y el capitán de puerto también podrá ceder el cálculo de la indemnización dentro de los días hábiles siguientes.",
    "ARTÍCULO 1. INTERÉS MORATORIO. El señor notario del círculo declarará más allá del último año la cesión; ¿quién responderá? Única razón: ningún trámite está exento en la región.",
] * 30
DAMAGED = "La inspección del trabajo remitirá sin demora el dictamen técnico del año único, según el artículo pedido por la señora López en la región."


@pytest.fixture(scope="module")
def model():
    return E.Model(CLEAN)


@pytest.mark.parametrize("state", ["utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as cp1251", "utf-8 as mac_roman", "utf-8 as cp437", "cp850 as cp1252", "cp1252 as cp437", "cp1252 as mac_roman", "utf-8 as cp1252, twice", "mac_roman as cp1252"])
def test_round_trip(model, state):
    bad = E.STATES[state][0](DAMAGED)
    assert bad != DAMAGED
    text = f"{CLEAN[0]} {bad} {CLEAN[1]}"
    assert E.suspicious(text)
    fixed, states = E.restore(text, model)
    assert states and fixed == f"{CLEAN[0]} {DAMAGED} {CLEAN[1]}"


@pytest.mark.parametrize("text", [
    CLEAN[0], "El rótulo «ГОСТ 423» y la voz naïf se conservarán.", "Para la fórmula √x ≤ π se tomarán ±5 °C y 5 µg; la comisión verificará.", "El símbolo ¤ designa la unidad, ¢ el centavo y € la divisa.",
    "La ciudad de SÃO TOMÉ DO VALE, DECLARAÇÃO DE ÂMBITO COMUM.", "L’État français communique l’arrêté n° 56 — version «â lettre» —.", "La comunidad Nhã’ê podrá emplear las grafías ã, ẽ, ĩ, õ y ũ.", "la mesa técn­\nica del dis¬\ntrito ¦ firmó", "",
])
def test_rightful_signs_are_no_cases(model, text):
    assert not E.suspicious(text) or E.restore(text, model) == (text, [])


def test_lost_characters_are_cases(model):
    assert E.restore("la regi�n insular", model) == ("la regi�n insular", ["lost"])


def test_table(spark):
    bad = E.STATES["utf-8 as cp1252"][0](DAMAGED)
    rows = [(k, t, None) for k, t in enumerate(CLEAN[:20])] + [(100, bad, ["limpia", None, bad, ""]), (101, None, [bad]), (102, "", []), (103, bad, None), (103, bad, None)]
    df = spark.createDataFrame(rows, "texto_id bigint, markdown string, notas array<string>").selectExpr("*", "1 as campo")
    got = sorted((r.texto_id, r.campo, r.entrada if r.entrada is not None else -1, r.texto == DAMAGED) for r in E.garbled(df).collect())
    assert got == [(100, "markdown", -1, True), (100, "notas", 2, True), (101, "notas", 0, True), (103, "markdown", -1, True), (103, "markdown", -1, True)]
    assert E.garbled(df.where("false")).count() == 0


def test_no_text_that_is_damaged_is_passed_over(model):
    """The bound that texts are chosen by lets every text pass in which the model labels a span."""
    for state, (damage, _) in E.STATES.items():
        for text in CLEAN[:8]:
            for word in {w for w in text.split() if not w.isascii()}:
                try:
                    bad = text.replace(word, damage(word))
                except UnicodeError:
                    continue
                assert model.may_be_damaged(bad) or E.restore(bad, model)[1] == [], (state, word)


def test_single_damaged_words(model):
    """Of single words read with a wrong encoding in a clean text, nine of ten are found, and of those found most come out as they were."""
    n = found = right = 0
    for state, (damage, _) in E.STATES.items():
        for text in CLEAN:
            for word in sorted({w for w in text.split() if not w.isascii()})[:4]:
                try:
                    bad = text.replace(word, damage(word))
                except UnicodeError:
                    continue
                if bad != text:
                    fixed, states = E.restore(bad, model)
                    n, found, right = n + 1, found + bool(states), right + (fixed == text)
    assert n > 300 and found >= 0.9 * n and right >= 0.8 * n, (n, found, right)


def test_all_rows_train(spark, monkeypatch):
    """Texts of any length and number train the model, however few words a task holds."""
    texts = [f"La acción número{k} según el artículo {k % 9}, está vigente.\nOtra línea" for k in range(1200)] + ["El pingüino común vuela así. " * 1000]
    monkeypatch.setattr(E, "_HELD", 50, raising=False)
    got = E.train(spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "id bigint, text string"))
    want = E.Model([*texts, ""])
    assert got.first[0]["g"] > 1000 and [c.keys() for c in got.pairs] == [c.keys() for c in want.pairs]
    assert E.train(spark.createDataFrame([], "id bigint, text string")).first[0] == E.Model([]).first[0]
    for a, b in want.pairs[0]:
        assert got.ratio(a, b) == pytest.approx(want.ratio(a, b))
