import inspect

import pytest

from tamiz.llm import sentences as S

BASE = [
    "El juez decidirá el recurso. La sala lo confirmó en la pág. 12 del libro. El perito firmó el acta.\n\nEl notario, p. ej., cobró la tarifa. Se aportaron planos, recibos, etc. La parte calló.\n\nEl contrato se celebró con Molinos S.A. El juez lo aprobó.\n\nLa sala citó el art. 33 del código y el art. 40 de la ley. Terminó la audiencia.",
    "The judge decided the case. The court cited art. 33 (cf. p. 12) of the code. The firm Hale Ltd. is bound by Reg. 12.\n\nThe court sat at 5 p.m. on the date fixed.",
    "承租人提交报告。法院须公告。\n\n原告应当提交报告。\n\n承租人须公告。", "原告は提出した。裁判所は受理した！\n\n原告は受理した。", "न्यायालय ने आदेश दिया। वादी आया।\n\nवादी रु. 114.50 देगा।", "المحكمة قررت. المدعي حضر؟\n\nالمحكمة قررت.",
] * 20


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    c = Counter()
    for t in BASE:
        c.update(S.training_rows(t))
    return S.Model([(*k, n) for k, n in c.items()])


@pytest.mark.parametrize("text, units", [
    ("El juez citó el art. 33 del código. La sala calló.", ["El juez citó el art. 33 del código.", "La sala calló."]),
    ("Se aportaron planos, etc. La parte calló.", ["Se aportaron planos, etc.", "La parte calló."]),
    ("El contrato valió 33.325 pesos. El juez calló", ["El contrato valió 33.325 pesos.", "El juez calló"]),
    ("El juez decidirá.La sala calló.", ["El juez decidirá.", "La sala calló."]),
    ("CAPÍTULO V. GARANTÍAS\n\nEl juez decidirá.", ["CAPÍTULO V. GARANTÍAS", "El juez decidirá."]),
    ("ARTÍCULO 4. El juez decidirá. Caso 4. La sala calló.", ["ARTÍCULO 4. El juez decidirá.", "Caso 4. La sala calló."]),
    ("Se observarán estas reglas:\n1. El juez decidirá\n2. la sala callará;\n3. El perito firmó.", ["Se observarán estas reglas:", "1. El juez decidirá", "2. la sala callará;", "3. El perito firmó."]),
    ("El juez decidirá\nel recurso. La sala\ncalló.", ["El juez decidirá\nel recurso.", "La sala\ncalló."]),
    ("La sala anotó: «El juez calló. El perito firmó». El notario cobró.", ["La sala anotó: «El juez calló. El perito firmó».", "El notario cobró."]),
    ("El juez preguntó «¿procede?» y calló. La sala (¡y cómo!) decidió.", ["El juez preguntó «¿procede?» y calló.", "La sala (¡y cómo!) decidió."]),
    ("“El juez decidirá el recurso.” La sala calló…", ["“El juez decidirá el recurso.”", "La sala calló…"]),
    ("—El juez decidirá. La sala calló— replicó el perito. El notario cobró.", ["—El juez decidirá. La sala calló— replicó el perito.", "El notario cobró."]),
    ("承租人提交报告。法院说：“等一等。再议。”随后退庭。", ["承租人提交报告。", "法院说：“等一等。再议。”随后退庭。"]),
    ("ศาลต้องยื่นรายงาน ผู้เช่าต้องยื่นตามมาตรา 665 ภายใน 7 วัน", ["ศาลต้องยื่นรายงาน", "ผู้เช่าต้องยื่นตามมาตรา 665 ภายใน 7 วัน"]),
    ("न्यायालय ने आदेश दिया। वादी रु. 114.50 देगा।", ["न्यायालय ने आदेश दिया।", "वादी रु. 114.50 देगा।"]), ("", []), (None, []), (" \n\n ", []), ("...", ["..."]),
])
def test_units(model, text, units):
    assert [text[a:b] for a, b in S.split(text, model)] == units


@pytest.fixture(scope="module")
def large():
    """Model of some hundred texts of ten sentences each, in scripts with and without spaces and letter case."""
    from collections import Counter
    from random import Random

    r, c = Random(5), Counter()
    parts = {
        "es": (" ", ["El juez", "La sala", "El notario", "La parte", "El perito de Molinos"], ["decidirá", "archivará", "certificará", "pedirá"], ["el recurso.", "la prueba documental.", "el acta en el archivo.", "la copia del Decreto 5."]),
        "zh": ("", ["承租人", "法院", "原告"], ["应当提交", "须公告", "不得转让"], ["鉴定报告。", "担保书。", "租赁合同。"]),
        "ja": ("", ["原告は", "登記官は", "裁判所は"], ["遅滞なく", "書面により"], ["鑑定報告を受理した。", "担保書を提出した。"]),
        "hi": (" ", ["किरायेदार", "न्यायालय", "निरीक्षक"], ["अपील", "पट्टा"], ["प्रस्तुत करेगा।", "अस्वीकार करेगा।"]),
    }
    for gap, *slots in parts.values():
        for _ in range(300):
            units = [gap.join(r.choice(x) for x in slots) for _ in range(10)]
            c.update(S.training_rows((gap.join(units[:4]) + "\n\n" + gap.join(units[4:]))))
    return S.Model([(*k, n) for k, n in c.items()])


@pytest.mark.parametrize("text, units", [
    ("El juez decidirá el recurso La sala archivará la prueba documental. El perito de Molinos pedirá el acta", ["El juez decidirá el recurso", "La sala archivará la prueba documental.", "El perito de Molinos pedirá el acta"]),
    ("La parte pedirá la copia del Decreto 5 y el notario certificará el acta.", ["La parte pedirá la copia del Decreto 5 y el notario certificará el acta."]),
    ("La sala («El juez decidirá el recurso La sala archivará») calló.", ["La sala («El juez decidirá el recurso La sala archivará») calló."]),
    ("承租人应当提交鉴定报告法院须公告担保书。", ["承租人应当提交鉴定报告", "法院须公告担保书。"]), ("原告は書面により担保書を提出した裁判所は遅滞なく鑑定報告を受理した。", ["原告は書面により担保書を提出した", "裁判所は遅滞なく鑑定報告を受理した。"]),
    ("किरायेदार अपील प्रस्तुत करेगा न्यायालय पट्टा अस्वीकार करेगा।", ["किरायेदार अपील प्रस्तुत करेगा", "न्यायालय पट्टा अस्वीकार करेगा।"]),
])
def test_missing_marks(large, text, units):
    assert [text[a:b] for a, b in S.split(text, large)] == units


def test_offsets_cover_everything_but_blanks(model):
    for t in BASE[:6]:
        spans = S.split(t, model)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(t[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")


def test_table(spark):
    rows = [(k, t) for k, t in enumerate(BASE[:12])] + [(50, None), (51, ""), (52, "El juez decidirá. " * 3000), (0, BASE[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as inicio")
    got = S.sentences(df).groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in got}
    assert n[52] == 3000 and n[0] % 2 == 0 and 50 not in n and 51 not in n
    assert S.sentences(df.where("false")).count() == 0


def test_statistics_of_all_documents(spark):
    word = "translate(cast(id % 3000 as string), '0123456789', 'abcdefghij')"
    rows = spark.range(12_000).selectExpr("id as doc_id", f"concat('El juez de la parte decidirá sobre el recurso que la sala reciba del operador abx', {word}, '.') as text")
    model = S.train(rows)
    names = [str(k).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(3000)]
    assert all((f"abx{n}", ".") in model.after for n in names)
    assert len(S.train(rows, 10).after) <= 10


def test_no_count_is_cut_off(spark, monkeypatch):
    """The model of a table equals that of all its counts, however few a task holds."""
    texts = [f"Palabra{k} larga dice que Norma{k % 7} vale. Según el art. {k} del texto{k} otra vez Norma{k % 7} rige siempre.\n\nNorma{k % 7} segunda aquí termina{k}." for k in range(60)]
    monkeypatch.setattr(S, "_HELD", 20)
    assert inspect.signature(S.train).parameters["limit"].default is None
    got, want = S.train(spark.createDataFrame([(t,) for t in texts], "text string")), S.Model([(*k, n) for k, n in S.counted(texts).items()])
    assert got.after == pytest.approx(want.after) and got.b == want.b and got.left == want.left and got.gaps == want.gaps
    assert all(got.unmarked(w, r) == want.unmarked(w, r) for w, r in want.pair)
    assert [S.split(t, got) for t in texts] == [S.split(t, want) for t in texts]


ODD = [
    "El juez Pérez dijo que La Sala\n callará  y  Que\tÉl, Molinos;\xa0Vela Ruiz y\x1fLuz firman ÷ Ángel\x85Ñandú _Uno 5Dos ( Tres ¿Cuatro «Cinco» ﬁn Ǆora ǅora.",
    " Antes de La Sala del Norte Que rige desde el Año que El juez fijó, en Villa Sol y Luz, sin Norma Que lo Diga .. ... Fin\n\nOtro párrafo sin marca Que termina en La Sala",
    "किरायेदार अपील प्रस्तुत करेगा न्यायालय पट्टा अस्वीकार करेगा  और वादी रु. 114.50 देगा। المحكمة قررت المدعي حضر؟ Суд Решил Что Иск принят и Дело закрыто.",
]


def _may_begin(r):
    return not r[:1].islower() and not r[:1].isdigit()


def test_gaps_are_counted_by_block(monkeypatch):
    """Counts of gaps in blocks of paragraphs equal those of one word after the other."""
    from collections import Counter

    want, texts = Counter(), ODD * 3 + BASE[:6]
    for t in texts:
        for _, p in S.paragraphs(t):
            words = p.split()
            if len(p.strip()) < 60 and not S._MARK.search(p.strip()[-3:]):
                continue
            for w, nxt in zip(words, words[1:]):
                letter, r = S._ends_in_letter(w), S._word_after(nxt, 0)[0]
                if letter or w[-1] in ",;":
                    want["n", "", "", r] += 1
                if letter and _may_begin(r):
                    want["g", S._word_before(w, len(w)), "", r] += 1
    for size in (0, 150, 1 << 22):
        monkeypatch.setattr(S, "_BLOCK", size)
        got = S.counted(texts)
        assert {k: n for k, n in got.items() if k[0] == "n" or k[0] == "g" and not S._CJK.search(k[1])} == want


def test_few_words_are_looked_up():
    """Only words that may begin a unit are looked up, and all gaps before them are found."""
    looked = []

    class Opens(dict):
        def __missing__(self, token):
            looked.append(token)
            return S._right(token[:24])[0] if _may_begin(S._right(token[:24])[0]) else ""

    class Stub:
        opens, opening = Opens(), set()

        @staticmethod
        def unmarked(w, r):
            return 0.75

    p = "la parte pedirá " * 400 + "en el archivo La sala"
    assert [p[a:b + 2] for a, b, _ in S._gaps(p, Stub, False)] == [" La"] and len(looked) <= 5
    for p in ODD:
        words = list(S.re.finditer(r"\S+", p))
        want = [(x.end(), y.start(), 0.75) for x, y in zip(words, words[1:]) if S._ends_in_letter(x.group()) and (r := S._right(y.group()[:24])[0]) and _may_begin(r)]
        assert S._gaps(p, Stub, False) == want
