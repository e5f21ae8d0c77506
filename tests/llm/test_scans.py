import pytest

from tamiz.llm import scans as S

TEXT = "El capitán de puerto verificará la póliza de cumplimiento en los términos del inciso precedente y podrá modificar el canon de arrendamiento durante la vigencia del contrato sobre predios rurales con presentación personal. La comisión de tarifas del distrito remitirá sin demora el dictamen."
WORDS = {}
for w in S._TOKEN.findall(TEXT):
    WORDS[S._bare(w)[1].lower()] = 50


@pytest.fixture(scope="module")
def model():
    return S.Model(WORDS | {"dice": 9, "de": 500}, {"CAPITULO I"}, {"GACETA DE NORMAS EDICION 0": 9})


@pytest.mark.parametrize("noisy, kind", [
    ("El capi-\ntán de puerto", "guiones"), ("El capi¬\ntán de puerto", "guiones"), ("El cap­\nitán de puerto", "guiones"), ("El capitári de puerto", "lectura"), ("El capitán cle piierto", "lectura"), ("El c a p i t á n de puerto", "separadas"), ("El capitán ¦ de puerto", "marcas"), ("El capitán` de puerto", "lectura"),
    ("El capi tán de puerto", "separadas"), ("El cap1tán de puer-\nt0", "lectura"),
])
def test_repairs(model, noisy, kind):
    paragraphs, noise = S.repair(noisy, model)
    assert paragraphs == ["El capitán de puerto"] and kind in noise


def test_split_into_several_parts():
    model = S.Model(WORDS | {"considerar": 40, "con": 300, "si": 90}, set(), {})
    assert S.repair("El capitán podrá con si derar la póliza", model)[0] == ["El capitán podrá considerar la póliza"]
    assert S.repair("El capitán podrá con la póliza", model)[1] == []


def test_misread_word_of_any_length(model):
    long = S.Model(WORDS | {"otorrinolaringológicamente": 9}, set(), {})
    assert S.repair("El otorririolaririgológicarnerite decide", long)[0] == ["El otorrinolaringológicamente decide"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_character_error_of_planted_pages(model):
    """Words of a page misread, broken, torn apart and spotted: nine of ten wrong characters are put right and more."""
    from random import Random

    r, before, after = Random(2), 0, 0
    misread = [("n", "ri"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("t", "f"), ("l", "1"), ("o", "0")]
    for _ in range(60):
        out = []
        for w in TEXT.split():
            k = r.random()
            if k < 0.06 and len(w) > 5:
                a, b = r.choice(misread)
                w = w.replace(a, b, 1)
            elif k < 0.10 and len(w) > 6:
                at = r.randrange(2, len(w) - 3)
                w = w[:at] + "-\n" + w[at:]
            elif k < 0.12 and w.isalpha() and len(w) > 5:
                w = " ".join(w)
            elif k < 0.14:
                w += " ¦"
            out.append(w)
        noisy = " ".join(out)
        before += _distance(noisy, TEXT)
        after += _distance(" ".join(S.repair(noisy, model)[0]), TEXT)
    assert before > 600 and after <= 0.1 * before, (before, after)


def test_pages(model):
    text = "<!-- pagina 1 -->\nGACETA DE NORMAS   Edición 77\nEl capitán de puerto verificará la\npóliza de cumplimiento\np. 12\n\n<!-- pagina 2 -->\nGACETA DE NORMAS   Ed1ción 77\nen los términos del inciso precedente.\n\nCAPÍTULO I\n\nLa comisión de tarifas remitirá sin demora el dictamen.\np. 13"
    paragraphs, noise = S.repair(text, model)
    assert paragraphs == ["El capitán de puerto verificará la póliza de cumplimiento en los términos del inciso precedente.", "CAPÍTULO I", "La comisión de tarifas remitirá sin demora el dictamen."]
    assert noise == ["encabezados", "paginas"]


@pytest.mark.parametrize("clean", [TEXT, "El capitán de puerto\nverificará la póliza.", "<!-- pagina 1 -->\nLa comisión de tarifas remitirá:\n43\n62\n69", "El L’État français y el Nhã’ê", "ARTÍCULO 3A. El capitán.", ""])
def test_clean_pages(model, clean):
    assert S.repair(clean, model)[1] == []


def test_table(spark):
    rows = [(k, "html", TEXT) for k in range(12)] + [(20, "pdf_ocr", "El capi-\ntán de puerto verificará"), (21, None, "<!-- pagina 1 -->\nEl capitári de puerto"), (22, "pdf_texto", TEXT), (23, "pdf_ocr", None), (24, "pdf_ocr", ""), (25, None, None), (20, "pdf_ocr", "El capi-\ntán de puerto verificará")]
    df = spark.createDataFrame(rows, "texto_id bigint, metodo string, markdown string").selectExpr("*", "0 as ruidos")
    got = sorted((r.texto_id, tuple(r.ruidos)) for r in S.repaired(df).collect())
    assert got == [(20, ("guiones",)), (20, ("guiones",)), (21, ("lectura",)), (22, ())]
    assert S.repaired(df.where("false")).count() == 0


def test_statistics_of_all_rows(spark):
    word = "translate(cast(id % 4000 as string), '0123456789', 'abcdefghij')"
    clean = spark.range(12_000).selectExpr("id", "'html' as metodo", f"concat('El juez x', {word}, ' decide.\\nCAPÍTULO ', upper({word})) as markdown")
    printed = spark.range(12_000).selectExpr("id + 12000 as id", "'pdf_ocr' as metodo", f"concat(if(id % 2 = 0, 'GACETA ', 'CAPÍTULO '), upper({word}), '\\nEl juez decide.') as markdown")
    model = S.train(clean.unionByName(printed))
    names = [str(k).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(4000)]
    assert all(f"x{n}" in model.words for n in names)
    assert model.headers == sorted(f"GACETA {n.upper()}" for n in names[::2])
    few = S.train(clean.unionByName(printed), limit=10)
    assert len(few.words) + len(few.lines) + len(few.headers) <= 10 + len("aeouy")


def test_no_word_is_cut_off(spark):
    """Every word that stands three times is known; of the lines of other parts, those at the edges of printed pages guard."""
    words = [f"palabra{k:06d}".translate(str.maketrans("0123456789", "bcdfghjklm")) for k in range(210_000)]
    page = "<!-- pagina 1 -->\n1\nGaceta\n2\nTítulo suelto\nEl juez decide."
    rows = [("html", " ".join(words))] * 3 + [("html", "TÍTULO SUELTO\nOtra línea\ntexto")] + [("pdf_ocr", page)] * 3
    model = S.train(spark.createDataFrame(rows, "metodo string, markdown string"))
    assert all(w in model.words for w in words)
    assert model.lines == {"TITULO SUELTO"} and model.headers == ["GACETA"]
