"""Readers, writers, HTML and streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tamiz.functions.html import page, to_markdown
from tamiz.sources import readers, sinks
from tamiz.streaming import incremental


def test_markdown_documents_and_parts(spark, tmp_path):
    (tmp_path / "uno.md").write_text('---\n{"doc_id": "d1", "anio": 1990}\n---\n<!-- parte a.html | http://x/a -->\nHola\n\n<!-- parte b.html | http://x/b -->\nMundo')
    (tmp_path / "dos.md").write_text("Sin cabecera")
    docs = readers.markdown_documents(spark, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {"d1", "dos"}
    assert [(r.doc_id, r.url, r.texto, r.inicio) for r in readers.split_parts(docs).orderBy("doc_id", "k").collect()] == [("d1", "http://x/a", "Hola", 0), ("d1", "http://x/b", "Mundo", 6), ("dos", None, "Sin cabecera", 0)]


def test_checkpoint_drops_torn_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n\n{"id": 1, "v": "c"}\n{"id": 3, "v": "d')
    assert {r.id: r.v for r in readers.checkpoint(spark, str(p), "id bigint, v string").collect()} == {1: "c", 2: "b"}


def test_lists_banks_and_targets(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# lista\nhttps://a/1 # uno\n\nhttps://a/1\nhttps://b/2\n")
    assert sorted(r.url for r in readers.link_list(spark, str(tmp_path / "l.txt")).collect()) == ["https://a/1", "https://b/2"]
    (tmp_path / "bad.txt").write_text("ftp://x\n")
    with pytest.raises(Exception, match="no address"):
        readers.link_list(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "b.json").write_text(json.dumps({"cerradas": [{"id": 2, "estado": "approved"}, {"id": 1, "estado": "draft"}], "abiertas": [{"id": 3, "estado": "approved"}]}))
    assert [(r.formato, r.id) for r in readers.bank(spark, str(tmp_path / "b.json")).collect()] == [("multiple_choice", 2), ("open_ended", 3)]
    for n, w in (("t1", 1.0), ("t2", 5.0)):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"doc_id": "a", "url": "http://x", "areas": [], "peso": w}, {"doc_id": "MAL ID", "url": "x", "areas": None, "peso": 1}]))
    good, bad = readers.targets(spark, [str(tmp_path / "t1.json"), str(tmp_path / "t2.json")])
    assert [(r.doc_id, r.peso) for r in good.collect()] == [("a", 5.0)] and bad.count() == 2


def test_bytes(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Uno</w:t><w:tab/><w:t>dos</w:t></w:p></w:document>')
    rows = [(1, z.getvalue(), None), (2, "año".encode("cp1252"), "text/html; charset=iso-8859-1"), (3, "año".encode(), None), (4, b"%PDF-1.4", None), (5, None, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b else None, k) for i, b, k in rows], "id int, b binary, k string")
    got = {r.id: r for r in df.select("id", readers.sniff(F.col("b")).alias("f"), readers.decoded("b", "k").alias("t"), readers.docx_markdown("b").alias("d")).collect()}
    assert (got[1].f, got[1].d) == ("docx", "Uno\tdos") and got[2].t == got[3].t == "año" and got[4].f == "pdf" and got[5].t is None and got[2].d is None


def test_transport_failures_are_rows(spark):
    def get(url):
        if "bad" in url:
            raise OSError("lost")
        return {"status": 200, "content": b"x"}

    df = spark.createDataFrame([("http://a/ok",), ("http://a/bad",)], "url string")
    assert {r.url[-2:]: (r.status, r.error) for r in readers.pages_by(get, df).collect()} == {"ok": (200, None), "ad": (None, "lost")}


def test_html(spark):
    h = '<html><head><title> Ley 1 </title><script>x()</script></head><body><nav>menu</nav><h1>Ley</h1><p>Uno <s>dos</s> <a href="/b.html">enlace</a></p><div style="display: none">oculta</div><a href="javascript:x">no</a><a href="b2.html">Siguiente</a></body></html>'
    p = page(h, "http://x/a/")
    assert p["titulo"] == "Ley 1" and p["markdown"].startswith("# Ley") and "~~dos~~" in p["markdown"] and "menu" not in p["markdown"] and "oculta" not in p["markdown"]
    assert p["notas"] == ["oculta"] and p["enlaces"] == ["http://x/b.html", "http://x/a/b2.html"] and p["siguiente"] == "http://x/a/b2.html"
    df = spark.createDataFrame([(h, "http://x/"), (None, None), ("<p", "")], "h string, u string")
    assert df.select(to_markdown(F.col("h"), F.col("u")).alias("p")).select("p.titulo").collect()[1].titulo == ""


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "id int, v string")
    sinks.write_ordered(df, str(tmp_path / "t"), ["id"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sinks.fingerprint(df, "id", "v").collect() == sinks.fingerprint(back, "id", "v").collect()
    new = spark.createDataFrame([(1, "z"), (4, "n")], "id int, v string")
    assert {r.id: r.v for r in sinks.upsert(df, new, "id", ["v"]).collect()} == {1: "z", 2: None, 3: "c", 4: "n"}
    with pytest.raises(Exception, match="required"):
        sinks.upsert(df, df, "id", ["v"]).collect()
    assert [r.id for r in sinks.stale(df, new, "id").orderBy("id").collect()] == [2, 3]
    assert sinks.same_order(df, df, "id", "v").count() == 0


def test_resumable(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    spark.range(5).write.parquet(src)
    run = lambda: incremental.resumable(spark, src, "id bigint", lambda b: b.withColumn("y", F.col("id") * 2), out, state).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    run()
    assert sorted(r.y for r in spark.read.parquet(out).collect()) == [2 * k for k in range(8)]


def test_isolated_failures(spark):
    def work(r):
        return {"id": r["id"], "v": str(1 // r["id"])}

    got = {r.id: (r.v, r.error is None) for r in incremental.isolated(spark.range(3), work, "id bigint, v string").collect()}
    assert got[0] == (None, False) and got[1] == ("1", True)


def test_streams(spark, data, tmp_path):
    s = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parqu*")
    q = incremental.event_windows(incremental.once(s), late=None).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() > 0


def test_yaml_header(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ndoc_id: ley_1\ntitulo: "Ley 1: de pruebas"\nanio: 1990  # año\nareas:\n  - civil\n  - penal\ntipo_norma: sentencia\nurl: https://x/a#b\norigen:\n---\nUna línea\npartida.\nOtra.\n')
    (tmp_path / "b.md").write_text("---\nareas: [civil, 'penal, militar']\nfuente: X\n---\nUna línea\npartida.")
    (tmp_path / "c.md").write_text("---\n{roto\n---\ncuerpo")
    got = {r.doc_id: r for r in readers.markdown_documents(spark, str(tmp_path)).collect()}
    m = got["ley_1"].meta
    assert (m.titulo, m.anio, m.areas, m.url, m.origen) == ("Ley 1: de pruebas", 1990, ["civil", "penal"], "https://x/a#b", None) and got["ley_1"].cuerpo == "Una línea partida.\nOtra.\n"
    assert got["b"].meta.areas == ["civil", "penal, militar"] and got["b"].cuerpo == "Una línea\npartida." and got["c"].meta is None and got["c"].cuerpo == "cuerpo"


def test_last_line_over_several_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for n in range(5):
        (tmp_path / "c" / f"p{n}.jsonl").write_text("".join(f'{{"id": {k}, "v": "{n}-{k}"}}\n' for k in range(n, 8 + n)) + ("x" * 3000 * (5 - n)) + "\n")
    got = {r.id: r.v for r in readers.checkpoint(spark, str(tmp_path / "c"), "id bigint, v string").collect()}
    assert got == {k: f"{min(k, 4)}-{k}" for k in range(12)}


def test_aliases_and_manifest(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("codigos:\n  codigo_civil: código civil\nalias_numero:\n  ley_599: codigo_penal\nextra: [uno, dos]\n")
    rows = {(r.seccion, r.clave, r.valor) for r in readers.aliases(spark, str(tmp_path / "a.yaml")).collect()}
    assert rows == {("codigos", "codigo_civil", "código civil"), ("alias_numero", "ley_599", "codigo_penal"), ("extra", "0", "uno"), ("extra", "1", "dos")}
    (tmp_path / "m.json").write_text(json.dumps([{"doc_id": "a", "estado": "error"}, {"doc_id": "a", "estado": "ok"}, {"doc_id": None}]))
    assert [(r.doc_id, r.estado) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", "ok")]


def test_page_chains(spark):
    rows = [("a1", "a2", "a"), ("a2", "a3", "a"), ("a3", None, "a"), ("b1", "a1", "b"), ("c1", "c2", "c"), ("c2", "c1", "c"), ("d1", "d1", "d"), (None, "a1", "a")] + [(f"e{k}", f"e{k + 1}", "e") for k in range(310)]
    got = {r.page: (r.head, r.place) for r in readers.page_chains(spark.createDataFrame(rows, "page string, next string, base string")).collect()}
    assert got["a3"] == ("a1", 2) and got["b1"] == ("b1", 0) and not {"c1", "c2", "d1"} & got.keys() and got["e299"] == ("e0", 299) and "e300" not in got


def test_texts_cache_and_items(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "uno\n\ndos"), ("b", "tres"), ("c", None)], "doc_id string, texto string")
    sinks.write_texts(df, p)
    held = {r.doc_id: r.value for r in spark.read.text(p, wholetext=True).collect()}
    assert held == {"a": "uno\n\ndos\n", "b": "tres\n"}
    assert sinks.retire_texts(df.where("doc_id = 'a'").select("doc_id"), p) == ["b"] and [r.doc_id for r in spark.read.text(p, wholetext=True).collect()] == ["a"]
    one = spark.range(3)
    assert sinks.cached(one, str(tmp_path / "k"), "f1").count() == 3 and sinks.cached(spark.range(9), str(tmp_path / "k"), "f1").count() == 3 and sinks.cached(spark.range(9), str(tmp_path / "k"), "f2").count() == 9
    work = lambda x: x.select("id", (F.col("id") * 2).alias("v"))
    assert [sinks.append_items(spark.range(n), str(tmp_path / "i"), work, "id bigint, v bigint") for n in (3, 5, 5)] == [3, 2, 0]
    assert sorted(r.v for r in spark.read.json(str(tmp_path / "i")).collect()) == [0, 2, 4, 6, 8]
    for k in ("x", "y"):
        sinks.append_events(spark.createDataFrame([(k, "d")], "tipo string, detalle string"), str(tmp_path / "e"))
    assert sorted(r.tipo for r in spark.read.json(str(tmp_path / "e")).collect()) == ["x", "y"]


def test_mended_text():
    assert readers.mended("secciÃ³n") == "sección" and readers.mended("sección Ã") == "sección Ã" and readers.mended("año") == "año"
