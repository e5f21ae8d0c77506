"""Articles of norms, pieces and chunks with context headers.

Segmentation is a state machine over the blocks of one document, so it runs in Arrow batches of whole documents; all
that follows it is relational.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_OPENER = re.compile(r"\s*#*\s*(?:ART[ÍI]CULO|Art[íi]culo|ART\.|Art\.)\s+(\d+)(?:[\s-]*(bis|ter|[A-Z])(?=o?[.\s°º-])o?|[oº°]s?(?=[.\s-]))?[.\s°º–-]*", re.U)
_HIERARCHY = re.compile(r"\s*#*\s*(LIBRO|PARTE|T[ÍI]TULO|CAP[ÍI]TULO|SECCI[ÓO]N)\b[^\n]*", re.I)
_LEVEL = {"libro": 0, "parte": 1, "titulo": 2, "capitulo": 3, "seccion": 4}
_TITLE = re.compile(r"([^\n.]{3,120})\.\s")
#: A number may run ahead by so many; a much smaller one begins a quotation of another norm.
AHEAD, BACK = 5, 20


def blocks_of(text: str) -> list[tuple[str, int, int]]:
    """Blocks between blank lines, with half-open offsets, outer white space left out."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            out.append((part.strip(), at + lead, at + len(part.rstrip())))
        at = m.end() if m else end
    return out


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")


def _upper(s: str) -> bool:
    letters = [c for c in s if c.isalpha()]
    return bool(letters) and sum(c.isupper() for c in letters) > 0.8 * len(letters) and len(s) <= 250


def articles_of(text: str) -> Iterator[tuple]:
    """Rows ``(orden, num, num_base, sufijo, titulo, jerarquia, bloques)``; what stands before the first article has number ``None``."""
    path: dict[int, str] = {}
    current: list | None = None
    preamble: list = []
    seen, order = 0, 0
    waiting: int | None = None
    for block, a, b in blocks_of(text):
        h = _HIERARCHY.fullmatch(block.split("\n")[0]) if len(block) < 250 else None
        if h and "\n" not in block:
            level = _LEVEL[_plain(h.group(1))]
            path = {k: v for k, v in path.items() if k < level} | {level: block.strip("# ")}
            waiting = level
            continue
        if waiting is not None and _upper(block) and not _OPENER.match(block):
            path[waiting] = f"{path[waiting]} {block}"
            waiting = None
            continue
        waiting = None
        m = _OPENER.match(block)
        base = int(m.group(1)) if m else 0
        if m and (seen == 0 or seen - BACK <= base <= seen + AHEAD) and base > 0:
            if current:
                yield tuple(current)
            suffix = (m.group(2) or "").strip()
            t = _TITLE.match(block[m.end() :])
            title = t.group(1).strip() if t and _upper(t.group(1)) else ""
            order += 1
            current = [order, f"{base}{suffix}", base, suffix, title, " > ".join(path[k] for k in sorted(path)), [(block, a, b)]]
            seen = max(seen, base)
        elif current:
            current[6].append((block, a, b))
        else:
            preamble.append((block, a, b))
    if current:
        yield tuple(current)
    if preamble:
        yield (0, None, None, "", "", "", preamble)


ARTICLE = "doc_id string, orden int, num string, num_base int, sufijo string, titulo string, jerarquia string, bloques array<struct<texto:string,inicio:int,fin:int>>"


def segment(texts: DataFrame) -> DataFrame:
    """Articles of ``(doc_id, texto)``; the preamble, or a text without articles, is order 0 without a number. Null texts give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "orden", "num", "num_base", "sufijo", "titulo", "jerarquia", "bloques"]
        for batch in batches:
            rows = [(d, *r[:6], [dict(zip(("texto", "inicio", "fin"), b)) for b in r[6]]) for d, t in zip(batch["doc_id"], batch["texto"]) for r in articles_of(t)]
            yield pd.DataFrame(rows, columns=names).astype({"num_base": "Int32"})

    return texts.where("texto is not null").select("doc_id", "texto").mapInPandas(run, ARTICLE)


def number_parts(num: Column) -> Column:
    """Struct ``(num, base, sufijo)`` of an article number such as ``397 A`` or ``12 bis``."""
    plain = F.regexp_replace(F.upper(F.trim(num)), r"[º°.]", "")
    base = F.regexp_extract(plain, r"^(\d+)", 1)
    rest = F.trim(F.regexp_replace(plain, r"^\d+\s*(O$)?", ""))
    return F.struct(F.concat(base, rest).alias("num"), F.when(F.length(base) > 0, base.cast("int")).alias("base"), rest.alias("sufijo"))


def context_header(name: Column, path: Column, num: Column, title: Column, k: Column, n: Column) -> Column:
    """Line of context of a chunk: norm, place, article and title, part k of n where there are several."""
    article = F.when(num.isNotNull(), F.concat(F.lit("Artículo "), num))
    titled = F.when(F.coalesce(title, F.lit("")) != "", title)
    part = F.when(n > 1, F.format_string("(parte %d/%d)", k, n))
    return F.concat_ws(". ", name, F.when(F.coalesce(path, F.lit("")) != "", path), article, titled, part)


def chunks(pieces: DataFrame, name: Column) -> DataFrame:
    """Chunk rows of ``(doc_id, art, k0, texto, inicio, fin, ...)``: id, part of parts, position in the document, hashes.

    The id is ``doc#art#pK``. ``sha1_texto`` is of the text as it is, ``sha1_cuerpo`` of its words in lower case.
    """
    in_article = Window.partitionBy("doc_id", "art").orderBy("inicio", "fin")
    whole = Window.partitionBy("doc_id", "art")
    in_doc = Window.partitionBy("doc_id").orderBy("inicio", "fin")
    body = F.trim(F.regexp_replace(F.lower("texto"), r"\s+", " "))
    return pieces.select(
        "*", F.row_number().over(in_article).alias("parte_k"), F.count(F.lit(1)).over(whole).cast("int").alias("parte_n"), (F.row_number().over(in_doc) - 1).alias("posicion"), name.alias("nombre"),
        F.sha1(F.col("texto").cast("binary")).alias("sha1_texto"), F.sha1(body.cast("binary")).alias("sha1_cuerpo"),
    ).withColumn("chunk_id", F.concat("doc_id", F.lit("#"), F.coalesce("art", F.lit("preambulo")), F.lit("#p"), F.col("parte_k").cast("string")))


def validity(notes: Column) -> Column:
    """Struct of what editorial notes ``{{ }}`` say: repealed, partly unconstitutional, amended by which norms."""
    low = F.lower(F.array_join(notes, " "))
    return F.struct(low.rlike(r"\bderogad[oa]\b").alias("derogado"), low.rlike(r"\binexequible\b").alias("parcial"), F.regexp_extract_all(low, F.lit(r"(?:modificado|adicionado|corregido|derogado)[^}]*?((?:ley|decreto) \d+ de \d{4})"), 1).alias("por"))


def editorial_notes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)\{\{(.*?)\}\}"), 1), F.trim)


def judgment_sections(texts: DataFrame) -> DataFrame:
    """``(doc_id, seccion, inicio, fin)``: parts of judgments between numbered Roman headings at line begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = re.compile(r"(?m)^#*\s*[IVX]+\.\s+([A-ZÁÉÍÓÚÑ ]{4,60})$")
        for batch in batches:
            out = []
            for d, t in zip(batch["doc_id"], batch["texto"]):
                found = list(head.finditer(t))
                for m, nxt in zip(found, [*found[1:], None]):
                    out.append((d, m.group(1).strip().lower(), m.start(), nxt.start() if nxt else len(t)))
            yield pd.DataFrame(out, columns=["doc_id", "seccion", "inicio", "fin"])

    return texts.where("texto is not null").select("doc_id", "texto").mapInPandas(run, "doc_id string, seccion string, inicio int, fin int")


# fixed values: headers of a judgment's decision and of dissents, the line that names its author, names that follow it
DECISION = r"^(?:[IVXL]+\.\s*)?(?:DECISI[ÓO]N|R\s?E\s?S\s?U\s?E\s?L\s?V\s?E)\s*[.:]?$"
DISSENT = r"^(?i)(?:CON\s+)?(?:SALVAMENTO|ACLARACI[ÓO]N)\s+(?:PARCIAL\s+)?DE\s+VOTO"
AUTHOR, DOCTOR = r"^(?i)Magistrad[oa]s?\s+Ponentes?\s*:?\s*(.*)$", r"^Dra?\.\s+(.+)$"


def _positions(texts: DataFrame) -> DataFrame:
    """``(doc_id, k, b)``: blocks between blank lines, numbered."""
    return texts.where("texto is not null").select("doc_id", F.posexplode(F.filter(F.transform(F.split("texto", r"\n\s*\n"), F.trim), lambda x: x != "")).alias("k", "b"))


def decision_sections(texts: DataFrame) -> DataFrame:
    """``(doc_id, seccion, desde, hasta)`` in blocks: body, decision from its first header, dissents from the first one after it; empty ones have no row."""
    b = _positions(texts)
    ends = b.groupBy("doc_id").agg((F.max("k") + 1).alias("n"), F.min(F.when(F.col("b").rlike(DECISION), F.col("k"))).alias("d"))
    first = b.join(ends, "doc_id").where(F.col("b").rlike(DISSENT) & (F.col("k") >= F.col("d"))).groupBy("doc_id").agg(F.min("k").alias("s"))
    j = ends.join(first, "doc_id", "left")
    parts = F.array(F.struct(F.lit("cuerpo").alias("seccion"), F.lit(0).alias("desde"), F.coalesce("d", "n").alias("hasta")), F.struct(F.lit("resuelve").alias("seccion"), F.col("d").alias("desde"), F.coalesce("s", "n").alias("hasta")), F.struct(F.lit("salvamentos").alias("seccion"), F.col("s").alias("desde"), F.col("n").alias("hasta")))
    return j.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.*").where("desde is not null and desde < hasta")


def authors(texts: DataFrame, near: int = 4) -> DataFrame:
    """``(doc_id, k, nombre)``: who wrote a judgment, named on the author's line or on the lines right behind it, at most ``near`` and none between them."""
    own, doctor = F.regexp_extract("b", AUTHOR, 1), F.col("b").rlike(DOCTOR)
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    b = _positions(texts).withColumn("is", F.col("b").rlike(AUTHOR))
    run = b.withColumn("last", F.max(F.when(F.col("is"), F.col("k"))).over(w)).withColumn("other", F.sum((~F.col("is") & ~doctor).cast("int")).over(w))
    base = run.where("is").select("doc_id", F.col("k").alias("last"), F.col("other").alias("before"))
    behind = run.where(doctor & ~F.col("is")).join(base, ["doc_id", "last"]).where((F.col("k") - F.col("last") <= near) & (F.col("other") == F.col("before")))
    named = run.where(F.col("is") & (F.trim(own) != "")).select("doc_id", "k", F.trim(own).alias("nombre"))
    return named.unionByName(behind.select("doc_id", "k", F.initcap(F.trim(F.regexp_replace(F.regexp_extract("b", DOCTOR, 1), r"\s+", " "))).alias("nombre")))
