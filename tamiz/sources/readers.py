"""Readers of documents, lists, banks and checkpoints; every schema is explicit."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamiz.session import cut

ITEM = "id bigint, formato string, pregunta string, opciones map<string,string>, area string, tema string, sub_tarea string, complejidad string, legal_basis string, respuesta_correcta string, respuesta_esperada string"
FRONT = "doc_id string, titulo string, url string, fuente string, tipo_norma string, numero string, anio int, areas array<string>, origen string, estado string"
TARGET = "doc_id string, url string, tipo string, areas array<string>, peso double"


def front_matter(text: str) -> dict[str, object]:
    """Fields of a header in the common subset of YAML: ``key: value``, quoted values, lists in brackets or as lines with a dash, maps one level deep, comments; JSON is part of it."""
    text = text.strip()
    if text.startswith("{"):
        return json.loads(text)
    out: dict[str, object] = {}
    key = None
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and key is not None:
            held = out.get(key)
            out[key] = [*(held if isinstance(held, list) else []), _scalar(bare[2:])]
        elif line[:1].isspace() and key is not None and ":" in bare:
            held = out.get(key)
            k, _, v = bare.partition(":")
            out[key] = {**(held if isinstance(held, dict) else {}), _plain(k): _scalar(v)}
        elif ":" in bare:
            k, _, v = bare.partition(":")
            key = _plain(k)
            out[key] = _scalar(v)
    return out


def _plain(v: str) -> str:
    v = v.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def _scalar(v: str) -> object:
    v = v.strip()
    if v.startswith("[") and v.endswith("]"):
        return [_plain(x) for x in re.findall(r"""\s*("[^"]*"|'[^']*'|[^,\[\]]+)""", v[1:-1]) if x.strip()]
    if v[:1] not in ("\"", "'"):
        v = re.sub(r"\s+#.*$", "", v)
    v = _plain(v)
    return None if v in ("", "null", "~") else v


_TEXTS = [f.split()[0] for f in FRONT.split(", ") if f.endswith(" string")]


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, meta, cuerpo, path)`` of Markdown files with front matter; the file's name stands in for a missing id.

    The header is YAML or JSON. The body is cleaned line by line; broken lines are joined only where the text comes from
    pages (a judgment, or pages among ``formato_origen``). A file without a header, or with a broken one, has no meta.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, where in zip(batch["value"], batch["path"]):
                m = re.match(r"---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\Z)", value or "", re.S)
                try:
                    meta = front_matter(m.group(1)) if m else None
                except ValueError:
                    meta = None
                row = None
                if meta:
                    year = str(meta.get("anio") or "")
                    areas = meta.get("areas")
                    row = {k: None if meta.get(k) is None else str(meta[k]) for k in _TEXTS} | {"anio": int(year) if year.isdigit() else None, "areas": None if areas is None else [str(x) for x in (areas if isinstance(areas, list) else [areas])]}
                kind = f"{(meta or {}).get('tipo_norma')} {(meta or {}).get('formato_origen')}".lower()
                out.append((row, (value or "")[m.end() :] if m else value or "", "sentencia" in kind or "pdf" in kind, where))
            yield pd.DataFrame(out, columns=["meta", "cuerpo", "paginas", "path"])

    read = files.mapInPandas(run, f"meta struct<{FRONT.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>, cuerpo string, paginas boolean, path string")
    joined = F.when(F.col("paginas"), F.regexp_replace("cuerpo", r"(?<![.:;?!\n])\n(?=[a-záéíóúñü])", " ")).otherwise(F.col("cuerpo"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return read.select(F.coalesce("meta.doc_id", stem).alias("doc_id"), "meta", joined.alias("cuerpo"), "path")


def split_parts(docs: DataFrame, text: str = "cuerpo") -> DataFrame:
    """``(doc_id, k, archivo, url, texto, inicio)``: parts marked ``<!-- parte F | URL -->``, with their offsets when joined by blank lines."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"<!--\s*parte\s+(.*?)\s*\|\s*(.*?)\s*-->\n?", "\u0001$1\u0002$2\u0003")
    parts = docs.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("k", "p"))
    body = F.btrim(F.regexp_replace("p", "(?s)^.*?\u0003", ""), F.lit("\n"))
    cut = parts.select("doc_id", "k", F.nullif(F.regexp_extract("p", "(?s)^(.*?)\u0002", 1), F.lit("")).alias("archivo"), F.nullif(F.regexp_extract("p", "(?s)\u0002(.*?)\u0003", 1), F.lit("")).alias("url"), body.alias("texto")).where("texto != ''")
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("inicio", F.coalesce(F.sum(F.length("texto") + 2).over(before), F.lit(0)).cast("int"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, n)``: lines of text files with what orders them as they stand, by file, then by block, then within the block.

    Tasks take blocks in any order and several at a time; within a block lines are read in turn, so their running number
    is in order there and nowhere else.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", at.alias("n"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(seccion, clave, valor)`` of an alias file with one map or list for each section; lists have their places as keys."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file of settings
    rows = []
    for section, held in front_matter(text).items():
        pairs = held.items() if isinstance(held, dict) else enumerate(held if isinstance(held, list) else [held])
        rows += [(section, str(k), None if v is None else str(v)) for k, v in pairs]
    return spark.createDataFrame(rows, "seccion string, clave string, valor string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a manifest (one JSON array), the last of each ``doc_id``."""
    raw = spark.read.schema(FRONT).json(path, multiLine=True).withColumn("__n", F.monotonically_increasing_id())
    return raw.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in raw.columns if c not in ("doc_id", "__n")]), "__n").alias("r")).select("doc_id", "r.*")


def page_chains(pages: DataFrame, longest: int = 300) -> DataFrame:
    """``(page, head, place)`` of ``(page, next, base)``: pages that follow one another within one base document, by pointer doubling.

    A link to another base ends the chain; pages of a cycle, and those more than ``longest`` behind their head, have no
    row. The number of rounds is the logarithm of ``longest``; every round joins the pages once with themselves.
    """
    known = pages.where("page is not null").select("page", "next", "base")
    back = known.join(known.select(F.col("page").alias("next"), F.col("base").alias("nbase")), "next").where("base = nbase").groupBy("next").agg(F.min("page").alias("prev")).withColumnRenamed("next", "page")
    state = cut(known.select("page").distinct().join(back, "page", "left").select("page", F.coalesce("prev", "page").alias("up"), F.col("prev").isNotNull().cast("int").alias("steps"), F.col("prev").isNull().alias("done")))
    span = 1
    while span < longest:
        up = state.select(F.col("page").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("done").alias("d2"))
        state = cut(state.join(up, "up").select("page", F.when(F.col("done"), F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("s2")).alias("steps"), (F.col("done") | F.col("d2")).alias("done")))
        span *= 2
    return state.where(F.col("done") & (F.col("steps") < longest)).select("page", F.col("up").alias("head"), F.col("steps").alias("place"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are none; a line cut off is kept in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def checkpoint(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The last whole line of each key of an append-only JSON-lines file."""
    lines = numbered_lines(spark, path).withColumnRenamed("n", "__n").withColumn("r", F.from_json("value", schema)).where(F.col(f"r.{key}").isNotNull())
    whole = lines.where(F.col("value").rlike(r"\}\s*$"))
    w = Window.partitionBy(F.col(f"r.{key}")).orderBy(F.desc("__n"))
    return whole.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("r.*")


def bank(spark: SparkSession, path: str, archived: bool = False) -> DataFrame:
    """Items of a bank with two lists; of those, approved ones unless archived are wanted too; adds ``formato``, ordered by it and id."""
    item = "struct<id:bigint,pregunta:string,estado:string,respuesta:string>"
    raw = spark.read.schema(f"cerradas array<{item}>, abiertas array<{item}>").json(path, multiLine=True)
    part = lambda c, f: raw.select(F.explode(c).alias("i")).select("i.*", F.lit(f).alias("formato"))
    both = part("cerradas", "multiple_choice").unionByName(part("abiertas", "open_ended"))
    return (both if archived else both.where("estado = 'approved'")).orderBy("formato", "id")


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """``(n, url)``: addresses of a list, comments behind `` #`` dropped, first of each kept; anything else raises."""
    lines = numbered_lines(spark, path)
    url = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    rows = lines.select("n", url.alias("url")).where("url != ''")
    checked = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.raise_error(F.concat(F.lit("no address: "), "url")))
    return rows.select("n", checked.alias("url")).groupBy("url").agg(F.min("n").alias("n"))


def csv_above(spark: SparkSession, path: str, schema: str, column: str, least: int) -> DataFrame:
    """Rows of a CSV file above a threshold, largest first."""
    return spark.read.schema(schema).option("header", True).csv(path).where(F.col(column) > least).orderBy(F.desc(column))


def targets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid targets, the last file's version of each id, heaviest first; and the rows that break a rule, with the rules."""
    union = None
    for n, p in enumerate(paths):
        part = spark.read.schema(TARGET).json(p, multiLine=True).withColumn("__file", F.lit(n))
        union = part if union is None else union.unionByName(part)
    errors = F.filter(F.array(F.when(~F.coalesce(F.col("doc_id").rlike("^[a-z0-9_.-]+$"), F.lit(False)), F.lit("doc_id")), F.when(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), F.lit("url")), F.when(F.col("areas").isNull(), F.lit("areas"))), lambda e: e.isNotNull())
    marked = union.withColumn("errores", errors)
    w = Window.partitionBy("doc_id").orderBy(F.desc("__file"), F.desc("peso"))
    good = marked.where(F.size("errores") == 0).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__file", "errores").orderBy(F.desc("peso"), "doc_id")
    return good, marked.where(F.size("errores") > 0).drop("__file")


def first_found(frames: list[DataFrame], key: str, value: object) -> DataFrame:
    """Row with a key from the first of several sources that has it."""
    union = None
    for n, f in enumerate(frames):
        part = f.where(F.col(key) == value).withColumn("__n", F.lit(n))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union.orderBy("__n").limit(1).drop("__n")


def sniff(content: Column) -> Column:
    """Format of bytes by their first ones: pdf, docx, doc or html."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "docx").when(head.startswith("D0CF11E0"), "doc").otherwise("html")


def mended(text: str) -> str:
    """Text whose UTF-8 bytes had been read with Windows-1252 put right, where all of it fits; else the text as it is."""
    if not re.search("[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]", text):
        return text
    try:
        return text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text


@F.pandas_udf(StringType())
def decoded(content: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of bytes by the announced encoding, that of a ``meta`` tag, UTF-8 where it fits, else Windows-1252."""

    def one(b: bytes | None, kind: str | None) -> str | None:
        if b is None:
            return None
        names = [m.group(1) for m in [re.search(r"charset=[\"']?([\w-]+)", kind or "")] if m]
        names += [m.group(1).decode() for m in [re.search(rb"charset=[\"']?([\w-]+)", b[:2000])] if m]
        for n in [*names, "utf-8"]:
            n = "cp1252" if n.lower() in ("iso-8859-1", "latin-1", "latin1") else n
            try:
                return mended(b.decode(n))
            except (UnicodeDecodeError, LookupError):
                continue
        return mended(b.decode("cp1252", "replace"))

    return pd.Series([one(b, k) for b, k in zip(content, content_type)])


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file with tabs and breaks, its notes behind them."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml"):
            if name not in z.namelist():
                continue
            for p in ElementTree.fromstring(z.read(name)).iter(f"{w}p"):
                s = "".join(x.text or "" if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else "" for x in p.iter())
                if s.strip():
                    out.append(s.strip())
    return "\n\n".join(out)


@F.pandas_udf(StringType())
def docx_markdown(content: pd.Series) -> pd.Series:
    """Text of DOCX bytes; null for null and for bytes that are none."""

    def one(b: bytes | None) -> str | None:
        try:
            return docx_text(b) if b is not None else None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
            return None

    return pd.Series([one(b) for b in content])


def pages_by(transport: Callable[[str], dict], targets: DataFrame) -> DataFrame:
    """``(url, status, content, error)`` of ``(url)`` through a given transport, hosts kept together; a failure is a row, never an end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for u in batch["url"]:
                try:
                    r = transport(u)
                    out.append((u, r.get("status"), r.get("content"), None))
                except Exception as e:  # noqa: BLE001 - any failure of a transport is data here
                    out.append((u, None, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "status", "content", "error"]).astype({"status": "Int32"})

    hosts = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return targets.select("url").repartition(hosts).mapInPandas(run, "url string, status int, content binary, error string")


def first_success(tries: DataFrame, key: str) -> DataFrame:
    """Of the alternatives ``(key, ord, status, length, ...)`` the first that was found and is not nearly empty."""
    good = tries.where("status = 200 and length >= 1500")
    cols = [c for c in tries.columns if c != key]
    return good.groupBy(key).agg(F.min_by(F.struct(*cols), "ord").alias("r")).select(key, "r.*")


def scan_is_unreadable(text: Column, pages: Column) -> Column:
    """Whether a PDF's text layer should be read again from its images: under 100 characters a page, or over 2 % odd ones."""
    n = F.length(text)
    odd = n - F.length(F.regexp_replace(text, r"[^\x09\x0A\x20-\x7EÀ-ÿ“”‘’–—…]", ""))
    return (n / F.greatest(pages, F.lit(1)) < 100) | (odd > 0.02 * n)
