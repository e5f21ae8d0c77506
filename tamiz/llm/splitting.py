"""Splitting oversized spans at natural boundaries by pointer doubling.

Every gap between two words of a span is a boundary. Each boundary, taken as the end of a piece, points to the end of
the next piece: the farthest legal one, given that the next piece begins ``overlap`` words earlier. All spans of an
Arrow batch share one successor table; squaring it (``s = s[s]``) while marking what the marked boundaries reach
derives all greedy cuts of all spans in as many steps as the logarithm of the largest number of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERLAP = 30
_TOKEN = re.compile(r"\S+")
_END = re.compile(r"[.!?…。]['\"»”’)\]]*$")
_CLAUSE = re.compile(r"[;:,]['\"»”’)\]]*$")
# fixed values: words after whose point a sentence goes on
_ABBREVIATIONS = frozenset("art arts núm num nro no lit inc par pág págs cfr exp fl fls sr sra dr dra ej vto t vol cap ed etc ss p pp v".split())


def kept_spans(text: str) -> list[tuple[int, int]]:
    """Parts of a text outside struck runs: from one ``~~`` to the next, or to the end."""
    parts, at = [], 0
    while (a := text.find("~~", at)) >= 0:
        parts.append((at, a))
        b = text.find("~~", a + 2)
        if b < 0:
            return parts
        at = b + 2
    parts.append((at, len(text)))
    return parts


def words_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whitespace-separated words of the text that is not struck, with their first and last offsets in the text."""
    if "~~" not in text:
        found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        return [w for w, _, _ in found], np.array([a for _, a, _ in found], np.int64), np.array([b for _, _, b in found], np.int64)
    parts = kept_spans(text)
    kept = "".join(text[a:b] for a, b in parts)
    where = np.concatenate([np.arange(a, b) for a, b in parts]) if kept else np.empty(0, np.int64)
    found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(kept)]
    return [w for w, _, _ in found], where[[a for _, a, _ in found]] if found else where[:0], where[[b - 1 for _, _, b in found]] + 1 if found else where[:0]


def _sentence_end(word: str, following: str) -> bool:
    if not _END.search(word):
        return False
    bare = word.strip("\"'«»“”‘’()[]").rstrip(".").lower()
    if word.rstrip("\"'»”’)]").endswith(".") and (bare in _ABBREVIATIONS or len(bare) == 1 or "." in bare):
        return False
    first = following.lstrip("\"'«“‘([¿¡")[:1]
    return not first or not first.islower()


def boundary_classes(text: str, words: list[str], first: np.ndarray, last: np.ndarray, block_ends: np.ndarray | None) -> np.ndarray:
    """Class of the boundary after each number of words: 3 paragraph, 2 sentence, 1 clause, 0 any word."""
    n = len(words)
    cls = np.zeros(n + 1, np.int8)
    for i in range(1, n):
        w = words[i - 1]
        if _sentence_end(w, words[i]):
            cls[i] = 2
        elif _CLAUSE.search(w):
            cls[i] = 1
    ends = np.array([m.start() for m in re.finditer(r"\n[^\S\n]*\n", text)] if block_ends is None else block_ends, np.int64)
    if n and len(ends):
        at = np.searchsorted(first, ends)  # words that begin before the block's end
        at = at[(at > 0) & (at < n)]
        cls[at[last[at - 1] <= first[at]]] = 3
    cls[n] = 3
    return cls


def successors(cls: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For each boundary as the end of a piece, the end of the next piece."""
    n = len(cls) - 1
    b = np.arange(n + 1)
    start = np.where(b == 0, 0, np.maximum(b - overlap, 0))
    far = np.minimum(start + limit, n)
    nxt = far.copy()
    open_ = far < n
    least = np.maximum(b, start + limit // 2)
    for c in (3, 2, 1):
        seen = np.maximum.accumulate(np.where(cls >= c, b, -1))[far]
        hit = open_ & (seen > least)
        nxt[hit] = seen[hit]
        open_ &= ~hit
    return nxt


def doubled(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Marks all that the roots reach, squaring the table until nothing moves."""
    marks = np.zeros(len(successor), bool)
    marks[roots] = True
    while True:
        reached = marks.copy()
        reached[successor[marks]] = True
        squared = successor[successor]
        if (reached == marks).all() and (squared == successor).all():
            return marks
        marks, successor = reached, squared


def _cut_batch(batch: pd.DataFrame, overlap: int) -> pd.DataFrame:
    out: list[tuple] = []
    big = []
    for row in batch.itertuples(index=False):
        words, first, last = words_of(row.tramo)
        if len(words) <= row.limite:
            out.append((row.tramo_id, 0, row.inicio, row.inicio + len(row.tramo), len(words), len(words)))
        else:
            ends = None if row.fines is None else np.asarray(row.fines, np.int64) - row.inicio
            cls = boundary_classes(row.tramo, words, first, last, ends)
            big.append((row, first, last, successors(cls, int(row.limite), overlap)))
    if big:
        base = np.cumsum([0] + [len(s) for *_, s in big])
        whole = np.concatenate([s + o for (*_, s), o in zip(big, base)])
        marks = doubled(whole, base[:-1])
        for (row, first, last, s), o in zip(big, base):
            cuts = np.flatnonzero(marks[o : o + len(s)])
            n = len(s) - 1
            for k, (b, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                start = max(b - overlap, 0) if b else 0
                a = row.inicio + int(first[start]) if b else row.inicio
                z = row.inicio + (len(row.tramo) if e == n else int(last[e - 1]))
                out.append((row.tramo_id, k, a, z, int(e - start), n))
    return pd.DataFrame(out, columns=["tramo_id", "k", "inicio", "fin", "palabras", "palabras_tramo"])


def split_spans(spans: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``(tramo_id, k, inicio, fin, palabras, palabras_tramo)`` of ``(tramo_id, inicio, limite, tramo, fines)``.

    ``tramo`` is the span's text, ``inicio`` its offset, ``limite`` its limit of words and ``fines`` the offsets where
    paragraphs end (null: at blank lines). Every piece has at most ``limite`` words, consecutive pieces share
    ``overlap`` words, and the pieces cover the whole span. A span within its limit is one piece; an empty one is one
    piece of no words; rows with a null id, text or limit are left out; a ``limite`` that does not exceed ``overlap`` raises. Spans are
    independent of one another, so a document with any share of all spans is spread over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _cut_batch(batch, overlap)

    ready = spans.where("tramo_id is not null and tramo is not null and limite is not null").select("tramo_id", F.coalesce("inicio", F.lit(0)).cast("int").alias("inicio"), F.when(F.col("limite") > overlap, F.col("limite")).otherwise(F.raise_error(F.lit(f"a limit must exceed the overlap of {overlap} words")).cast("int")).cast("int").alias("limite"), "tramo", "fines")
    return ready.mapInPandas(run, "tramo_id bigint, k int, inicio int, fin int, palabras int, palabras_tramo int")


def norm_spans(partir: DataFrame, normas: DataFrame, leer: DataFrame) -> DataFrame:
    """Spans of ``partir``, each once (the latest version), with text, limit and the ends of its article's paragraphs.

    A null ``fin`` becomes the end of the article's last block, or of the text where there is no article; a null
    ``palabras_encabezado`` counts as 0. Spans of documents without text are left out.
    """
    cols = ["doc_id", "art_id", "inicio", "fin", "palabras_encabezado"]
    once = partir.where("tramo_id is not null").groupBy("tramo_id").agg(F.max_by(F.struct(*cols), F.struct("actualizado", *cols)).alias("r")).select("tramo_id", "r.*")
    ends = normas.where("art_id is not null").select("art_id", F.col("bloques.fin").alias("fines")).groupBy("art_id").agg(F.max("fines").alias("fines"))
    texts = leer.where("doc_id is not null").groupBy("doc_id").agg(F.max_by("texto", F.struct("leido", "texto")).alias("texto"))
    j = once.join(ends, "art_id", "left").join(texts, "doc_id")
    inicio = F.greatest(F.coalesce("inicio", F.lit(0)), F.lit(0))
    fin = F.coalesce("fin", F.array_max("fines"), F.length("texto"))
    return j.select("tramo_id", "doc_id", inicio.alias("inicio"), F.greatest(F.lit(50), F.lit(297) - F.coalesce("palabras_encabezado", F.lit(0))).alias("limite"), F.substring("texto", inicio + 1, F.greatest(fin - inicio, F.lit(0))).alias("tramo"), "fines")
