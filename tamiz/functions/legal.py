"""Sentences of legal texts as Column expressions, with offsets: no end behind abbreviations, ordinals or within notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.text import strip_struck, word_count

# fixed values: abbreviations whose point ends no sentence
ABBREVIATIONS = (
    "art arts num nums inc incs lit lits par no nro núm dr dra drs sr sra mp p pp pág págs cfr vid ss ibíd ibid op cit etc ltda cía cia s.a d.c c.p c.c c.co c.p.p c.s.t e.t m.p ord dto dcto res exp rad gral admón lib tít cap sent "
    "aprox ej fl fls vol"
).split()
_ABBR = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
#: Patterns whose last point becomes a placeholder of the same length, one after another: (pattern, what stands before, what behind).
VETOES = [
    rf"(?i)((?:^|[^\p{{L}}\p{{N}}_.])\.*(?:{_ABBR}|(?:[a-záéíóúñ]\.)*[a-záéíóúñ]))\.",
    r"((?:^|[^\p{L}\p{N}_.])(?:\d{4,}[oº]?|\d{3}[oº]))\.",
    r"(\s\s\d\d|\s\s\s\d|\s\s\d[oº]|\s\d\d\d|\s\d\d[oº])\.",
    r"(^\s*\d{1,3}[oº]?)\.",
    r"(?i)(\bart[íi]culo\s+\S+)\.",
]
PROTECTED = r"(?s)(\{\{.*?\}\}|~~.*?~~|[^{~]+|[{~])"
CANDIDATE = r"""([.!?;][”")\]]*\s+)(\{\{|["“(¿¡]?[A-ZÁÉÍÓÚÑ0-9])"""
HIDDEN, MARKS, CUT = "\u0001\u0002\u0003\u0004", ".!?;", "\u0006"
#: Words by which a sentence names a norm.
MENTION = r"(?i)\b(?:ley|decreto|resoluci[óo]n|acuerdo|circular|sentencia|auto|c[óo]digo|constituci[óo]n)\b"


def names_norm(c: Column) -> Column:
    """Whether a sentence names a norm."""
    return c.rlike(MENTION.replace("(?i)", "(?iu)"))


def _masked(c: Column) -> Column:
    """The text with marks that end no sentence as placeholders; its length stays."""
    spans = F.regexp_extract_all(c, F.lit(PROTECTED), 1)
    t = F.array_join(F.transform(spans, lambda x: F.when(x.startswith("{{") | x.startswith("~~"), F.translate(x, MARKS, HIDDEN)).otherwise(x)), "")
    for pattern in VETOES:
        t = F.regexp_replace(t, pattern.replace("(?i)", "(?iu)"), "$1\u0001")
    return t


def sentence_parts(c: Column) -> Column:
    """Consecutive parts of a text, a sentence with the blanks behind it each; nothing is lost, null and empty texts give none."""
    cut = F.regexp_replace(_masked(F.coalesce(c, F.lit(""))), CANDIDATE, f"$1{CUT}$2")
    return F.filter(F.transform(F.split(cut, CUT), lambda x: F.translate(x, HIDDEN, MARKS)), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences of a text without the blanks behind them."""
    return F.filter(F.transform(sentence_parts(c), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def sentence_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, k, inicio, fin, texto)``: the sentences of ``(key, text)`` with 0-based, half-open offsets.

    ``key`` is unique. Null, empty and blank texts have none. Offsets are running sums within a text, so a text of any
    length is linear; nothing but its parts moves to the sum.
    """
    parts = docs.select(key, F.posexplode(sentence_parts(F.col(text))).alias("k", "p"))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("p")).over(before), F.lit(0)).cast("int")
    kept = F.regexp_replace("p", r"\s+$", "")
    return parts.select(key, "k", start.alias("inicio"), kept.alias("texto")).where("texto != ''").select(key, "k", "inicio", (F.col("inicio") + F.length("texto")).alias("fin"), "texto")


def shortened(c: Column, most_sentences: int, most_words: int) -> Column:
    """The first whole sentences within both limits; where the first has too many words, its first ones and a point."""
    parts = F.slice(sentences(c), 1, most_sentences)
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, x: acc + word_count(x)))
    fit = F.size(F.filter(sums, lambda n: n <= most_words))
    first = F.array_join(F.slice(F.split(F.trim(parts[0]), r"\s+"), 1, most_words), " ")
    return F.when(F.size(parts) == 0, F.lit("")).when(fit > 0, F.array_join(F.slice(parts, F.lit(1), fit), " ")).otherwise(F.concat(F.regexp_replace(first, r"[\s.,;:]+$", ""), F.lit(".")))


def clause_parts(c: Column) -> Column:
    """Consecutive parts of a sentence behind ``;`` or ``:`` and blanks; nothing is lost."""
    return F.filter(F.split(F.regexp_replace(c, r"([;:]\s+)", f"$1{CUT}"), CUT), lambda x: x != "")


def word_parts(c: Column, n: int) -> Column:
    """Consecutive parts of ``n`` words with the blanks behind them, the last one shorter."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(\s*(?:\S+\s*){{1,{n}}})"), 1)


def standing_words(c: Column) -> Column:
    """Number of words of a text without its struck parts."""
    return word_count(strip_struck(c))


def _level(pieces: DataFrame, parts: Column, budget: int, forced: bool) -> DataFrame:
    """Pieces above the budget cut into their parts; the others stay."""
    over = standing_words(F.col("texto")) > budget
    cut = pieces.select("*", F.posexplode(F.when(over, parts).otherwise(F.array("texto"))).alias("n", "p"), over.alias("over"))
    before = Window.partitionBy("art_id", "bloque", "inicio").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("inicio") + F.coalesce(F.sum(F.length("p")).over(before), F.lit(0)).cast("int")
    kept = F.when(F.col("over"), F.regexp_replace("p", r"\s+$", "")).otherwise(F.col("p"))
    return cut.select("art_id", "bloque", at.alias("at"), kept.alias("q"), (F.col("forzado") | (F.col("over") & F.lit(forced))).alias("forzado")).where("trim(q) != ''").select("art_id", "bloque", F.col("at").alias("inicio"), F.col("q").alias("texto"), "forzado")


def pieces(blocks: DataFrame, budget: int) -> DataFrame:
    """``(art_id, bloque, inicio, fin, forzado)``: blocks cut until none has more than ``budget`` standing words.

    ``blocks`` is ``(art_id, bloque, inicio, texto)``. A block within the budget stays whole, else its sentences are
    taken, of those too long the clauses, of those the words; the last two are marked as forced.
    """
    p = blocks.where("texto is not null and trim(texto) != ''").select("art_id", "bloque", "inicio", "texto", F.lit(False).alias("forzado"))
    p = _level(p, sentence_parts(F.col("texto")), budget, False)
    p = _level(p, clause_parts(F.col("texto")), budget, True)
    p = _level(p, word_parts(F.col("texto"), budget), budget, True)
    return p.select("art_id", "bloque", "inicio", (F.col("inicio") + F.length("texto")).alias("fin"), "forzado")
