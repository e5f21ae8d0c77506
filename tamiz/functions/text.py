"""Text functions as Column expressions: folding, cleaning, counting, tokenising, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented letters and the letters they fold to
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

# fixed values: words the lexical index leaves out
INDEX_STOPWORDS = (
    "a al ante bajo con contra de del desde durante e el en entre hacia hasta la las le les lo los mediante o os para por que se segun sobre su sus tras u un una unas unos y ya este esta estos "
    "estas ese esa esos esas aquel aquella cual cuales como cuando donde quien quienes cuyo cuya es son sera seran ser fue han ha sido haber hay mas muy tambien otro otra otros otras dicho "
    "dicha dichos dichas mismo misma"
).split()
# fixed values: words that say nothing of a text's content
STOPWORDS = (
    "a al algo ante con contra cual cuales cuando de del desde donde el ella ellas ello ellos en entre era es esa esas ese eso esos esta estan estar este esto estos fue ha han hay la las le les lo "
    "los mas me mi muy no nos o otra otro para pero por porque que quien se si sin sobre su sus tambien tiene tienen un una unas uno unos y ya como ser son segun cada asi tal etc"
).split()
# fixed values: prefixes of judgments' numbers, with a hyphen, and those that also stand without one
COURTS, COURTS_BARE = "su|sl|sc|sp|stc|stl|ac|au|c|t", "su|sl|sc|sp|stc|stl"


def fold(c: Column) -> Column:
    """Without accents; letter case kept."""
    return F.translate(c, ACCENTED, FOLDED)


def normal(c: Column) -> Column:
    """Lower case, without accents, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    """ASCII identifier; ``doc`` where nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.length(s) > 0, s).otherwise(F.lit("doc"))


def strip_control(c: Column) -> Column:
    """Without control and format characters (line feed and tab stay), non-breaking spaces as spaces."""
    return F.regexp_replace(F.translate(c, " ", " "), r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def _line(x: Column) -> Column:
    for pattern, to in (
        (r"^\s*#{1,6}\s*", ""),
        (r"\*\*|__", ""),
        (r"<!--.*?-->", ""),
        (r"<([^<>\n]{3,})>", "{{$1}}"),
        (r"^[\s.,;:]+", ""),
        (r"[ \t]+", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def clean_lines(c: Column) -> Column:
    """Markdown marks, page comments and table rules removed line by line; never more than one blank line in a row."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*\|?[\s:|-]+\|[\s:|-]*$"))
    joined = F.array_join(F.transform(lines, _line), "\n")
    return F.btrim(F.regexp_replace(joined, r"\n{3,}", "\n\n"), F.lit(" \n"))


def strip_struck(c: Column) -> Column:
    """Without text between ``~~`` marks (an unclosed one runs to the end), single blanks, none before punctuation."""
    kept = F.regexp_replace(c, r"(?s)~~.*?(?:~~|$)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", " "), r" ([.,;:])", "$1"))


def words(c: Column) -> Column:
    """Whitespace-separated words; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """Tokens estimated from the number of characters: one for each 3.5, plus one."""
    return (F.floor(F.length(c) / F.lit(3.5)) + 1).cast("int")


def text_hash(c: Column) -> Column:
    """SHA-1 of the text in lower case with single blanks, so that layout makes no difference."""
    return F.sha1(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")).cast("binary"))


def long_text_hash(c: Column, least: int = 500) -> Column:
    """``text_hash`` of texts of at least ``least`` characters, else null."""
    return F.when(F.length(c) >= least, text_hash(c))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text, lower case, at least two characters."""
    found = F.regexp_extract_all(F.lower(fold(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.length(x) > 1)


#: What index tokens are made by, in turn.
LEGAL_RULES = [(rf"\b({COURTS_BARE})0{{0,4}}(\d{{2,5}})\b", "$1$2 $2"), (rf"\b({COURTS})\s?-\s?0{{0,4}}(\d{{1,5}})\b", "$1$2 $2"), (r"\b(\d+)[oº°]([^\p{L}\p{N}_]|$)", "$1$2")]


def legal_tokens(c: Column) -> Column:
    """Index tokens: numbers of judgments kept whole and apart (``C-355`` and ``SU355`` give ``c355 355``, ``su355 355``), ordinals as figures, no stop words."""
    low = F.lower(fold(c))
    for pattern, to in LEGAL_RULES:
        low = F.regexp_replace(low, pattern, to)
    found = F.coalesce(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))
    return F.filter(found, lambda x: ~x.isin(*INDEX_STOPWORDS) & (x != "_"))


def overlap_tokens(c: Column) -> Column:
    """Content tokens for measures of overlap: no stop words, at least two characters or a figure."""
    found = F.coalesce(F.regexp_extract_all(F.lower(fold(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS) & ((F.length(x) > 1) | x.rlike(r"^\d$")))


def content_words(c: Column, least: int = 4) -> Column:
    """Distinct folded words of at least ``least`` characters that are no stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) >= least) & ~x.isin(*STOPWORDS)))


def ngrams(ws: Column, n: int, sep: str = " ") -> Column:
    """Runs of ``n`` consecutive elements of an array of strings, joined; empty where it is shorter."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(n)), sep))


def ngram_hashes(ws: Column, n: int) -> Column:
    """64-bit hashes of the runs of ``n`` consecutive elements, in order: what is exploded and shuffled in place of the runs."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, F.lit(n))))


def simple_sentences(c: Column) -> Column:
    """Parts of a text after ``.``, ``!`` or ``?`` and white space; quick and approximate."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda x: x != "")


def clauses(c: Column) -> Column:
    """Parts of a text after ``;`` or ``:`` and white space, with their mark."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[;:])\s+"), lambda x: x != "")


def fixed_chunks(c: Column, size: int) -> Column:
    """The words of a text in groups of ``size``, the last one shorter."""
    ws = words(c)
    starts = F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(size)), " "))


def truncate_sentences(c: Column, most_sentences: int, most_words: int) -> Column:
    """The first whole sentences within both limits; where the first is too long, its first words and a point."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit("").alias("t"), F.lit(True).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        w = word_count(s)
        fits = acc["open"] & (acc["n"] < most_sentences) & (acc["w"] + w <= most_words)
        joined = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["t"], F.lit(" "), s))
        return F.struct((acc["n"] + fits.cast("int")).alias("n"), (acc["w"] + F.when(fits, w).otherwise(0)).alias("w"), F.when(fits, joined).otherwise(acc["t"]).alias("t"), fits.alias("open"))

    kept = F.aggregate(simple_sentences(c), empty, step, lambda acc: acc["t"])
    first = F.array_join(F.slice(words(c), 1, most_words), " ")
    return F.when(F.length(kept) > 0, kept).when(F.size(words(c)) > 0, F.concat(F.regexp_replace(first, r"[.,;:]+$", ""), F.lit("."))).otherwise(F.lit(""))


def is_upper_title(c: Column) -> Column:
    """A single line of at most 250 characters of whose letters over 80 % are capitals."""
    letters, capitals = F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return (F.length(c) <= 250) & (F.instr(c, "\n") == 0) & (letters > 0) & (capitals > F.lit(0.8) * letters)


def is_header_line(c: Column) -> Column:
    """A line that opens an article or a part of a norm."""
    return F.lower(fold(c)).rlike(r"^\s*#*\s*(articulo|art\.|capitulo|titulo|libro|seccion|paragrafo)\b")


def json_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a noisy text; null where there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.length(found) > 0, found)


def year4(y: Column) -> Column:
    """Years of two figures: below 50 in the 2000s, else in the 1900s; others as they are."""
    return F.when((y >= 0) & (y < 50), y + 2000).when((y >= 50) & (y < 100), y + 1900).otherwise(y)


def miles(n: Column) -> Column:
    """Whole number with points between thousands."""
    return F.translate(F.format_number(n, 0), ",", ".")


def dehyphenate(c: Column) -> Column:
    """Words broken by a hyphen at a line end joined again."""
    return F.regexp_replace(c, r"([a-záéíóúñ])-\n([a-záéíóúñ])", "$1$2")


def strip_tags(c: Column) -> Column:
    """HTML without scripts, styles and page furniture, then without tags; blanks collapsed."""
    for tag in ("script", "style", "nav", "header", "footer", "form", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))


def cyclic_orders(letters: Column, k: Column | int) -> Column:
    """The first ``k`` cyclic rotations of an array."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(letters)
    shifts = F.when(F.least(k, n) > 0, F.sequence(F.lit(0), F.least(k, n) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(shifts, lambda i: F.concat(F.slice(letters, i + 1, n), F.slice(letters, F.lit(1), i)))
