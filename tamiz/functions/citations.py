"""Citations of norms as Column expressions, and their canonical ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import fold

# fixed values: numbered norms that are known as codes; a law's number alone decides, whatever year is given
ALIASES = {
    "ley_599": "codigo_penal", "ley_906": "codigo_procedimiento_penal", "ley_1564": "codigo_general_proceso", "ley_1437": "codigo_administrativo", "ley_1098": "codigo_infancia", "ley_1801": "codigo_policia",
    "ley_1952": "codigo_disciplinario", "ley_1480": "estatuto_consumidor", "decreto_624": "estatuto_tributario",
}
# fixed values: names of codes, longest first within a code
CODE_NAMES = {
    "codigo_penal": ["codigo penal"], "codigo_procedimiento_penal": ["codigo de procedimiento penal"], "codigo_general_proceso": ["codigo general del proceso", "c.g.p."], "codigo_administrativo": ["codigo de procedimiento administrativo", "cpaca"],
    "codigo_civil": ["codigo civil"], "codigo_comercio": ["codigo de comercio"], "codigo_trabajo": ["codigo sustantivo del trabajo"], "constitucion": ["constitucion politica", "carta politica"], "estatuto_tributario": ["estatuto tributario"],
}
KINDS = "ley|decreto|resolucion|acuerdo|circular|sentencia|auto"
_NUMBERED = rf"\b({KINDS})\s+(?:no\.?\s*)?(\d+)\s+de\s+(\d{{4}})"
_ARTICLE = rf"\bart(?:iculo|\.)\s+(\d+[a-z]?)\s+(?:de\s+(?:la|el)\s+|del\s+)({KINDS})\s+(?:no\.?\s*)?(\d+)\s+de\s+(\d{{4}})"
_BEFORE = rf"\b({KINDS})\s+(?:no\.?\s*)?(\d+)\s+de\s+(\d{{4}}),\s+art(?:iculo|\.)\s+(\d+[a-z]?)"
_JUDGMENT = r"\b(c|t|su)-(\d+)(?:\s+de\s+(\d{4})|/(\d{2}))"


def _plain(c: Column) -> Column:
    return F.lower(fold(c))


def _zeros(n: Column) -> Column:
    return F.regexp_replace(n, r"^0+(?=\d)", "")


def _aliased(ids: Column) -> Column:
    """Ids of an array with numbered codes by their names; the article, behind ``#``, stays."""

    def one(x: Column) -> Column:
        chain = None
        for key, code in ALIASES.items():
            hit, to = x.rlike(f"^{key}_"), F.concat(F.lit(code), F.regexp_extract(x, "#.*$", 0))
            chain = F.when(hit, to) if chain is None else chain.when(hit, to)
        return chain.otherwise(x)

    return F.transform(ids, one)


def bodies(c: Column) -> Column:
    """Distinct canonical ids of the norms a text names: numbered norms, judgments by code, codes by name; null texts name none."""
    plain = F.coalesce(_plain(c), F.lit(""))
    numbered = _aliased(F.transform(F.regexp_extract_all(plain, F.lit(_NUMBERED), 0), lambda x: F.concat_ws("_", F.regexp_extract(x, _NUMBERED, 1), _zeros(F.regexp_extract(x, _NUMBERED, 2)), F.regexp_extract(x, _NUMBERED, 3))))

    def judgment(x: Column) -> Column:
        y, short = F.regexp_extract(x, _JUDGMENT, 3), F.regexp_extract(x, _JUDGMENT, 4)
        year = F.when(F.length(y) > 0, y).when(short.cast("int") < 50, F.concat(F.lit("20"), short)).otherwise(F.concat(F.lit("19"), short))
        return F.concat(F.lit("sentencia_"), F.upper(F.regexp_extract(x, _JUDGMENT, 1)), F.lit("-"), _zeros(F.regexp_extract(x, _JUDGMENT, 2)), F.lit("_"), year)

    judgments = F.transform(F.regexp_extract_all(plain, F.lit(_JUDGMENT), 0), judgment)
    named = F.filter(F.array(*[F.when(plain.rlike(r"\b(" + "|".join(n.replace(".", r"\.") for n in names) + r")(?!\w)"), F.lit(code)) for code, names in CODE_NAMES.items()]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(numbered, judgments, named))


def articles(c: Column) -> Column:
    """Distinct ids ``body#art_N`` of the articles that are named with their numbered norm."""
    plain = F.coalesce(_plain(c), F.lit(""))
    after = F.transform(F.regexp_extract_all(plain, F.lit(_ARTICLE), 0), lambda x: F.concat(F.concat_ws("_", F.regexp_extract(x, _ARTICLE, 2), _zeros(F.regexp_extract(x, _ARTICLE, 3)), F.regexp_extract(x, _ARTICLE, 4)), F.lit("#art_"), F.upper(F.regexp_extract(x, _ARTICLE, 1))))
    before = F.transform(F.regexp_extract_all(plain, F.lit(_BEFORE), 0), lambda x: F.concat(F.concat_ws("_", F.regexp_extract(x, _BEFORE, 1), _zeros(F.regexp_extract(x, _BEFORE, 2)), F.regexp_extract(x, _BEFORE, 3)), F.lit("#art_"), F.upper(F.regexp_extract(x, _BEFORE, 4))))
    return F.array_distinct(_aliased(F.concat(after, before)))


def base(canon: Column) -> Column:
    """Id of the norm without its article."""
    return F.split(canon, "#")[0]


def is_judgment(canon: Column) -> Column:
    return canon.startswith("sentencia_")


def support(cited: Column, evidence: Column) -> Column:
    """Struct of the cited ids that the evidence holds, and of those it does not."""
    return F.struct(F.array_intersect(cited, evidence).alias("supported"), F.array_except(cited, evidence).alias("unsupported"))


def coverage(wanted: Column, found: Column) -> Column:
    """Share of the wanted ids that were found, to four places; null where none is wanted."""
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, found)) / F.size(wanted), 4))


# fixed values: names of the kinds of norms
KIND_NAMES = {"ley": "Ley", "decreto": "Decreto", "resolucion": "Resolución", "acuerdo": "Acuerdo", "circular": "Circular", "sentencia": "Sentencia", "auto": "Auto"}
_ENUMERATED = rf"\bart(?:iculo|iculos|s\.|\.)\s+(\d+[a-z]?(?:(?:\s*,\s*|\s+y\s+)\d+[a-z]?)*)\s+(?:de\s+(?:la|el)\s+|del\s+)({KINDS})\s+(\d+)\s+de\s+(\d{{4}})"


def readable(norm: Column) -> Column:
    """Name of a numbered norm (``ley_472_1998``: ``Ley 472 de 1998``); null unless reading the name gives that norm and no other."""
    parts = F.split(norm, "_")
    kind = F.lit(None).cast("string")
    for k, name in KIND_NAMES.items():
        kind = F.when(parts[0] == k, F.lit(name)).otherwise(kind)
    name = F.when(norm.rlike(r"^[a-z]+_\d+_\d{4}$"), F.concat(kind, F.lit(" "), F.get(parts, F.lit(1)), F.lit(" de "), F.get(parts, F.lit(2))))
    found = bodies(name)
    return F.when((F.size(found) == 1) & F.array_contains(found, norm), name)


def enumerated(c: Column) -> Column:
    """Distinct ids of the articles that are listed before their numbered norm."""
    plain = F.coalesce(_plain(c), F.lit(""))

    def one(x: Column) -> Column:
        body = F.concat_ws("_", F.regexp_extract(x, _ENUMERATED, 2), _zeros(F.regexp_extract(x, _ENUMERATED, 3)), F.regexp_extract(x, _ENUMERATED, 4))
        return F.transform(F.regexp_extract_all(F.regexp_extract(x, _ENUMERATED, 1), F.lit(r"(\d+[a-z]?)"), 1), lambda a: F.concat(body, F.lit("#art_"), F.upper(a)))

    return F.array_distinct(_aliased(F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(_ENUMERATED), 0), one))))


def bare(c: Column) -> Column:
    """Distinct codes that a text names by the number of their law alone; laws that are no code are not named so."""
    numbers = F.regexp_extract_all(F.coalesce(_plain(c), F.lit("")), F.lit(r"\bley\s+0*(\d+)"), 1)
    codes = F.transform(numbers, lambda n: F.concat(F.lit("ley_"), n, F.lit("_")))
    return F.array_distinct(F.filter(_aliased(codes), lambda x: ~x.startswith("ley_")))
