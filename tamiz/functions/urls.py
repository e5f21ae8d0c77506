"""Addresses as Column expressions: identity of a norm, host, source, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import fold


def host(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i)(?:https?://)?([^/?#:\s]+)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Identity of the norm behind an address.

    Scheme, ``www.``, fragment, extension and leading zeros are ignored. A path that names a norm (``ley_8518_1961``,
    ``ley-8518-1961``) gives ``ley_8518_1961``; any other gives host and path, with the query where there is one.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"#.*$", ""), r"^https?://(www\.)?", "")
    norm = r"(ley|decreto|resolucion|acuerdo|circular|sentencia|auto)[_-]0*(\d+)[_-](\d{4})"
    named = F.concat_ws("_", F.regexp_extract(plain, norm, 1), F.regexp_extract(plain, norm, 2), F.regexp_extract(plain, norm, 3))
    generic = F.regexp_replace(F.regexp_replace(plain, r"\.(html?|pdf|docx?|php|jsp)$", ""), r"/$", "")
    return F.when(F.length(F.regexp_extract(plain, norm, 1)) > 0, named).otherwise(generic)


def is_normative_host(url: Column, names: list[str]) -> Column:
    """Whether the host contains one of the names."""
    h = host(url)
    test = F.lit(False)
    for n in names:
        test = test | h.contains(n)
    return test


def looks_odd(url: Column) -> Column:
    """Addresses of searches, logins and sessions, which hold no norm."""
    return F.coalesce(F.lower(url).rlike(r"(login|session|sesion|buscar|search|captcha)"), F.lit(False))


def norm_type(title: Column) -> Column:
    """Type of norm that a title begins with; ``otro`` where it names none."""
    low = F.lower(fold(title))
    found = F.regexp_extract(low, r"^\s*(ley|decreto|resolucion|acuerdo|circular|sentencia|auto|codigo)\b", 1)
    return F.when(F.length(found) > 0, found).otherwise(F.lit("otro"))


def norm_id(kind: Column, number: Column, year: Column) -> Column:
    """``tipo_numero_anio``; leading zeros of a number of figures only are dropped; null where the kind is null."""
    n = F.when(number.rlike(r"^\d+$"), F.regexp_replace(number, r"^0+(?=\d)", "")).otherwise(F.lower(number))
    return F.when(kind.isNotNull(), F.concat_ws("_", F.lower(fold(kind)), n, year.cast("string")))


def judgment_url(base: str, kind: Column, number: Column, year: Column) -> Column:
    """Address of a judgment: kind, number with three figures at least, two figures of the year."""
    return F.concat(F.lit(base), F.format_string("%s-%03d-%02d.htm", F.lower(kind), number.cast("int"), F.pmod(year, F.lit(100)).cast("int")))


def outlinks(html: Column) -> Column:
    """Addresses of the anchors of a page, in order, script and mail links left out."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    return F.filter(found, lambda x: (x != "") & ~x.rlike(r"(?i)^(javascript|mailto|#)"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))
