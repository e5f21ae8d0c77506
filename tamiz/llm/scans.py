"""Text of scanned and printed pages made into continuous paragraphs.

Running headers and page numbers go first. The rest is one stream of characters without lines: a dynamic programme
over it chooses words that explain the stream at least cost, where a word may be split by a space or a hyphen at a
line end, run together with the next, or misread by known confusions, and stray marks may stand between. Words and
their frequencies come from the parts that were not printed. A second dynamic programme over the lines chooses where
paragraphs begin.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct counts that a task holds before it passes them on.
_HELD = 200_000

# fixed values: what a scan reads, and what stood there
CONFUSIONS = [
    ("c", "e"), ("0", "o"), ("l", "i"), ("l", "í"), ("ri", "n"), ("ri", "ñ"), ("f", "t"), ("5", "s"), ("ii", "u"), ("cl", "d"), ("1", "l"), ("1", "i"),
    ("rn", "m"), ("9", "g"), ("6", "b"), ("6", "ó"), ("\\/", "v"), ("2", "z"), ("li", "h"), ("d", "cl"), ("fi", "ñ"), ("a'", "á"), ("e'", "é"), ("i'", "í"),
    ("o'", "ó"), ("u'", "ú"), ("'", ""), ("`", ""), ("´", ""), ("¦", ""), ("|", ""), ("|", "l"), ("·", ""), ("~", ""), ("^", ""), ("vv", "w"), ("8", "b"), ("4", "a"), ("3", "e"), ("b", "h"), ("nn", "m"), ("iii", "m"),
]
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))
_STRAY = set("¦|·~`'´^*_°•¬‐")
_HYPHENS = "-‐¬­"


def _garbled(mark: str) -> set[str]:
    """A hyphen as it looks when its bytes were read with a wrong encoding, once or twice."""
    out = set()
    for codec in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850"):
        once = mark.encode().decode(codec, "replace").replace("\ufffd", "\x90")
        out |= {once, once.encode().decode(codec, "replace").replace("\ufffd", "\x90"), once.encode().decode("latin-1")}
    return out


_GARBLED_HYPHENS = tuple(sorted({g for h in "‐¬\xad" for g in _garbled(h)}, key=len, reverse=True))
_TOKEN = re.compile(r"\S+")
_PAGE = re.compile(r"<!--\s*p[aá]gina\s+\d+\s*-->")
_STRONG = re.compile(r"(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|p[aá]?[gq]?(?:ina)?s?\.?\s*\d{1,4}(?:\s*(?:de|/)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4})", re.I)
_BARE = re.compile(r"\d{1,4}")
_GLYPHS = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")
_ROMAN = re.compile(r"[ivxlcdm]+")
_NUMBER = re.compile(r"[\d.,/°º:%$-]+[oaºª]?s?|\d+[a-z]?")
_EDGE = " \t\n.,;:()[]{}«»“”\"!¡?¿…—–#<>="
_LABEL = re.compile(r"(?:#+\s*)?(?:art[ií]?culo|art\.|par[áa]grafo|cap[íi]tulo|t[íi]tulo|secci[óo]n|considerando|que |por (?:el|la) cual|\d{1,3}(?:\.\d+)*[.)-]|[a-zñ]\)|[ivxl]+[.)]\s|[-*•]\s|\{\{|~~\{\{)", re.I)
_JOIN, _CONFUSED, _APART = 2.5, 2.0, 4.5
#: Known words on either side of an unknown one that are decoded with it; a known word by itself is its own cheapest explanation.
_AROUND = 2


def unknown(word: str) -> float:
    """Cost of a word that the dictionary does not hold; a short one is the likelier to be just that."""
    return 3.5 if len(word) < 5 else 5.5 if len(word) < 8 else 9.0


def key_of(line: str) -> str:
    """A line without case, accents, figures and marks."""
    s = "".join(c for c in unicodedata.normalize("NFD", line.upper()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^A-Z0 ]+", " ", re.sub(r"\d+", "0", s))).strip()


class Model:
    """Word costs, lines of parts that were not printed, and known headers."""

    def __init__(self, words: dict[str, int], lines: set[str], headers: dict[str, int]):
        self.words = {w: n for w, n in words.items() if n >= 3 and len(w) > 1 or w in "aeouy"}
        total = sum(self.words.values()) or 1
        self.cost = {w: -math.log(n / total) / 6 for w, n in self.words.items()}
        self.lines = lines
        self.headers = sorted(h for h, n in headers.items() if n >= 3 and h not in lines)
        self._starts = {w[:k] for w in self.words for k in range(1, min(len(w), 7) + 1)}
        self._sorted = sorted(self.words)
        self._grams: dict[str, list[str]] = {}
        for h in self.headers:
            for g in {h[k : k + 3] for k in range(len(h) - 2)}:
                self._grams.setdefault(g, []).append(h)
        self._right: dict[str, tuple[str, int] | None] = {}
        self._header: dict[str, bool] = {}
        self.fine: dict[str, bool] = {}

    def is_fine(self, token: str) -> bool:
        """Whether a token by itself is a known word without a mark that may be noise."""
        if len(self.fine) > 300_000:
            self.fine.clear()
        core = _bare(token)[1]
        odd = token[0] in _STRAY or token[0] == "." or token[-1] in _HYPHENS or token[-1] in "`'~|¦·" or token.endswith(_GARBLED_HYPHENS) or not core and not token.isascii()
        single = len(core) == 1 and core.isalpha() and core.lower() not in "aeouy"
        self.fine[token] = found = not odd and not single and (not core or _known(core, self))
        return found

    def right(self, word: str) -> tuple[str, int] | None:
        """The likeliest word that was misread as this one, and the number of confusions; null where none costs less than an unknown word."""
        if word in self._right:
            return self._right[word]
        if len(self._right) > 300_000:
            self._right.clear()
        most = int(unknown(word) / _CONFUSED)
        best: tuple[int, float, str] | None = None
        # Every prefix that no word of the dictionary has ends a branch, so that the search is bounded by the dictionary.
        stack = [(0, "", 0)]
        while stack:
            i, done, n = stack.pop()
            if done and not self._begins(done):
                continue
            if i == len(word):
                if n and done in self.words and (best is None or (n, self.cost[done]) < best[:2]):
                    best = (n, self.cost[done], done)
                continue
            if n < most and (best is None or n < best[0]):
                for a, b in _BY_FIRST.get(word[i], ()):
                    if word.startswith(a, i):
                        stack.append((i + len(a), done + b, n + 1))
            stack.append((i + 1, done + word[i], n))
        found = (best[2], best[0]) if best and len(best[2]) >= 2 else None
        self._right[word] = found
        return found

    def _begins(self, prefix: str) -> bool:
        """Whether a word of the dictionary begins so."""
        if len(prefix) <= 7:
            return prefix in self._starts
        at = bisect.bisect_left(self._sorted, prefix)
        return at < len(self._sorted) and self._sorted[at].startswith(prefix)

    def header(self, line: str) -> bool:
        """Whether a short line is a known running header, perhaps misread."""
        k = key_of(line)
        if not k or k in self.lines:
            return False
        if k not in self._header:
            # A header that is as alike shares a third of its runs of three letters at the least: a misread letter spoils three of them.
            shared = Counter(h for g in {k[i : i + 3] for i in range(len(k) - 2)} for h in self._grams.get(g, ()))
            near = [h for h, n in shared.items() if 3 * n >= min(len(h), len(k)) - 2]
            self._header[k] = bool(difflib.get_close_matches(k, near, 1, 0.86))
        return self._header[k]


def _bare(token: str) -> tuple[str, str, str]:
    core = token.strip(_EDGE + "~*_")
    if not core:
        return token, "", ""
    at = token.index(core)
    return token[:at], core, token[at + len(core) :]


def _like(model: str, word: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word.capitalize() if letters and letters[0].isupper() else word


def _known(core: str, model: Model) -> bool:
    low = core.lower()
    return low in model.words or bool(_NUMBER.fullmatch(low)) or bool(_ROMAN.fullmatch(low))


def decode(text: str, model: Model) -> tuple[str, set[str]]:
    """The stream of a page or paragraph with its words put right, and the kinds of noise met."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    n = len(tokens)
    if not n:
        return text, set()
    fine = model.fine
    odd = [i for i, (t, _, _) in enumerate(tokens) if not (fine[t] if t in fine else model.is_fine(t))]
    if not odd:
        return text, set()
    gaps = [text[a[2] : b[1]] for a, b in zip(tokens, tokens[1:])] + [""]
    hyphen = [False] * n
    bad = []
    for i in odd:
        t = tokens[i][0]
        bare_end = t.rstrip("`'~|¦·").rstrip(_HYPHENS)
        hyphen[i] = gaps[i].count("\n") == 1 and (bare_end[-1:].isalpha() and t.rstrip("`'~|¦·") != bare_end or t.endswith(_GARBLED_HYPHENS))
        core = _bare(t)[1]
        if hyphen[i] or (t[0] in _STRAY and "~~" not in t[0]) or (t[0] == "." and i) or (core and not _known(core, model)):
            bad.append(i)
        elif len(core) == 1 and core.isalpha() and core.lower() not in "aeouy":
            bad.append(i)
    if not bad:
        return text, set()
    out, noise, done = [], set(), 0
    k = 0
    while k < len(bad):
        a = max(bad[k] - _AROUND, done)
        b = bad[k] + 1 + _AROUND
        while k + 1 < len(bad) and bad[k + 1] - _AROUND < b:
            k += 1
            b = bad[k] + 1 + _AROUND
        b = min(b, n)
        k += 1
        fixed, kinds = _region(text, tokens, {i: _bare(tokens[i][0]) for i in range(a, b)}, gaps, hyphen, a, b, model)
        out.append(text[tokens[done][1] if done else 0 : tokens[a][1]] if a > done else (text[: tokens[0][1]] if not done else ""))
        out.append(fixed)
        out.append(gaps[b - 1])
        noise |= kinds
        done = b
    out.append(text[tokens[done][1] :] if done < n else text[tokens[-1][2] :])
    return "".join(out), noise


def _region(text: str, tokens: list, bare: dict, gaps: list, hyphen: list, a: int, b: int, model: Model) -> tuple[str, set[str]]:
    """Cheapest explanation of the tokens ``a`` to ``b``."""
    inf = float("inf")
    best: list[tuple[float, int, str, str]] = [(0.0, -1, "", "")] + [(inf, -1, "", "")] * (b - a)

    def offer(i: int, j: int, cost: float, word: str, kind: str) -> None:
        if best[i - a][0] + cost < best[j - a][0]:
            best[j - a] = (best[i - a][0] + cost, i, word, kind)

    for i in range(a, b):
        if best[i - a][0] == inf:
            continue
        token = tokens[i][0]
        lead, core, tail = bare[i]
        low = core.lower()
        if not core:
            stray = token in _STRAY or (token == "." and i > a and i + 1 < len(tokens) and bool(gaps[i]) and bool(gaps[i - 1]) and "\n\n" not in gaps[i] and "\n\n" not in gaps[i - 1] and tokens[i - 1][0][-1:].isalnum() and tokens[i + 1][0][:1].islower())
            if stray:
                offer(i, i + 1, 0.3, "", "marcas")
            else:
                offer(i, i + 1, 0.2, token, "")
        elif token in _STRAY:
            offer(i, i + 1, 0.3, "", "marcas")
        elif _known(core, model):
            offer(i, i + 1, model.cost.get(low, 1.5), token, "")
        else:
            offer(i, i + 1, 9.0, token, "signos" if _GLYPHS.search(core) else "")
            if not _GLYPHS.search(core) and (len(low) >= 3 or not low.isalpha()):
                # A point in mid-height may also be a letter of another encoding, which is no misreading.
                found = None if "·" in low and low.replace("·", "á") in model.words else model.right(low)
                if found:
                    offer(i, i + 1, model.cost[found[0]] + _CONFUSED * found[1], lead + _like(core, found[0]) + tail, "lectura")
                if low.isalpha() and len(low) >= 5:
                    for c in range(2, len(low) - 1):
                        if low[:c] in model.words and low[c:] in model.words and len(low[c:]) > 1:
                            offer(i, i + 1, _APART + model.cost[low[:c]] + model.cost[low[c:]], lead + core[:c] + " " + core[c:] + tail, "")
        if not core:
            continue
        # Words in several parts.
        joined, rest, kind, j, parts = core, tail, "", i, 1
        broken = 0
        singles = len(core) == 1
        while j + 1 < b:
            nxt = tokens[j + 1][0]
            if hyphen[j]:
                raw = tokens[j][0] if j == i else rest_token
                for g in _GARBLED_HYPHENS:
                    if raw.endswith(g):
                        raw = raw[: -len(g)]
                        break
                else:
                    raw = raw.rstrip("`'~|¦·").rstrip(_HYPHENS)
                piece = raw.strip(_EDGE + "~*_")
                joined = piece if j == i else joined_before + piece
                broken += 1
                kind = "guiones"
            elif gaps[j].count("\n") > 1 or (rest and rest.strip("~*_")):
                break
            elif not kind:
                kind = "separadas"
            l2, c2, t2 = bare[j + 1]
            if not c2 or nxt in _STRAY:
                if hyphen[j] and nxt in _STRAY and j + 2 < b:
                    hyphen_next = True
                    j += 1
                    rest_token, joined_before, rest = "", joined, ""
                    l2, c2, t2 = bare[j + 1]
                    nxt = tokens[j + 1][0]
                    if not c2:
                        break
                else:
                    break
            if l2.strip("~*_") and not broken:
                break
            joined_before = joined
            rest_token = nxt
            joined, rest, j, parts = joined + c2, t2, j + 1, parts + 1
            singles = singles and len(c2) == 1
            low_j = joined.lower()
            if kind == "separadas" and not singles and _JOIN * (parts - 1 - broken) >= 9.0 * parts:
                break
            if kind == "separadas" and not singles and all(_known(bare[x][1], model) and len(bare[x][1]) > 1 for x in range(i, j + 1)):
                continue
            if kind == "separadas" and singles and parts < 3:
                continue
            cost = 0.4 * broken + (1.0 if singles else _JOIN * (parts - 1 - broken))
            if low_j in model.words:
                offer(i, j + 1, cost + model.cost[low_j], lead + joined + rest, kind)
            elif broken and tokens[i][0][-1] == "-" and "-".join((core.rstrip("-"), c2)).lower() in model.words:
                offer(i, j + 1, cost, lead + core.rstrip("-") + "-" + c2 + rest, "")
            else:
                found = model.right(low_j) if len(low_j) >= 4 and (kind != "separadas" or len(low_j) >= 5) else None
                if found:
                    offer(i, j + 1, cost + model.cost[found[0]] + _CONFUSED * found[1], lead + _like(joined, found[0]) + rest, kind)
                elif broken and parts == broken + 1 and joined.isalpha():
                    whole = _known(bare[i][1].rstrip(_HYPHENS), model) and _known(c2, model) and tokens[i][0][-1] == "-"
                    if not whole:
                        offer(i, j + 1, cost + 6.0, lead + joined + rest, kind)
    path, j = [], b
    while j > a:
        cost, i, word, kind = best[j - a]
        path.append((i, j, word, kind))
        j = i
    path.reverse()
    out, kinds = [], set()
    for k, (i, j, word, kind) in enumerate(path):
        out.append(word)
        if k + 1 < len(path):
            out.append(gaps[j - 1] if word or not out[:-1] else "")
        if kind:
            kinds.add(kind)
    return "".join(out), kinds


def pages(text: str) -> list[list[str]]:
    """Lines of the pages of a part; one page where there are no page comments."""
    return [p.strip("\n").split("\n") for p in _PAGE.split(text) if p.strip()]


def strip_pages(text: str, model: Model, printed: bool = True) -> tuple[list[list[str]], set[str]]:
    """Lines of the pages without page numbers and running headers, and the kinds of noise met."""
    found = pages(text)
    noise: set[str] = set()
    drop: list[set[int]] = [set() for _ in found]
    tops: Counter = Counter()
    edges = []
    for lines in found:
        full = [i for i, x in enumerate(lines) if x.strip()]
        edges.append((full[:3], full[-3:]))
        tops.update({key_of(lines[i]) for i in {*full[:2], *full[-2:]} if len(lines[i].strip()) <= 70})
    for p, (lines, (top, bottom)) in enumerate(zip(found, edges)):
        full = [i for i, x in enumerate(lines) if x.strip()]
        for i in {*top, *bottom}:
            s = lines[i].strip().strip("".join(_STRAY)).strip()
            if _STRONG.fullmatch(s) or (re.fullmatch(r"[pP][áa]?g(?:ina)?\.? ?\S{1,4}(?: de \S{1,4})?", s) and any(c.isdigit() for c in s)):
                drop[p].add(i)
            elif _BARE.fullmatch(s) and len(full) > 1:
                at = full.index(i)
                around = lines[full[at - 1]].strip() if at == len(full) - 1 else lines[full[at + 1]].strip()
                edge = at == 0 or at == len(full) - 1 or (at == 1 and 0 < len(lines[full[0]].strip()) <= 70 and model.header(lines[full[0]]))
                if edge and not _BARE.fullmatch(around) and not (at == len(full) - 1 and around.endswith(":")):
                    drop[p].add(i)
        if drop[p]:
            noise.add("paginas")
        left = [i for i in full if i not in drop[p]]
        for i in dict.fromkeys([*left[:2], *left[-1:]]):
            s = lines[i].strip()
            if not 3 < len(s) <= 70 or s[:1].islower() or s.endswith((".", ";", ":", ",")) or _LABEL.match(s) or s.startswith("#"):
                continue
            k = key_of(s)
            repeated = tops[k] >= 2 and k not in model.lines and len(k) > 3
            follows = i + 1 < len(lines) and bool(lines[i + 1].strip())
            if (repeated or model.header(s)) and (follows or i == left[-1] or repeated):
                drop[p].add(i)
                noise.add("encabezados")
    return [[x for i, x in enumerate(lines) if i not in d] for lines, d in zip(found, drop)], noise


def join_lines(lines: list[tuple[str, bool]]) -> list[str]:
    """Paragraphs of ``(line, break before)``, by the cheapest choice of begins.

    A break costs by how the line before ends and the line behind begins; a join costs by the blank lines, labels and
    short lines it passes over.
    """
    if not lines:
        return []
    width = sorted(len(x) for x, _ in lines)[int(len(lines) * 0.9)] if len(lines) > 4 else 0
    best, back = [0.0], [0]
    prefix, lead, origin = 0.0, 0.0, 0  # lead: cheapest begin so far, less the joins before it
    for j, (line, _) in enumerate(lines):
        if j:
            before = lines[j - 1][0].rstrip()
            blank = lines[j][1]
            label = bool(_LABEL.match(line))
            ended = before.endswith((".", ":", "?", "!", "}}", ".”", "»"))
            join = (4.0 if blank else 0.0) + (3.0 if label and ended else 0.0) + (1.0 if ended and len(before) < 0.7 * width else 0.0)
            part = 1.2 + (0.0 if ended or (blank and before.isupper()) else 2.5) + (3.0 if line[:1].islower() else 0.0) + (0.0 if blank or label else 1.5)
            prefix += join
            start = best[j] + part - prefix
            if start < lead:
                lead, origin = start, j
        best.append(lead + prefix)
        back.append(origin)
    cuts, j = [], len(lines)
    while j > 0:
        cuts.append(back[j])
        j = back[j]
    cuts = sorted({0, *cuts})
    return [" ".join(x.strip() for x, _ in lines[a:b]) for a, b in zip(cuts, [*cuts[1:], len(lines)])]


def repair(text: str, model: Model) -> tuple[list[str], list[str]]:
    """Readable paragraphs of a printed part, and the kinds of noise that were in it, sorted."""
    kept, noise = strip_pages(text, model)
    lines: list[tuple[str, bool]] = []
    for page in kept:
        blank = False
        fixed, kinds = decode("\n".join(page), model)
        noise |= kinds
        for line in fixed.split("\n"):
            if line.strip():
                lines.append((line.strip(), blank and bool(lines)))
                blank = False
            else:
                blank = True
    return [p for p in join_lines(lines) if p], sorted(noise)


def _candidate(lines: list[str], i: int, full: list[int]) -> bool:
    """Whether a line at a page's edge could be a running header: short, no sentence, set against the text without a blank line."""
    s = lines[i].strip()
    if not 3 < len(s) <= 60 or s[:1].islower() or s.endswith((".", ";", ":", ",", "}}")) or _LABEL.match(s) or _STRONG.fullmatch(s) or _BARE.fullmatch(s):
        return False
    if i in full[:2]:
        return i + 1 < len(lines) and bool(lines[i + 1].strip()) and not lines[i + 1].lstrip()[:1].islower()
    return bool(lines[i - 1].strip()) and lines[i - 1].rstrip().endswith((".", "}}", ";", ":"))


def is_printed(metodo: Column, markdown: Column) -> Column:
    """Rows that come from scanned or printed pages, by their method or, where that is wrong or null, by page comments."""
    return F.coalesce(metodo.startswith("pdf"), F.lit(False)) | F.coalesce(markdown.contains("<!-- pagina "), F.lit(False))


def counted(texts: Iterator[tuple[bool, str]]) -> Counter:
    """How often words (``w``) and in how many texts lines (``l``) of parts not printed, and candidates for headers (``h``) and lines at the edges of pages (``e``) of printed ones, occur."""
    counts: Counter = Counter()
    tokens: Counter = Counter()
    lines: Counter = Counter()
    ends: Counter = Counter()
    for printed, text in texts:
        if printed:
            seen, edges = set(), set()
            for page in pages(text):
                full = [i for i, x in enumerate(page) if x.strip()]
                # ``strip_pages`` looks at two lines from the top and one from the bottom, behind up to three that it drops.
                edges |= {page[i].strip() for i in {*full[:5], *full[-4:]}}
                seen |= {key_of(page[i].strip()) for i in dict.fromkeys([*full[:2], *full[-2:]]) if _candidate(page, i, full)}
            counts.update(("h", k) for k in seen if k)
            ends.update(x for x in edges if len(x) <= 70)
        else:
            tokens.update(text.split())
            lines.update({x for x in text.split("\n") if 0 < len(x) <= 70})
    for t, n in tokens.items():
        if (w := _bare(t)[1].lower()).isalpha() and not _GLYPHS.search(w):
            counts["w", w] += n
    for kind, found in (("l", lines), ("e", ends)):
        for x, n in found.items():
            if k := key_of(x):
                counts[kind, k] += n
    return counts


def train(rows: DataFrame, limit: int | None = None) -> Model:
    """Model of ``(metodo, markdown)``, counted over all rows; all counts that it uses reach the driver, or, if it is given, the ``limit`` greatest.

    Of the lines of parts not printed, those count that stand at the edge of a page of ``rows``, as no others are asked for.
    """
    texts = rows.where("markdown is not null").select(is_printed(F.col("metodo"), F.col("markdown")).alias("printed"), "markdown")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(counted(zip(batch["printed"], batch["markdown"])))
            if len(counts) > _HELD:
                yield pd.DataFrame([(kind, k, n) for (kind, k), n in counts.items()], columns=["kind", "k", "n"])
                counts = Counter()
        yield pd.DataFrame([(kind, k, n) for (kind, k), n in counts.items()], columns=["kind", "k", "n"])

    of = [F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind) for kind in "wlhe"]
    total = texts.mapInPandas(run, "kind string, k string, n bigint").groupBy("k").agg(*of)
    # Whether a line guards against a header is decided here, over all lines.
    useful = total.where("w >= 3 or (l > 0 and (e > 0 or h > 0)) or (h >= 3 and l = 0)")
    if limit is not None:
        useful = useful.orderBy(F.greatest("w", "l", "h").desc(), "k").limit(limit)
    found = sorted(tuple(r) for r in useful.select("k", "w", "l", "h").collect())
    return Model({k: w for k, w, _, _ in found if w}, {k for k, _, n, _ in found if n}, {k: h for k, _, n, h in found if h and not n})


def repaired(rows: DataFrame, model: Model | None = None, paragraphs: bool = True) -> DataFrame:
    """``(texto_id, ruidos, parrafos)`` of the printed rows of ``(texto_id, metodo, markdown)``.

    ``ruidos`` names the kinds of noise: guiones, separadas, lectura, marcas, signos, encabezados, paginas; it is empty
    for a clean page. Null and empty texts give no row; repeated rows give repeated results; an empty table gives none.
    """
    rows = rows.select("texto_id", "metodo", "markdown")
    if model is None:
        model = train(rows)
    printed = rows.where(is_printed(F.col("metodo"), F.col("markdown")) & (F.length("markdown") > 0)).select("texto_id", "markdown")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *reversed(repair(t, model))) for i, t in zip(batch["texto_id"], batch["markdown"])]
            yield pd.DataFrame(out, columns=["texto_id", "ruidos", "parrafos"])

    fixed = printed.mapInPandas(run, "texto_id bigint, ruidos array<string>, parrafos array<string>")
    return fixed if paragraphs else fixed.select("texto_id", "ruidos")
