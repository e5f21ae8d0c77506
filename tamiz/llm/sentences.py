"""Sentence units of texts in any script by a hidden-event n-gram model.

Between two words a hidden boundary token may stand, whether a mark is there or not. At a mark the model weighs the
probability of the boundary token after a word and its mark, P(S | w, m), of the next word after the boundary,
P(r | S), and after none, P(r | not S); at a gap without a mark, P(r | S) against P(r | w), the same word behind this one;
in scripts without spaces every gap between two characters is one, weighed by how often the characters before it end
a unit, too. The model is trained on the texts themselves: a blank line is a boundary for certain, a gap between words
without a mark nearly for certain none, and expectation maximisation settles the slots between. Forward-backward over
the slots of a paragraph gives each boundary's posterior. Gaps that cannot reach the threshold, and chains without ties,
whose posteriors are those of the slots alone, are not computed. Layout decides before the model does: blank lines,
labels of list items, quotations, brackets; in Thai a gap is a boundary by the problem's own definition.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import cut

#: Distinct counts that a task holds before it passes them on.
_HELD = 200_000
#: Characters of paragraphs whose words are counted at once.
_BLOCK = 1 << 22

_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
# Begins with a set of characters, which the engine looks for at once; three points are a mark of their own.
# What may belong to a mark is not looked for where a letter or figure follows.
_MARK = re.compile(r"[.!?…。！？｡؟।॥۔](?:(?![ ]?[A-Za-z0-9])(?:(?<=[.])[.]{2}|[.!?…。！？｡؟।॥۔]*)(?:[   ]?[»”\"'’)\]」』）］]+)*)?")
# A mark, the space behind it and the next word.
_SLOT = re.compile(_MARK.pattern + r"(?=(\s*)(\S{0,24}))")
_WIDE = "。！？｡।॥؟۔"
_PAIRS = {"«": "»", "“": "”", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "［": "］", "„": "“"}
_CLOSE = {v: k for k, v in _PAIRS.items()}
_QUOTES = re.compile("[" + re.escape("".join({*_PAIRS, *_CLOSE}) + '"—') + "]")
_SHIELDS = '("—«“[„「『（［'  # without one of these nothing is shielded
_OPENERS = "«“„\"'‘([「『（［¿¡—–"
_ITEM = re.compile(r"\n[^\S\n]*(?=((?:\d{1,3}(?:\.\d{1,3})*[.)]|\d{1,3}(?:\.\d{1,3})+|[a-zñ][.)]|[ivxl]{1,5}[.)]|\(\w{1,3}\)|[-•*·–])[^\S\n]+\S))")
_LABEL = re.compile(r"(?:#+\s*)?(?:[^\W\d_]+\.?[^\S\n]+)?(?:(?:\d{1,4}(?:\.\d{1,3})*|[IVXLC]+|[ivxl]{1,5}|[a-zA-ZñÑ])(?:[º°ªo]|er)?[.)]?[ºª]?(?:[.)\-–:]+)|§\s*\d+[.)]*)$")
_CAPS = re.compile(r"(?:PARÁGRAFO|PARAGRAFO|ARTÍCULO|ARTICULO)(?:\s+(?:TRANSITORIO|ÚNICO|UNICO|\d+[ºo]?))*\.?-?$")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_DIGITS = re.compile(r"\d+")
_RIGHT = re.compile(r"\S{1,24}")
# A word behind a space and a letter or another space; no small letter or figure, as these never begin a unit without a mark.
_GAP = re.compile("[^a-zß-öø-ÿа-яё0-9\\s](?:(?<=[\\w\u0900-\u0963]\\s.)|(?<=\\s\\s.))\\S{0,23}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CJK_RUN = re.compile(r"[぀-ヿ㐀-鿿]{4,}")
#: Share of the gaps before such words where a final mark is missing, before any evidence; a unit has three words and more there.
MISSING, _LEAST = 0.001, 3


def shielded(p: str) -> list[tuple[int, int]]:
    """Outermost quotations, brackets and dash insertions of a paragraph; marks that never close shield nothing."""
    if not any(map(p.__contains__, _SHIELDS)):
        return []
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    straight = dash = -1
    for m in _QUOTES.finditer(p):
        c, i = m.group(), m.start()
        if c == "—":
            before, after = p[i - 1 : i] if i else "", p[i + 1 : i + 2]
            if (not before or before.isspace() or before in "([«“") and after and not after.isspace():
                dash = i
            elif before and not before.isspace() and dash >= 0 and (not after or not after.isalnum()):
                spans.append((dash, i))
                dash = -1
        elif c == '"':
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i))
                straight = -1
        elif c in _CLOSE and any(o == _CLOSE[c] for o, _ in stack):
            while stack:
                o, at = stack.pop()
                if o == _CLOSE[c]:
                    spans.append((at, i))
                    break
        elif c in _PAIRS:
            stack.append((c, i))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(1 << 17)
def _left(w: str) -> str:
    w = w.lstrip(_OPENERS)
    if _CJK.search(w):
        return w[-2:]
    return _DIGITS.sub("0", w.lower())[-16:]


def _word_before(p: str, at: int) -> str:
    w = p[max(0, at - 24) : at]
    if w[-1:].isspace():
        return ""
    parts = w.rsplit(None, 1)
    return _left(parts[-1]) if parts else ""


@lru_cache(1 << 17)
def _right(w: str) -> tuple[str, bool]:
    bare = w.lstrip(_OPENERS)
    if _CJK.search(bare[:2]):
        return bare[:2], bare != w
    if "¿" in w[: len(w) - len(bare)] or "¡" in w[: len(w) - len(bare)]:
        return "¿", True
    if bare[:1].isdigit():
        return "0", bare != w
    return _DIGITS.sub("0", bare.rstrip(".,;:!?…»”\")]"))[:16], bare != w


def _word_after(p: str, at: int) -> tuple[str, bool]:
    m = _RIGHT.match(p, at)
    return _right(m.group()) if m else ("", False)


def _kind(r: str) -> str:
    c = r[:1]
    return "" if not c else "l" if c.islower() else "U" if c.isupper() else "0" if c.isdigit() else "o" if c.isalpha() else "p"


def _shape(left: str) -> str:
    return "" if not left else "c" if _CJK.search(left) else "0" if left[-1].isdigit() else "1" if len(left) == 1 else "." if "." in left else "s" if len(left) <= 3 else "w"


def _slots(p: str) -> list[tuple[int, int, str, str, str, bool]]:
    """Marks of a paragraph that may end a unit: (end, next start, word, mark, next word, next begins with an opener)."""
    out, spans, k = [], None, 0
    for m in _SLOT.finditer(p):
        a, e = m.span()
        if spans is None:
            spans = shielded(p)
        while k < len(spans) and spans[k][1] < a:
            k += 1
        if k < len(spans) and spans[k][0] < a:
            close = spans[k][1]
            if e <= close:
                continue
        space, behind = m.groups()
        if not behind:
            continue
        if not space:
            # The space is missing, or the mark is part of a word or figure.
            after = behind[0]
            prev = p[a - 1 : a]
            mark = p[a]
            if mark in _WIDE:
                pass
            elif after in "—–-,;:)/" or after.isdigit() or not prev:
                continue
            elif not ((prev.islower() or prev in "»”)\"" or (prev.isalpha() and not prev.isupper()) or (prev.isdigit() and len(_word_before(p, a)) > 0 and mark != ".")) and (after.isupper() or after in "¿¡«“" or (after.isalpha() and not after.islower()))):
                continue
            elif prev.islower() and a > 1 and not p[a - 2 : a - 1].isalpha():
                continue
        r, opened = _right(behind)
        mark = p[a]
        if e > a + 1 and (last := p[e - 1]) not in ".!?…":
            mark += last
        out.append((e, e + len(space), _word_before(p, a), mark, r, opened))
    return out


def _value(label: str) -> tuple[str, int]:
    """Style and number of a list label."""
    bare = label.strip("().- ")
    if not bare:
        return "-", 0
    if bare[0].isdigit():
        return "9", int(bare.split(".")[-1] or 0)
    roman = {"i": 1, "v": 5, "x": 10, "l": 50}
    if len(bare) > 1 or bare in "iv":
        total = 0
        for c, d in zip(bare, bare[1:] + " "):
            v = roman.get(c, 0)
            total += -v if roman.get(d, 0) > v else v
        return "i", total
    return "a", ord(bare) - 96


def _items(p: str) -> list[int]:
    """Starts of list items after a single line break, in a paragraph."""
    out: list[int] = []
    last = _LABEL.match(p.split(None, 1)[0]) and _value(p.split(None, 1)[0]) if p[:1].strip() else None
    for m in _ITEM.finditer(p):
        style, n = _value(m.group(1).split()[0])
        before = p[: m.start()].rstrip()[-1:]
        follows = last is not None and last[0] == style and n == last[1] + 1
        if style == "-" or follows or (n == 1 and before in ":;.") or before in ":;" or (before in ".!?…" and last is not None and last[0] == style and n > last[1]) or (n == 1 and before not in ",(" and style != "9"):
            out.append(m.end())
            last = (style, n)
    return out


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """Offset and text of the blocks between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, text[at : m.start()]
        at = m.end()
    if at < len(text):
        yield at, text[at:]


@lru_cache(1 << 16)
def _begin(token: str) -> str:
    return _word_after(token, 0)[0]


def _count_gaps(block: list[str], counts: Counter) -> None:
    """Count the gaps without a mark of paragraphs that neither are empty nor begin or end with a space; their words are split and compared in Arrow."""
    split = pc.utf8_split_whitespace(pa.array(block, pa.large_string()))  # what a space is to Python, is one to Arrow
    coded = split.values.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    within = np.ones(len(at) - 1, bool)
    within[split.offsets.to_numpy()[1:-1] - 1] = False
    first, second = at[:-1][within], at[1:][within]
    letter = np.fromiter(map(_ends_in_letter, words), bool, len(words))
    unmarked = letter | np.fromiter((w[-1] in ",;" for w in words), bool, len(words))
    begins = [_begin(w) for w in words]
    large = np.fromiter((not r[:1].islower() and not r[:1].isdigit() for r in begins), bool, len(words))
    for r, n in zip(begins, np.bincount(second[unmarked[first]], minlength=len(words)).tolist()):
        if n:
            counts["n", "", "", r] += n
    both = letter[first] & large[second]
    pairs, times = np.unique(first[both].astype(np.int64) << 32 | second[both], return_counts=True)
    for pair, n in zip(pairs.tolist(), times.tolist()):
        counts["g", _end(words[pair >> 32]), "", begins[pair & 0xFFFFFFFF]] += n


def counted(texts: Iterable[str]) -> Counter:
    """How often each (kind, word, mark, next word) occurs: ``e`` a paragraph's end, ``b`` its begin, ``m`` an open slot, ``n`` a gap without a mark, ``g`` one before a word that may begin a unit."""
    counts: Counter = Counter()
    block: list[str] = []
    size = 0
    runs: Counter = Counter()
    for text in texts:
        east = _eastern(text)
        for _, p in paragraphs(text):
            p = p.strip()
            if not p:
                continue
            first = p.split(None, 1)
            while len(first) > 1 and _LABEL.match(first[0]) and not re.fullmatch(r"[A-ZÑ]\.", first[0]):
                first = first[1].split(None, 1)
            counts["b", "", "", _begin(first[0])] += 1
            if len(p) < 60 and not _MARK.search(p[-3:]):
                continue  # a heading
            found = list(_MARK.finditer(p[-6:]))
            if found and found[-1].end() == len(p[-6:]):
                m = found[-1]
                a = len(p) - len(p[-6:]) + m.start()
                last = m.group()[-1]
                counts["e", _word_before(p, a), p[a] + (last if last not in ".!?…" and len(m.group()) > 1 else ""), ""] += 1
            for _, _, w, mark, r, _ in _slots(p):
                counts["m", w, mark, r] += 1
            # Words are counted as they stand and looked into once each.
            block.append(p)
            size += len(p)
            if size > _BLOCK:
                _count_gaps(block, counts)
                block, size = [], 0
            for m in _CJK_RUN.finditer(p) if east else ():
                run = m.group()
                runs.update([run[i : i + 4] for i in range(len(run) - 3)])
    if block:
        _count_gaps(block, counts)
    for four, n in runs.items():
        counts["g", four[:2], "", four[2:]] += n
    return counts


def training_rows(text: str) -> Counter:
    """The counts of one text."""
    return counted([text])


@lru_cache(1 << 16)
def _end(token: str) -> str:
    return _word_before(token, len(token))


def _word_of(w: str, m: str) -> str:
    """The word that a slot's mark is counted with; marks that no abbreviation or figure has are counted by themselves."""
    return "" if len(m) == 1 and m in _WIDE else w


class _Opens(dict):
    """The word that a token begins with, if units are known to begin so and it may do so without a mark before it; else nothing."""

    def __init__(self, opening: set[str]):
        self.opening = opening

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        r = _right(token[:24])[0]
        self[token] = value = r if r in self.opening and not r[:1].islower() and not r[:1].isdigit() else ""
        return value


class _Seen(dict):
    """Probabilities of slots by what they are made of."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, slot: tuple[str, str, str, bool]) -> float:
        if len(self) > 200_000:
            self.clear()
        self[slot] = value = self.model.boundary(*slot)
        return value

    def __reduce__(self):
        return _Seen, (self.model,)


class Model:
    """Hidden-event model from counts of ``training_rows``."""

    def __init__(self, counts: list[tuple[str, str, str, str, int]], rounds: int = 6):
        ends, opened, slots = Counter(), Counter(), []
        begin, inner = Counter(), Counter()
        self.pair, self.left, self.right = Counter(), Counter(), Counter()
        self.ends: Counter = Counter()  # the last words of units, whatever the mark
        for kind, w, m, r, n in counts:
            if kind == "g":
                self.pair[w, r] += n
                self.left[w] += n
                self.right[r] += n
            elif kind == "e":
                self.ends[w] += n
                ends[_word_of(w, m), m] += n
            elif kind == "b":
                begin[r] += n
            elif kind == "n":
                inner[r] += n
            else:
                slots.append((_word_of(w, m), m, r, n))
                opened[_word_of(w, m), m] += n
        total_e, total_o = sum(ends.values()), sum(opened.values())
        final = max(0.05, total_e / max(1, total_e + 0.7 * total_o))  # share of the boundaries that end a paragraph
        self.after = {k: min(0.98, (ends[k] / final + 0.02) / max(opened[k] + ends[k] + 0.04, ends[k] / final + 0.04)) for k in {*ends, *opened}}
        long = {k for k in self.after if len(k[0]) >= 6 and k[0].isalpha() or _word_of("-", k[1]) == ""}  # hardly ever abbreviated
        self.after |= {k: max(self.after[k], 0.997) for k in long}
        self._begin, self._inner = begin, inner
        self.opening = {r for r, n in begin.items() if n > 1}
        self.opens = _Opens(self.opening)
        self.gaps, self.begins = sum(self.right.values()) + 1.0, sum(begin.values()) + 1.0
        self.ended = total_e + 1.0
        self._set(begin, inner)
        by_shape: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.5, 1.0])
        for (w, m), a in self.after.items():
            n = opened[w, m] + ends[w, m]
            s = by_shape[_shape(w), m[:1]]
            s[0] += a * min(n, 5)
            s[1] += min(n, 5)
        self.shape = {k: v[0] / v[1] for k, v in by_shape.items()}
        for _ in range(rounds):
            # How units begin is known from paragraphs alone; a name's second part would else become a begin by itself.
            yes, inner = Counter(), Counter()
            for w, m, r, n in slots:
                p = self.boundary(w, m, r, False)
                yes[w, m] += p * n
                inner[r] += (1 - p) * n
            for k in {*ends, *opened}:
                prior = self.shape.get((_shape(k[0]), k[1][:1]), 0.5)
                weight = 0.5
                if k in long:
                    prior, weight = max(prior, 0.997), max(20.0, opened[k] + ends[k])  # however many texts are counted
                self.after[k] = (yes[k] + ends[k] + weight * prior) / (opened[k] + ends[k] + weight)
            self._set(self._begin, self._inner + inner)
        self.seen = _Seen(self)

    def _set(self, begin: Counter, inner: Counter) -> None:
        def dist(c: Counter) -> tuple[Counter, float, dict[str, float]]:
            n = sum(c.values()) + 1.0
            kinds: dict[str, float] = defaultdict(float)
            ones: dict[str, float] = defaultdict(float)
            for r, k in c.items():
                kinds[_kind(r)] += k
                if k <= 1:
                    ones[_kind(r)] += k
            return c, n, {k: (ones[k] + 0.1) / n for k in {*kinds, "l", "U", "0", "o", "p", ""}}

        self.b, self.c = dist(begin), dist(inner)

    @staticmethod
    def _p(d: tuple[Counter, float, dict[str, float]], r: str) -> float:
        counts, n, unseen = d
        return (counts.get(r, 0) + 0.02 + unseen.get(_kind(r), 1e-6) * 0.5) / n

    def boundary(self, w: str, m: str, r: str, opener: bool) -> float:
        """P(boundary | word, mark, next word) of one slot."""
        if _kind(r) == "l" and not opener:
            return 0.0
        w = _word_of(w, m)
        a = self.after.get((w, m))
        if a is None:
            # Behind a closed quotation the sentence around it may go on.
            a = 0.3 if len(m) > 1 else 0.997 if len(w) >= 6 and w.isalpha() or not _word_of(w, m) else self.shape.get((_shape(w), m[:1]), 0.5 if m[:1] == "." else 0.9)
        a = min(max(a, 1e-4), 1 - 1e-3)
        seen = r in self.b[0] or r in self.c[0] or _kind(r) == "U" or opener
        odds = a / (1 - a) * min(max(self._p(self.b, r) / self._p(self.c, r), 0.02), 50.0 if seen else 1.0)
        return odds / (1 + odds)

    def unmarked(self, w: str, r: str) -> float:
        """P(boundary | word, next word) of a gap without a mark: the next word from a unit's begin against the same behind this word."""
        if self.begin_of(r) * MISSING * 20 < self.right[r] / self.gaps / (self.left[w] + 1.0):
            return 0.0
        behind = (self.pair[w, r] + (self.right[r] + 0.5) / self.gaps) / (self.left[w] + 1.0)
        odds = MISSING * self.begin_of(r) / behind
        if _CJK.search(w):
            # Scripts without spaces have gaps between all characters; most of them lie within words, which are no ends.
            odds *= (self.ends[w] + 0.01) / self.ended / ((self.left[w] + 1.0) / self.gaps)
        return odds / (1 + odds)

    def begin_of(self, r: str) -> float:
        """P(word | a unit begins); a word that only once or never did says nothing."""
        n = self._begin[r]
        return n / self.begins if n > 1 else 0.0

    def posteriors(self, slots: list[tuple[int, int, str, str, str, bool]]) -> list[float]:
        """Forward-backward over the slots of a paragraph; boundaries a single word apart discourage each other."""
        p = [self.seen[s[2:]] for s in slots]
        if len(p) < 2:
            return p
        tie = [0.1 if 0 <= y[0] - x[1] <= 3 else 1.0 for x, y in zip(slots, slots[1:])]
        if all(t == 1.0 for t in tie):
            return p
        fwd = [(1 - p[0], p[0])]
        for t, q in zip(tie, p[1:]):
            n, s = fwd[-1]
            n, s = (n + s) * (1 - q), (n + s * t) * q
            z = n + s or 1.0
            fwd.append((n / z, s / z))
        out, back = [0.0] * len(p), (1.0, 1.0)
        for i in range(len(p) - 1, -1, -1):
            n, s = fwd[i][0] * back[0], fwd[i][1] * back[1]
            out[i] = s / (n + s) if n + s else 0.0
            if i:
                q, t = p[i], tie[i - 1]
                n, s = (1 - q) * back[0] + q * back[1], (1 - q) * back[0] + q * t * back[1]
                z = n + s or 1.0
                back = (n / z, s / z)
        return out


def _ends_in_letter(token: str) -> bool:
    return token[-1].isalnum() or "\u0900" <= token[-1] <= "\u0963"


_EAST = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")


def _eastern(text: str) -> bool:
    """Whether a text has Thai, Chinese or Japanese letters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _EAST.search(text) is not None
    return False


def _gaps(p: str, model: Model, east: bool) -> list[tuple[int, int, float]]:
    """``(end, next start, posterior)`` of the gaps of a paragraph without a mark where a unit may end."""
    out = []
    for m in _GAP.finditer(p):
        if r := model.opens[m.group()]:
            b = m.start()
            a = b - 1
            while a and p[a - 1].isspace():
                a -= 1
            if a and _ends_in_letter(p[a - 1]) and (q := model.unmarked(_word_before(p, a), r)):
                out.append((a, b, q))
    for m in _CJK_RUN.finditer(p) if east else ():
        run, at = m.group(), m.start()
        for i in range(4, len(run) - 3):
            if run[i : i + 2] in model.opening and (q := model.unmarked(run[i - 2 : i], run[i : i + 2])):
                out.append((at + i, at + i, q))
    return out


def split(text: str | None, model: Model, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Offsets of the sentence units of a text."""
    out: list[tuple[int, int]] = []
    east = _eastern(text or "")
    for base, p in paragraphs(text or ""):
        ends: list[tuple[int, int, bool]] = []
        slots = _slots(p)
        for s, q in zip(slots, model.posteriors(slots)):
            if q >= threshold:
                ends.append((s[0], s[1], False))
        likely = [(a, b) for a, b, q in _gaps(p, model, east) if q >= threshold]
        if likely:
            # A boundary without a mark needs a whole unit on either side, and none is in a quotation or bracket.
            spans, fixed = shielded(p), sorted({0, len(p), *(e for e, _, _ in ends)})
            for a, b in likely:
                before, after = max(x for x in fixed if x <= a), min(x for x in fixed if x > a)
                if not any(x < a < y for x, y in spans) and _long(p[before:a]) and _long(p[b:after]):
                    ends.append((a, b, False))
        if "\n" in p:
            ends += [(i, i, True) for i in _items(p)]
        if east and _THAI_GAP.search(p):
            spans = shielded(p)
            for m in _THAI_GAP.finditer(p):
                a, b = m.start(), m.end()
                if not (p[a - 1].isdigit() or p[b].isdigit() or any(x < a < y for x, y in spans)):
                    ends.append((a, b, True))
        start = 0
        for e, nxt, sure in sorted(ends):
            if e <= start:
                continue
            unit = p[start:e].strip()
            # A label has four words at most.
            if not sure and (len(unit.split(None, 4)) < 5 and _LABEL.fullmatch(unit) or unit.startswith(("PAR", "ART")) and _CAPS.fullmatch(unit)):
                continue
            if unit:
                out.append((base + start, base + e))
            start = nxt
        out.append((base + start, base + len(p)))
    trimmed = []
    for a, b in out:
        if not (text[a].isspace() or text[b - 1].isspace()):
            trimmed.append((a, b))
            continue
        s = text[a:b]
        lead = len(s) - len(s.lstrip())
        if lead < len(s):
            trimmed.append((a + lead, a + len(s.rstrip())))
    return trimmed


def _long(unit: str) -> bool:
    return len(unit.split()) >= _LEAST or len(_CJK.findall(unit)) > _LEAST


def train(texts: DataFrame, limit: int | None = None) -> Model:
    """Model of ``(text)``, counted over all rows; all counts reach the driver, or, if it is given, the ``limit`` most frequent.

    Null texts count as empty. Pairs of words around a gap are kept one by one where a unit may begin with the second;
    of all others the model uses only how often the first stands there, so they are summed for it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(counted(t for t in batch["text"] if t))
            if len(counts) > _HELD:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "w", "m", "r", "n"])
                counts = Counter()
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "w", "m", "r", "n"])

    rows = texts.select("text").mapInPandas(run, "kind string, w string, m string, r string, n bigint")
    total = cut(rows.groupBy("kind", "w", "m", "r").agg(F.sum("n").alias("n")))
    opening = total.where("kind = 'b' and n > 1").select(F.col("r").alias("opening"))
    gaps = total.where("kind = 'g'").join(opening, F.col("r") == F.col("opening"), "left").groupBy("kind", "w", "m", F.col("opening").alias("r")).agg(F.sum("n").alias("n"))
    used = total.where("kind != 'g'").unionByName(gaps)
    if limit is not None:
        used = used.orderBy(F.desc("n"), "kind", "w", "m", "r").limit(limit)
    return Model(sorted((tuple(r) for r in used.collect()), key=lambda c: (-c[4], *c[:3], c[3] or "")))


def sentences(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, inicio, fin)``: every unit of ``(doc_id, text)``, without surrounding whitespace.

    Null, empty and blank texts give no rows; repeated rows give repeated units; an empty table gives none. Texts are
    split whole, where they lie; the model goes to the tasks with their code (its size grows with the distinct words and pairs of the texts).
    """
    texts = texts.select("doc_id", "text")
    if model is None:
        model = train(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [split(t, model) for t in batch["text"]]
            ends = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(found)), np.int32).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(np.int64), [len(u) for u in found]), "inicio": ends[:, 0], "fin": ends[:, 1]})

    return texts.where("doc_id is not null and text is not null").mapInPandas(run, "doc_id bigint, inicio int, fin int")
