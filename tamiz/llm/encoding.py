"""Text that was decoded with the wrong encoding: a hidden Markov model over characters finds it, inverse transforms restore it.

There is one clean state and one state per pair of the encoding a text was in and the one it was read with. Emissions
are character bigrams: the clean state's from undamaged rows of the table itself, each other state's from the same
rows after its own damage. Characters that no pair changes carry no evidence, so only characters outside ASCII and
those right behind them are decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task holds before it counts their bigrams.
_HELD = 200_000
_ENTER, _LEAVE, _CHANGE = 6.6, 2.5, 11.0
_CLEAN_FLOOR, _FLOOR = 1e-5, 1e-8
_LOST = "�"

_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Characters that Spanish text hardly has; those that scans leave behind by themselves prove nothing.
_ODD = re.compile("[^\x00-\x7fáéíóúüñÁÉÍÓÚÜÑ¿¡«»“”‘’—–…°ºª§·¦¬‐\xad]")
#: Usual characters that are odd within a word.
_EDGY = re.compile("[·¡¿ÁÉÍÓÚÜÑ°ºª«»—–‘’“”…§]")


def suspicious(text: str | None) -> bool:
    """Whether a text is kept out of the training rows: odd characters, or usual ones where no word has them."""
    if not text or text.isascii():
        return False
    if _ODD.search(text):
        return True
    for m in _EDGY.finditer(text):
        i = m.start()
        c, a, b = text[i], text[i - 1 : i], text[i + 1 : i + 2]
        if a.islower() and c in "·¡¿ÁÉÍÓÚÜÑ°ºª§«" or a.isalpha() and a.isascii() and b.isascii() and b.islower() and c not in "ÁÉÍÓÚÜÑ":
            return True
    return False


def _encode(text: str, codec: str) -> bytes:
    """Bytes of a text that had been read with ``codec``; bytes a codec leaves undefined had been kept as they were."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if ord(c) > 255:
                raise
            out.append(ord(c))
    return bytes(out)


def _decode(data: bytes, codec: str) -> str:
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data)


# fixed values: encodings a text was in, and those it may have been read with
_PAIRS = {
    "utf-8": ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r", "iso8859_5", "cp1253"],
    "cp850": ["cp1252", "latin-1", "mac_roman", "cp1251"],
    "cp437": ["cp1252", "latin-1"],
    "cp1252": ["cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp866"],
    "mac_roman": ["cp1252", "latin-1", "cp850", "cp437"],
}
_TWICE = ["cp1252", "latin-1"]


def _rounds(right: str, wrong: str, times: int) -> tuple[Callable[[str], str], Callable[[str], str]]:
    def damage(text: str) -> str:
        for _ in range(times):
            text = _decode(_encode(text, right), wrong)
        return text

    def restore(text: str) -> str:
        for _ in range(times):
            text = _encode(text, wrong).decode(right)
        return text

    return damage, restore


STATES = {f"{right} as {wrong}": _rounds(right, wrong, 1) for right, wrongs in _PAIRS.items() for wrong in wrongs} | {
    f"utf-8 as {wrong}, twice": _rounds("utf-8", wrong, 2) for wrong in _TWICE
}
_NAMES = ["clean", *STATES, "lost"]


def _lose(text: str) -> str:
    return re.sub(r"[^\x00-\x7f]", _LOST, text)


def _kind(c: str) -> str:
    return "h" if ord(c) > 127 else "l" if c.islower() else "u" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."


_DAMAGES: list[Callable[[str], str]] = [lambda t: t, *(d for d, _ in STATES.values()), _lose]
_USUAL = ("ÁÉÍÓÚÑÜ ", "áéíóúñü ", "¿¡ñ ")
_WORD = re.compile(r"\S+\s*|\s+")


def words(text: str) -> Counter:
    """Words of a text with the space behind them, and a quarter as often in capitals, as a heading has them."""
    return _with_capitals(Counter(_WORD.findall(text)))


def _with_capitals(counts: Counter) -> Counter:
    kinds = Counter(counts)
    for word, n in counts.items():
        kinds[word.upper()] += n / 4
    return kinds


def bigrams(kinds: Counter) -> Iterator[tuple[int, str, str, float]]:
    """``(state, a, b, n)``: how often ``b`` follows ``a`` in the words as each state damages them; -1 for those that none does."""
    counts: Counter = Counter()
    for word, n in kinds.items():
        for state in (-1,) if word.isascii() else range(len(_DAMAGES)):
            try:
                bad = word if state < 0 else _DAMAGES[state](word)
            except UnicodeError:
                continue
            for a, b in zip(" " + bad, bad):
                counts[state, a, b] += n
    return ((*k, n) for k, n in counts.items())


class Model:
    """Bigram emissions of all states, smoothed by the kind of the first character, as log-likelihoods against the clean state."""

    def __init__(self, texts: list[str] | None = None, counts: Iterable[tuple[int, str, str, float]] = ()):
        """Model of the bigrams of undamaged texts, or of ``counts`` of them as ``bigrams`` gives them."""
        if texts is not None:
            counts = bigrams(words("\n".join(texts)))
        of = [Counter() for _ in _DAMAGES]
        for part in (counts, bigrams(Counter(_USUAL))):
            for state, a, b, n in part:
                # Words that no damage changes count for every state.
                for two in of if state < 0 else of[state : state + 1]:
                    two[a, b] += n
        self.first, self.pairs, self.kinds = [], of, []
        for two in of:
            one: Counter = Counter()
            kind: Counter = Counter()
            for (a, b), n in two.items():
                one[a] += n
                kind[_kind(a), b] += n
                kind[_kind(a), ""] += n
                kind["", b] += n
                kind["", ""] += n
            self.first.append(one)
            self.kinds.append(kind)
        self._cache: dict[tuple[str, str], np.ndarray] = {}
        self._evidence: dict[str, np.ndarray] = {}

    def ratio(self, a: str, b: str) -> np.ndarray:
        """log P(b | a, state) less that of the clean state, for all states."""
        found = self._cache.get((a, b))
        if found is None:
            k = _kind(a)
            p = np.array([0.85 * two[a, b] / max(one[a], 1) + 0.145 * kind[k, b] / max(kind[k, ""], 1) + 0.005 * kind["", b] / max(kind["", ""], 1) for one, two, kind in zip(self.first, self.pairs, self.kinds)])
            p[0] = max(p[0], _CLEAN_FLOOR if ord(b) > 127 else 0.02 if ord(a) > 127 else _FLOOR)
            found = self._cache[a, b] = np.log(np.maximum(p, _FLOOR)) - math.log(p[0])
        return found

    def evidence(self, token: str) -> np.ndarray:
        """What a token adds, per state, to a path that passes through it, and at the most to one that begins or ends in it."""
        found = self._evidence.get(token)
        if found is None:
            if len(self._evidence) > 200_000:
                self._evidence.clear()
            at = sorted({j for m in _HIGH.finditer(token) for i in range(m.start() + 1, m.end() + 1) for j in (i, i + 1)})
            framed = [f"{a}{token}{b}" for a in " \n" for b in " \n"]
            best = np.array([np.max([self.ratio(f[i - 1], f[i])[1:] for f in framed], axis=0) for i in at])
            found = self._evidence[token] = np.array([best.sum(axis=0), np.maximum(best, 0).sum(axis=0)])
        return found

    def may_be_damaged(self, text: str | None) -> bool:
        """Whether a path through another state can beat the clean one; no text in which one does is passed over.

        The best run of tokens of one state is bounded by its sums. A path of several states pays more for a change than
        for entering and leaving, so it wins only where one of its states would by itself.
        """
        if not text or text.isascii():
            return False
        tokens = [t for t in text.replace("\n", " ").split(" ") if not t.isascii()]
        both = np.array([self.evidence(t) for t in tokens])
        through, partly = both[:, 0], both[:, 1]
        if partly.max() <= 0:
            return False
        past = np.cumsum(through, axis=0)
        run = past + np.maximum.accumulate(partly - past, axis=0)
        best = partly.max()
        if len(run) > 1:
            best = max(best, (run[:-1] + partly[1:]).max())
        return bool(best > _ENTER + _LEAVE - 1e-6)

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """Spans ``(start, end, state)`` that are not clean."""
        at = sorted({j for m in _HIGH.finditer(text) for i in range(m.start(), m.end()) for j in (i, i + 1) if j < len(text)})
        if not at:
            return []
        n, cache = len(_NAMES), self._cache
        score = np.full(n, -_ENTER)
        score[0] = 0.0
        back = np.empty((len(at), n), np.int16)
        states = np.arange(n, dtype=np.int16)
        for k, i in enumerate(at):
            if k == 0:
                back[0] = 0
            else:
                lead = int(score.argmax())
                enter, change = score[0] - _ENTER, score[lead] - _CHANGE
                z, source = (enter, 0) if enter >= change else (change, lead)
                row = back[k]
                row[:] = source
                np.copyto(row, states, where=score >= z)
                row[0] = 0
                new = np.maximum(score, z)
                new[0] = score[0]
                if lead and score[lead] - _LEAVE > score[0]:
                    new[0], row[0] = score[lead] - _LEAVE, lead
                score = new
            pair = (text[i - 1] if i else " ", text[i])
            score += cache[pair] if pair in cache else self.ratio(*pair)
        score[1:] -= _LEAVE
        path = np.empty(len(at), np.int16)
        path[-1] = score.argmax()
        for k in range(len(at) - 1, 0, -1):
            path[k - 1] = back[k][path[k]]
        spans: list[tuple[int, int, str]] = []
        before = 0
        for i, s in zip(at, path):
            if s and s == before:
                spans[-1] = (spans[-1][0], i + 1, spans[-1][2])
            elif s:
                spans.append((i, i + 1, _NAMES[s]))
            before = s
        return [(a, b, name) for a, b, name in spans if not text[a:b].isascii()]


def restore(text: str, model: Model, depth: int = 3) -> tuple[str, list[str]]:
    """The text with every labelled span put right where its bytes allow, and the names of the states found."""
    states: list[str] = []
    for _ in range(depth):
        spans = model.label(text)
        out, at = [], 0
        for a, b, name in spans:
            out.append(text[at:a])
            out.append(_inverse(text[a:b], name))
            at = b
            if name not in states:
                states.append(name)
        new = "".join(out) + text[at:]
        if new == text:
            break
        text = new
    return text, states


def _pieces(part: str, kin: list[str]) -> str:
    """The longest beginnings of a run that some state restores, one after another."""
    out, at = [], 0
    while at < len(part):
        for end in range(len(part), at, -1):
            fixed = next((f for n in kin if (f := _try(STATES[n][1], part[at:end])) is not None), None)
            if fixed is not None:
                break
        out.append(part[at] if fixed is None else fixed)
        at = at + 1 if fixed is None else end
    return "".join(out)


def _try(back: Callable[[str], str], part: str) -> str | None:
    try:
        return back(part)
    except UnicodeError:
        return None


def _inverse(part: str, name: str) -> str:
    if name == "lost":
        return part
    back = STATES[name][1]
    try:
        return back(part)
    except UnicodeError:
        pass

    right = name.split(" as ")[0]
    kin = [name, *(n for n in STATES if n.startswith(f"{right} as ") and n != name)]

    def run(m: re.Match) -> str:
        for n in kin:
            try:
                return STATES[n][1](m.group())
            except UnicodeError:
                continue
        if right == "utf-8":
            # The soft hyphen, second byte of í, is often removed from a page; so is that of Í.
            after = part[m.end() : m.end() + 1]
            return re.sub("Ã(?![\x80-\xbf])", "Í" if after.isupper() else "í", _pieces(m.group(), kin))
        return m.group()

    return _HIGH.sub(run, part)


def train(rows: DataFrame) -> Model:
    """Model of all undamaged rows of ``(text)``; their bigrams are counted where the rows lie, so that only bigrams reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: Counter = Counter()
        columns = ["state", "a", "b", "n"]
        for batch in batches:
            for t in batch["text"]:
                if t and not suspicious(t):
                    kinds.update(_WORD.findall(t + "\n"))
            if len(kinds) > _HELD:
                yield pd.DataFrame(bigrams(_with_capitals(kinds)), columns=columns)
                kinds = Counter()
        yield pd.DataFrame(bigrams(_with_capitals(kinds)), columns=columns)

    counts = rows.select("text").mapInPandas(run, "state int, a string, b string, n double").groupBy("state", "a", "b").agg(F.sum("n").alias("n"))
    return Model(counts=sorted(tuple(r) for r in counts.collect()))


def garbled(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """``(texto_id, campo, entrada, estados, texto)`` of ``(texto_id, markdown, notas)``: damaged fields and their repair.

    ``entrada`` is the place within ``notas``, null for ``markdown``; ``texto`` is the field restored as far as its bytes
    allow. Null and empty fields and null entries are never damaged; repeated rows give repeated results; an empty table
    gives none.
    """
    rows = rows.select("texto_id", "markdown", "notas")
    if model is None:
        model = train(rows.select(F.col("markdown").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, notes in zip(batch["texto_id"], batch["markdown"], batch["notas"]):
                for campo, k, t in [("markdown", None, text), *(("notas", k, t) for k, t in enumerate(notes if notes is not None else ()))]:
                    if model.may_be_damaged(t):
                        fixed, states = restore(t, model)
                        if states:
                            out.append((i, campo, k, states, fixed))
            yield pd.DataFrame(out, columns=["texto_id", "campo", "entrada", "estados", "texto"]).astype({"entrada": "Int32"})

    return rows.mapInPandas(run, "texto_id bigint, campo string, entrada int, estados array<string>, texto string")
