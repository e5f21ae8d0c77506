"""Evaluation passages inside documents: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A window is as long as its item, at most ``WINDOW`` words. It is walked along by a random function: step ``j`` outputs
the word under the pointer and moves on or stays, by bit ``j`` of a hash of that word. Windows at a small edit distance
so become strings at a small Hamming distance; sampling steps from all parts of the walk gives a key, and several independent walks,
every other one from the window's end, give several keys. All windows of a batch of documents walk at once in vector
operations. Equal windows share all keys; a window with one word changed, put in or left out shares one with a
probability of 0.97 and more, as the tests measure. Windows that share a key are compared by exact edit distance, with
as many words of the document as the edits allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.words import mix, odd_constants, word_ids
from tamiz.session import cut

WINDOW, STEPS, SAMPLED, WALKS = 12, 14, 6, 4
#: Words of the shortest items that are searched; a run of fewer is no passage.
SHORTEST = 6
#: Words of evaluation text that one pass may hold in a worker's memory (about 100 bytes each); more are taken in blocks.
BLOCK_WORDS = 500_000
#: Words of documents that walk at once.
GROUP_WORDS = 1_000_000
#: Pairs of windows that are compared at once.
PAIRS = 1_000_000
_BITS = 22


class Walks:
    """The random functions and sampled steps of all walks over windows of ``size`` words."""

    def __init__(self, size: int = WINDOW, walks: int = WALKS, seed: int = 5):
        rng = np.random.default_rng(seed)
        span = max(SAMPLED, STEPS * size // WINDOW)
        self.size = size
        self.turns = odd_constants(walks, seed + 1)
        # One step out of each part of the walk, so that every key sees words from one end of the walk to the other.
        cuts = np.linspace(0, span, SAMPLED + 1).astype(int)
        self.steps = [np.array([rng.integers(x, y) for x, y in zip(cuts, cuts[1:])]) for _ in range(walks)]

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """One key array per walk, for the windows that begin at ``starts``; every other walk goes from the end."""
        kind = np.int32 if len(ids) < 2**31 else np.int64
        low = starts.astype(kind)
        high = low + kind(self.size - 1)
        for k, (turn, steps) in enumerate(zip(self.turns, self.steps)):
            h = mix(ids * turn)
            back = k % 2 == 1
            at, key = (high if back else low).copy(), np.full(len(low), turn)
            for j in range(int(steps[-1]) + 1):
                here = h[at]
                if j in steps:
                    key = (key ^ here) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                move = ((here >> np.uint64(j)) & np.uint64(1)).astype(kind)
                if back:
                    at -= move
                    np.maximum(at, low, out=at)
                else:
                    at += move
                    np.minimum(at, high, out=at)
            yield mix(key)


def window_edits(a: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray, b: np.ndarray, q: np.ndarray, size: int, edits: int, back: bool) -> np.ndarray:
    """Word edit distances of the windows of ``b`` at ``q`` from the best run of ``a`` that begins at ``p`` (``back``: ends where its window ends).

    Runs stay within ``first`` and ``last`` of their documents; distances above ``edits`` come out as some greater number.
    """
    far = np.int16(size + edits + 1)
    step = -1 if back else 1
    p0, q0 = (p + size - 1, q + size - 1) if back else (p, q)
    total, live = np.full(len(p), far, np.int16), np.arange(len(p))
    cost = [np.full(len(p), k if k >= 0 else far, np.int16) for k in range(-edits, edits + 1)]
    for i in range(1, size + 1):
        item, new = b[q0 + step * (i - 1)], []
        for k in range(-edits, edits + 1):
            j = i + k
            best = np.full(len(p0), far, np.int16)
            if j >= 1:
                at = p0 + step * (j - 1)
                inside = (at >= first) & (at < last)
                same = inside & (a[np.clip(at, 0, len(a) - 1)] == item)
                best = np.where(inside, cost[k + edits] + ~same, best)
                if k > -edits:
                    best = np.where(inside, np.minimum(best, new[-1] + 1), best)
            elif j == 0:
                best = np.full(len(p0), i, np.int16)
            if k < edits:
                best = np.minimum(best, cost[k + edits + 1] + 1)
            new.append(best.astype(np.int16))
        cost = new
        if i % 3 == 0 or i == size:
            # What is beyond the edits already stays there.
            keep = np.minimum.reduce(cost) <= edits
            live, p0, q0, first, last = live[keep], p0[keep], q0[keep], first[keep], last[keep]
            cost = [c[keep] for c in cost]
    total[live] = np.minimum.reduce(cost)
    return total


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


class Index:
    """Windows of the evaluation texts by key."""

    def __init__(self, items: list[tuple[int, np.ndarray]], walks: Walks):
        size = walks.size
        items = [(i, w) for i, w in items if len(w) >= size]
        self.walks, self.ids = walks, np.concatenate([w for _, w in items]) if items else np.empty(0, np.uint64)
        base = np.cumsum([0] + [len(w) for _, w in items])
        self.starts = np.concatenate([np.arange(b, b + len(w) - size + 1) for b, (_, w) in zip(base, items)]) if items else np.empty(0, np.int64)
        self.owner = np.concatenate([np.full(len(w) - size + 1, i, np.int64) for i, w in items]) if items else np.empty(0, np.int64)
        self.tables = []
        for key in walks.keys(self.ids, self.starts) if items else ():
            order = np.argsort(key, kind="stable")
            hit = np.zeros(1 << _BITS, bool)
            hit[(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((key[order], order, hit))

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Per walk the positions in ``starts``, the windows of the index with the same key, and whether the walk went from the end."""
        if not len(self.starts):
            return
        for k, (key, (keys, order, hit)) in enumerate(zip(self.walks.keys(ids, starts), self.tables)):
            at = np.flatnonzero(hit[(key >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[at]), np.searchsorted(keys, key[at], "right")
            n = hi - lo
            if n.sum():
                rep = np.repeat(np.arange(len(at)), n)
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                yield at[rep], order[lo[rep] + nth], k % 2 == 1


def indexes(items: list[tuple[int, np.ndarray]], walks: int, shortest: int) -> list[Index]:
    """One index of the items of ``WINDOW`` words and more, and one per length of the shorter ones, with twice the walks."""
    sizes = {min(len(w), WINDOW) for _, w in items if len(w) >= shortest}
    return [Index([(i, w) for i, w in items if min(len(w), WINDOW) == size], Walks(size, walks if size == WINDOW else 2 * walks)) for size in sorted(sizes)]


def _scan(tables: list[Index], edits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[int, int], int] = {}
            group, held = [], 0
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"]):
                group.append((doc, word_ids(text)))
                held += len(group[-1][1])
                if held > GROUP_WORDS:
                    scan(group, out)
                    group, held = [], 0
            scan(group, out)
            yield pd.DataFrame([(d, i, e) for (d, i), e in out.items()], columns=["doc_id", "item_id", "edits"])

    def scan(group: list[tuple[int, np.ndarray]], out: dict[tuple[int, int], int]) -> None:
        words = [w for _, w in group]
        if not words:
            return
        ids = np.concatenate(words)
        base = np.cumsum([0] + [len(w) for w in words])
        docs = np.array([d for d, _ in group])
        for index in tables:
            size = index.walks.size
            starts = np.concatenate([np.arange(b, max(b, b + len(w) - size + 1)) for b, w in zip(base, words)])
            for at, to, back in ((a[k : k + PAIRS], t[k : k + PAIRS], back) for a, t, back in index.candidates(ids, starts) for k in range(0, len(a), PAIRS)):
                p, q = starts[at], index.starts[to]
                of = np.searchsorted(base, p, "right") - 1
                found = window_edits(ids, p, base[of], base[of + 1], index.ids, q, size, edits, back)
                near = found <= edits
                rows = pd.DataFrame({"d": docs[of[near]], "i": index.owner[to[near]], "e": found[near]}).groupby(["d", "i"])["e"].min()
                for pair, e in rows.items():
                    out[pair] = min(int(e), out.get(pair, int(e)))

    return run


def _blocks(rows: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Evaluation texts as word ids, ``BLOCK_WORDS`` at a time; the driver holds one block."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for r in rows.toLocalIterator():
        ids = word_ids(r.text)
        if held and held + len(ids) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((r.item_id, ids))
        held += len(ids)
    yield block


def leaked(documents: DataFrame, items: DataFrame, edits: int = 1, walks: int = WALKS, shortest: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, edits)``: documents with a run of words at most ``edits`` word edits from a window of the item.

    ``documents`` is ``(doc_id bigint, text)``, ``items`` is ``(item_id bigint, text)``, one row per field of an item.
    A window has 12 words, or all words of an item of fewer, if it has ``shortest``. Documents are scanned in place,
    without a shuffle, once for each block of the evaluation set (``BLOCK_WORDS``); with several blocks each one's pairs
    are written before the next is read. Null and shorter texts on either side match nothing; an item or text that
    comes repeatedly gives one row per pair; ``edits`` is the smallest found.
    """
    rows = items.where("item_id is not null and text is not null").select("item_id", "text")
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found: DataFrame | None = None
    blocks = _blocks(rows)
    block = next(blocks)
    while block is not None:
        part = texts.mapInPandas(_scan(indexes(block, walks, shortest), edits), "doc_id bigint, item_id bigint, edits int")
        block = next(blocks, None)
        if block is not None or found is not None:
            part = cut(part)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def question_fields(preguntas: DataFrame) -> DataFrame:
    """The two fields of an item that count, one row each."""
    return preguntas.select(F.col("id").alias("item_id"), F.explode(F.array("pregunta", "respuesta_esperada")).alias("text"))
