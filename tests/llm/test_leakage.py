import random

import numpy as np
import pytest

from tamiz.llm import leakage as L
from tamiz.llm.words import word_ids

WORDS = [f"w{k}x" for k in range(3000)]


def windows(text):
    ids = word_ids(text).tolist()
    return {tuple(ids[i : i + 12]) for i in range(len(ids) - 11)}


@pytest.mark.parametrize("block", [500_000, 60])
def test_exact_runs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_WORDS", block)
    r = random.Random(8)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(r.randrange(8, 40)))) for k in range(25)] + [(90, None), (91, ""), (None, "x"), (3, "otra " * 15)]
    docs = []
    for k in range(60):
        ws = [r.choice(WORDS) for _ in range(80)]
        if k % 3 == 0:
            src = items[r.randrange(25)][1].split()
            a = r.randrange(max(1, len(src) - 11))
            ws[20:20] = [w.upper() + "," for w in src[a : a + r.randrange(10, 16)]]
        docs.append((k, " ".join(ws)))
    docs += [(200, None), (201, ""), (202, "Otra: " * 12), (203, docs[0][1])]
    got = {(x.doc_id, x.item_id) for x in L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).where("edits = 0").collect()}
    want = {(d, i) for d, t in docs if t for i, u in items if u and i is not None and windows(t) & windows(u)}
    assert got == want and (202, 3) in want


def edited(words, kind, r):
    at = r.randrange(1, len(words) - 1)
    return words[:at] + ({"sub": ["cambiada"], "ins": ["puesta", words[at]], "del": []}[kind]) + words[at + 1 :]


@pytest.mark.parametrize("kind", ["sub", "ins", "del"])
@pytest.mark.parametrize("size", [6, 8, 12, 14])
def test_recall_at_one_edit(spark, kind, size):
    """Of items of one window (14 words: of three) with a word changed, put in or left out, nine of ten are found and more."""
    r = random.Random(size)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(size))) for k in range(300)]
    docs = [(k, " ".join([r.choice(WORDS) for _ in range(20)] + edited(t.split(), kind, r) + [r.choice(WORDS) for _ in range(9)])) for k, t in items]
    got = L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), shortest=6).collect()
    assert len({x.doc_id for x in got if x.doc_id == x.item_id and x.edits <= 1}) >= 0.9 * len(items)


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("edits", [1, 2])
def test_window_edits_against_brute_force(back, edits):
    r = np.random.default_rng(3)
    a, b, size = r.integers(0, 4, 60).astype(np.uint64), r.integers(0, 4, 40).astype(np.uint64), 7
    p, q = np.repeat(np.arange(54), 34), np.tile(np.arange(34), 54)
    first, last = np.where(p < 30, 0, 25), np.where(p < 30, 45, 60)
    got = L.window_edits(a, p, first, last, b, q, size, edits, back)
    for i in range(0, len(p), 7):
        item = b[q[i] : q[i] + size]
        runs = [a[e + 1 - n : e + 1] for e in [p[i] + size - 1] for n in range(size - edits, size + edits + 1) if e < last[i] and e + 1 - n >= first[i]] if back else [a[p[i] : p[i] + n] for n in range(size - edits, size + edits + 1) if p[i] + n <= last[i]]
        want = min((L.edit_distance(item, x) for x in runs), default=99)
        assert (got[i] == want) if want <= edits else got[i] > edits


def test_edit_distance_and_alignment():
    a, b = word_ids("a1 b2 c3 d4 e5"), word_ids("a1 c3 d4 e5 f6")
    assert L.edit_distance(a, b) == 2 and L.edit_distance(a, a) == 0


def test_equal_windows_share_all_keys():
    w = L.Walks()
    ids = np.concatenate([word_ids(" ".join(WORDS[:12])), word_ids(" ".join(WORDS[50:60])), word_ids(" ".join(WORDS[:12]))])
    for key in w.keys(ids, np.array([0, 22])):
        assert key[0] == key[1]


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert L.leaked(d, i).count() == 0 and L.leaked(d.where("false"), i).count() == 0
