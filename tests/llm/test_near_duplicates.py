import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.llm import near_duplicates as N
from tamiz.llm.words import shingles, word_ids
from tamiz.operators.components import connected_components

WORDS = [f"palabra{k}" for k in range(400)]


def corpus(seed):
    """Texts with edited copies at several similarities, exact copies and a hot group."""
    r = random.Random(seed)
    rows = []
    for k in range(30):
        base = [r.choice(WORDS) for _ in range(r.randrange(40, 200))]
        rows.append((f"d{k:03d}", " ".join(base)))
        for c in range(r.randrange(4)):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0.02, 0.05, 0.1, 0.2]))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((f"d{k:03d}c{c}", " ".join(w)))
    hot = " ".join(WORDS[:120])
    rows += [(f"h{k:03d}", hot if k % 2 else f"{hot} {WORDS[200 + k]}") for k in range(40)]
    return rows + [("nulo", None), ("vacio", ""), ("corto", "uno dos"), ("d000", rows[0][1]), ("mayus", rows[0][1].upper() + "!!")]


def brute(rows, threshold=0.5):
    sets = [(n, set(shingles(word_ids(t)).tolist())) for n, t in rows if t]
    parent = {n: n for n, s in sets if s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[1]], 2):
        if len(x & y) >= threshold * len(x | y):
            parent[find(a)] = find(b)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def groups(links):
    found = {}
    for r in connected_components(links).collect():
        found.setdefault(r.component, set()).add(r.node)
    return {frozenset(g) for g in found.values() if len(g) > 1}


@pytest.mark.parametrize("neighbours", [128, 8])
def test_against_brute_force(spark, monkeypatch, neighbours):
    """Buckets within and far above the number of neighbours give the groups that all pairs give."""
    monkeypatch.setattr(N, "NEIGHBOURS", neighbours)
    rows = corpus(1)
    got = groups(N.text_links(spark.createDataFrame(rows, "node string, text string")))
    assert got == brute(rows)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "node string, text string")
    assert N.text_links(e).count() == 0
    assert N.set_links(spark.createDataFrame([], "node string, items array<string>")).count() == 0


def test_sets(spark):
    rows = [("a", ["1", "2", "3", "3"]), ("b", ["1", "2", "3", "4", "5", "6"]), ("c", ["1", "2", "x", "y"]), ("d", ["1", "2"]), ("e", ["1", "2"]), ("f", None), ("g", [None, "9"])]
    assert groups(N.set_links(spark.createDataFrame(rows, "node string, items array<string>"))) == {frozenset("ab")}


def test_canonical_urls(spark):
    urls = ["http://www.Gaceta.Example/Base/x.html#a", "https://gaceta.example/Base/x.html/", "gaceta.example/Base/x.html", "https://gaceta.example/base/x.html"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").select(N.canonical_url(F.col("u")).alias("u")).collect()]
    assert got[0] == got[1] == got[2] == "gaceta.example/Base/x.html" and got[3] != got[0]


def test_estimate_is_close():
    r = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        a = r.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[:200], r.integers(0, 2**63, 100, dtype=np.uint64)])
        errors.append((N.minima(a) == N.minima(b)).mean() - 200 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < N.SLACK


def test_clashing_and_extra_columns(spark):
    f = spark.createDataFrame([("a", ["http://x/1", "http://x/2", "http://x/3"], 1, "s"), ("b", ["https://www.x/1", "http://x/2/", "http://X/3#f"], 2, "t"), (None, None, 3, None)], "doc_id string, urls_alternativas array<string>, key int, same string")
    t = spark.createDataFrame([("c", "uno dos tres cuatro cinco seis", 1), ("b", "UNO dos, tres cuatro cinco seis", 2), (None, None, 3)], "doc_id string, texto string, component int")
    got = {}
    for r in N.norm_groups(f, t).collect():
        got.setdefault(r.grupo, set()).add(r.doc_id)
    assert list(got.values()) == [{"a", "b", "c"}]


def test_crowded_bucket_of_unlike_records(spark):
    """A third of every text is the same for all; of 3,000 texts, 60 have a copy with edits."""
    r = random.Random(4)
    common = [r.choice(WORDS) for _ in range(30)]
    rows, own = [], [f"propia{k}" for k in range(50_000)]
    for k in range(3000):
        rows.append((f"u{k:04d}", " ".join(common + [r.choice(own) for _ in range(60)])))
    pairs = set()
    for k in range(0, 3000, 50):
        w = rows[k][1].split()
        for _ in range(3):
            w[r.randrange(len(w))] = r.choice(own)
        rows.append((f"v{k:04d}", " ".join(w)))
        pairs.add(frozenset([f"u{k:04d}", f"v{k:04d}"]))
    assert groups(N.text_links(spark.createDataFrame(rows, "node string, text string"))) == pairs


@pytest.mark.parametrize("block", [8192, 70])
def test_every_pair_of_a_crowded_bucket_is_decided(spark, monkeypatch, block):
    """With a single band, pairs that share their bucket have no other one; in it, others with the same common part stand between them."""
    monkeypatch.setattr(N, "NEIGHBOURS", 2)
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(8)
    own = [f"propia{k}" for k in range(50_000)]
    common = [r.choice(WORDS) for _ in range(60)]
    rows = []
    for k in range(200):
        shared = [r.choice(own) for _ in range(16)]
        rows += [(f"{side}{k:04d}", " ".join(common + shared + [r.choice(own) for _ in range(22)])) for side in "uv"]
    key = {n: N.band_keys(N.minima(shingles(word_ids(t), 5)), 1, 1)[0] for n, t in rows}
    want = {g for g in brute(rows) if len({key[n] for n in g}) == 1}
    assert len(want) > 90 and groups(N.text_links(spark.createDataFrame(rows, "node string, text string"), rows=1, bands=1)) == want


def test_crowded_lists(spark, monkeypatch):
    """Lists whose common addresses fill buckets, with one more in common in pairs."""
    monkeypatch.setattr(N, "NEIGHBOURS", 2)
    rows = [(f"{side}{k:03d}", [f"c{i}" for i in range(6)] + [f"p{k}_{i}" for i in range(2)] + [f"{side}{k}_{i}" for i in range(4)]) for k in range(60) for side in "uv"]
    assert groups(N.set_links(spark.createDataFrame(rows, "node string, items array<string>"))) == {frozenset([f"u{k:03d}", f"v{k:03d}"]) for k in range(60)}


def test_one_bucket_of_fifty_thousand_is_linear(monkeypatch):
    """Every row of a bucket is rated against a fixed number of others, wherever batches end; copies are chained once."""
    rng = np.random.default_rng(6)
    rated = []
    monkeypatch.setattr(N, "NEIGHBOURS", 16)
    near = N._Neighbours(0.32, 0.68)
    for k in range(0, 50_000, 5000):
        ids = np.arange(k, k + 5000)
        assert near.add(np.zeros(5000, np.int64), ids, rng.integers(0, 256, (5000, N.RATED)).astype(np.uint8)) == []
        rated.append(len(near.keys))
    assert max(rated) == 16
    copies = N._Neighbours(0.32, 0.68)
    out = [x for k in range(0, 50_000, 5000) for x in copies.add(np.zeros(5000, np.int64), np.arange(k, k + 5000), np.ones((5000, N.RATED), np.uint8))]
    assert len(out) == 49_999


def test_groups_have_one_row_per_document(spark, data):
    from tamiz.llm import p3

    rows = p3.p3_groups(spark, data).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.grupo for r in rows} <= {r.doc_id for r in rows}
    pairs = {(r.doc_id_a, r.doc_id_b) for r in p3.p3_found(spark, data).collect()}
    assert pairs == {(a.doc_id, b.doc_id) for a in rows for b in rows if a.grupo == b.grupo and a.doc_id < b.doc_id}
