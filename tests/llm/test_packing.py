from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm import packing as P


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20), st.booleans())
def test_plan_places_every_item_once_and_fills_no_container_above_its_capacity(histogram, top_up):
    rows, opened = P.plan(histogram, 64, top_up)
    rows = sorted(map(tuple, rows))
    load = Counter()
    for size, n in histogram.items():
        runs = [r for r in rows if r[0] == size]
        assert runs[0][1] == 0
        for k in range(n):
            _, first, start, each = next(r for r in reversed(runs) if r[1] <= k)
            load[start + (k - first) // each] += size
    assert not load or (max(load.values()) <= 64 and set(load) == set(range(opened)))


def test_harmonic_classes():
    rows, opened = P.plan({60: 3, 30: 5, 7: 20}, 64, top_up=False)
    assert [tuple(r) for r in rows] == [(60, 0, 0, 1), (30, 0, 3, 2), (7, 0, 6, 9)] and opened == 9


@pytest.mark.parametrize("top_up", [True, False])
def test_table(spark, top_up):
    sizes = [1 + (k * 37) % 900 for k in range(3000)] + [0, None, 1000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens int").repartition(7).selectExpr("*", "1 as n")
    got = P.pack(df, 1000, top_up).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    load = Counter()
    for r in got:
        assert (r.contenedor is None) == (not r.tokens)
        if r.contenedor is not None:
            load[r.contenedor] += r.tokens
    assert max(load.values()) <= 1000
    if top_up:
        assert sum(load.values()) > 0.98 * 1000 * len(load)


def test_texts(spark):
    df = spark.createDataFrame([(1, "uno dos tres"), (2, None), (3, ""), (4, "palabra " * 9000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = P.pack(P.token_pieces(df)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 3, 4, 5} and len(by[4]) > 1 and all(len(by[k]) == 1 for k in (1, 2, 3, 5))
    long = sorted(by[4], key=lambda r: r.pieza)
    assert all(a.hasta == b.desde for a, b in zip(long, long[1:])) and all(r.tokens <= 4096 for r in long) and long[0].tokens == 4096
    assert by[2][0].contenedor is None
    assert P.pack(P.token_pieces(df.where("false"))).count() == 0


def test_fill(spark):
    rows = spark.createDataFrame([(0, 4000), (0, 96), (1, 2048), (None, 0)], "contenedor bigint, tokens int")
    assert tuple(P.fill(rows).first()) == (2, 2, 6144, 0.75)
    assert tuple(P.fill(rows.where("false")).first()) == (0, 0, 0, None)
