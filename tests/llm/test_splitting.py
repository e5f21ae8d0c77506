import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm.splitting import doubled, split_spans, successors, words_of

SCHEMA = "tramo_id bigint, inicio int, limite int, tramo string, fines array<int>"


def walk(successor):
    cuts, b, n = [0], 0, len(successor) - 1
    while b != n:
        b = int(successor[b])
        cuts.append(b)
    return cuts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=400), st.integers(40, 90))
def test_doubling_finds_the_cuts_of_the_walk(classes, limit):
    cls = np.array([0, *classes], np.int8)
    s = successors(cls, limit, 30)
    assert (s[:-1] > np.arange(len(s) - 1)).all()
    assert np.flatnonzero(doubled(s, np.array([0]))).tolist() == walk(s)


def check(text, row, pieces, limit, overlap=30):
    assert pieces[0].inicio == row[1] and pieces[-1].fin == row[1] + len(text)
    for p in pieces:
        assert len(words_of(text[p.inicio - row[1] : p.fin - row[1]])[0]) == p.palabras <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert len(words_of(text[b.inicio - row[1] : a.fin - row[1]])[0]) == overlap


def test_pieces(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["uno", "dos.", "Tres", "cuatro;", "cinco,", "~~seis~~", "~~siete", "ocho~~"]) + r.choice(["", "", "\n\n"]) for _ in range(n)) for n in (1, 50, 51, 400, 3000)]
    rows = [(k, 7 * k, 50, t, None) for k, t in enumerate(texts)]
    got = {}
    for p in split_spans(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(p.tramo_id, []).append(p)
    for row in rows:
        pieces = sorted(got[row[0]], key=lambda p: p.k)
        assert (len(pieces) > 1) == (len(words_of(row[3])[0]) > 50)
        check(row[3], row, pieces, 50)


def test_natural_boundaries(spark):
    text = "palabra " * 45 + "fin.\n\nOtro " + "palabra " * 40 + "fin."
    p = sorted(split_spans(spark.createDataFrame([(1, 0, 60, text, None)], SCHEMA)).collect(), key=lambda p: p.k)
    assert text[: p[0].fin].endswith("fin.")


def test_edges(spark):
    rows = [(1, 0, 60, "", None), (2, None, 60, "una", None), (None, 0, 60, "x", None), (3, 0, None, "x", None), (4, 0, 60, None, None), (5, 0, 60, "~~todo tachado", None), (5, 0, 60, "~~todo tachado", None)]
    got = sorted((p.tramo_id, p.k, p.inicio, p.fin, p.palabras) for p in split_spans(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 0, 0, 0), (2, 0, 0, 3, 1), (5, 0, 0, 14, 0), (5, 0, 0, 14, 0)]
    assert split_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_across_strikes():
    assert words_of("foo~~x y~~bar baz ~~q")[0] == ["foobar", "baz"]


def test_limit_within_the_overlap_raises(spark):
    rows = spark.createDataFrame([(1, 0, 30, "uno dos tres", None)], "tramo_id bigint, inicio int, limite int, tramo string, fines array<int>")
    with pytest.raises(Exception, match="must exceed"):
        split_spans(rows).collect()
