"""Lookups, containment and tracks of spans, against brute force, and how they grow."""

import random
import time

import pytest

from sylva.operators import spans as S


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
@pytest.mark.parametrize("strictly", [False, True])
def test_as_of(spark, width, strictly):
    r = random.Random(width)
    marks = [(f, r.randrange(60), m) for f in (1, 2, 3, None) for m in range(12)] + [(4, None, 5)]
    rows = [(f, r.randrange(70), i) for i in range(80) for f in (1, 2, 4, 9)] + [(1, None, 500), (None, 30, 501), (2, 0, 502), (2, 0, 502)]
    got = S.as_of(table(spark, rows, "k int, p int, i int"), table(spark, marks, "k int, _at int, _mark int"), ["k"], "p", "m", strictly, width).collect()
    before = (lambda a, p: a < p) if strictly else (lambda a, p: a <= p)

    def brute(k, p):
        own = [(a, m) for f, a, m in marks if f == k and a is not None and p is not None and before(a, p)]
        return max(own)[1] if own else None

    assert sorted(((x.k, x.p, x.i, x.m) for x in got if x.k is not None), key=repr) == sorted(((k, p, i, brute(k, p)) for k, p, i in rows if k is not None), key=repr)
    assert len(got) == len(rows)


@pytest.mark.parametrize("width", [None, 5])
def test_running(spark, width):
    r = random.Random(4)
    rows = [(f, p, r.choice([None, 1, 2, -3])) for f in (1, 2) for p in r.sample(range(100), 30)]
    got = S.running(table(spark, rows, "k int, p int, v int"), ["k"], ["p"], {"s": ("sum", S.F.col("v")), "m": ("max", S.F.col("v"))}, width).collect()
    for x in got:
        own = [v for k, p, v in rows if k == x.k and p <= x.p and v is not None]
        assert (x.s or 0, x.m) == (sum(own), max(own, default=None))
    assert len(got) == 60


@pytest.mark.parametrize("most", [3, 40, 5000])
def test_inside(spark, most):
    r = random.Random(most)
    points = [(f, r.randrange(6000), i) for i in range(200) for f in (1, 2)] + [(1, None, 900), (None, 3, 901), (1, 0, 902), (1, 0, 902)]
    spans = [(f, s, s + r.randrange(-1, most), i) for i in range(60) for f in (1, 2, 3) for s in [r.randrange(6000)]] + [(1, 0, 0, 70), (None, 0, 9, 71), (1, None, 5, 72)]
    got = S.inside(table(spark, points, "k int, p int, i int"), table(spark, spans, "k int, _lo int, _hi int, s int"), ["k"], "p")
    want = [(i, s) for k, p, i in points for f, a, b, s in spans if k is not None and k == f and p is not None and a is not None and a <= p <= b]
    assert sorted((x.i, x.s) for x in got.collect()) == sorted(want)
    assert S.inside(table(spark, points, "k int, p int, i int"), table(spark, [], "k int, _lo int, _hi int, s int"), ["k"], "p").count() == 0


@pytest.mark.parametrize("width", [None, 9])
def test_covered(spark, width):
    r = random.Random(9)
    rows = [(f, s, s + r.randrange(9), i) for i in range(90) for f in (1, 2, 3) for s in [r.randrange(80)]]
    spans = [(f, s, s + r.randrange(25)) for f in (1, 2) for s in r.sample(range(80), 4)] + [(1, None, 99)]
    got = S.covered(table(spark, rows, "k int, start int, end int, i int"), table(spark, spans, "k int, _lo int, _hi int"), ["k"], width=width).collect()
    assert sorted(((x.k, x.i), x.covered) for x in got) == sorted(((k, i), any(f == k and a is not None and a <= s and e <= b for f, a, b in spans)) for k, s, e, i in rows)


def test_tracks_are_lowest_disjoint_and_minimal(spark):
    r = random.Random(2)
    rows = [(f, s, s + r.randrange(0, 12), i) for i in range(150) for f in (1, 2, None) for s in [r.randrange(300)]] + [(3, None, 4, 0), (3, 0, 9, 1), (3, 9, 10, 2), (3, 0, 1, 3)]
    got = [tuple(x) for x in S.tracks(table(spark, rows, "k int, s int, e int, i int"), ["k"], "s", "e", ["i"]).collect()]
    assert len(got) == len(rows)
    for key in (1, 2, None, 3):
        ends, want = [], {}
        for s, e, i in sorted((s, e, i) for k, s, e, i in rows if k == key and s is not None):
            track = next((t for t, end in enumerate(ends) if end <= s), len(ends))
            ends[track : track + 1] = [max(s, e)]
            want[i] = track
        assert {i: t for k, s, _, i, t in got if k == key and s is not None} == want
        deep = max(sum(s <= at < e or s == at == e for k, s, e, _ in rows if k == key and s is not None) for at in range(310))
        assert len(ends) <= deep
    assert [t for _, s, _, _, t in got if s is None] == [None]


def test_tracks_across_batches(spark):
    """What is open goes on from one Arrow batch to the next."""
    rows = [(1, i, i + 3) for i in range(6000)]
    got = S.tracks(table(spark, rows, "k int, s int, e int"), ["k"], "s", "e").collect()
    assert all(x.track == x.s % 3 for x in got)


def test_containment_of_a_large_file_is_not_all_pairs(spark):
    """100,000 nodes in one file, 10,000 of them asked for: rows that the join takes in grow as the input, not as its square."""
    n = 100_000
    points = spark.range(n).selectExpr("1 as k", "id as p").repartition(8)
    spans = spark.range(0, n, 10).selectExpr("1 as k", "id as _lo", "least(id + id % 40, 99999) as _hi", "id as s")
    began = time.time()
    got = S.inside(points, spans, ["k"], "p")
    want = sum(min(i + i % 40, n - 1) - i + 1 for i in range(0, n, 10))
    assert got.count() == want
    assert time.time() - began < 60
    cut = spans.selectExpr(f"size({S.blocks_of('_lo', '_hi', 2)}) as n").agg({"n": "sum"}).first()[0]
    assert cut < 31 * n // 10
