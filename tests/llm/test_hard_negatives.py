"""Hard-negative mining against exact integers."""

import math
import random

import numpy as np

from changetree.llm import hard_negatives as hn


def by_hand(rows):
    """rows: (vec_id, label, vector), as the docstring of mine() says."""
    once = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            once[i] = min(once.get(i, (label, v, q)), (label, v, q))
    out = []
    for a, (label, _, q) in once.items():
        if a % 100:
            continue
        near = [(-sum(x * y for x, y in zip(q, p)), i, own) for i, (own, _, p) in once.items() if i != a]
        for s, i, own in sorted(x for x in near if x[2] == label)[:5]:
            hard = sorted(x for x in near if x[2] != label and -80 * s <= -100 * x[0] <= -100 * s)[:5]
            out += [(a, i, k, j, -s, -t) for k, (t, j, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rb string")
    return sorted(tuple(r) for r in hn.mine(df, **kw).collect())


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    for bound, width in ((3, 1), (300, 64), (5000, 300), (2**20, 700), (2**29, 5)):
        a, b = rng.integers(-bound, bound + 1, (9, width)), rng.integers(-bound, bound + 1, (11, width))
        primes = hn.primes_for(bound * bound * width)
        got = hn.scores(hn.residues(a.astype(float), primes), hn.residues(b.astype(float), primes), primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    top = np.array([[2.0**30, -(2.0**30)]])
    primes = hn.primes_for(2**62)
    assert hn.scores(hn.residues(top, primes), hn.residues(-top, primes), primes).tolist() == [[-(2**61)]]


def test_smallest_table(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = by_hand(rows)
    assert want and sorted(tuple(r) for r in hn.op11_hard_negatives(spark, sf).collect()) == want


def test_many_blocks_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 40)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    rng = random.Random(8)
    few = [[rng.choice([0.0, 0.25, 0.5, -0.1]) for _ in range(3)] for _ in range(6)]
    rows = [(10 * k, rng.randrange(3), list(rng.choice(few))) for k in range(-20, 180)]
    rows += [(300, 0, few[0]), (300, 2, few[1]), (5, 1, [0.5]), (6, 1, []), (7, None, few[0]), (None, 1, few[0]), (8, 1, None), (9, 0, [None, 1.0, 1.0]), (11, 0, [math.nan, 1.0]), (12, 0, [math.inf, 0.0, 0.0]), (13, 0, [1e9, 0.0, 0.0])]
    want = by_hand(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_long_vectors_and_empty_tables(spark):
    rng = random.Random(9)
    rows = [(50 * k, k % 2, [rng.uniform(2.0, 3e6) for _ in range(8)]) for k in range(30)]
    want = by_hand(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0])]) == [] and mined(spark, [(100, 0, [1.0])]) == []
