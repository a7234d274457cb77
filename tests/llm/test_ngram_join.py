import random
import re

import numpy as np
import pytest

from changetree.llm import ngram_join as nj
from changetree.llm.components import components
from changetree.llm.words import shingle_set, texts_words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(ASCII))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids, where = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in ids:
        shared = {}
        for s in sets[i]:
            for j in where[s]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(nj.op1_ngram_join(spark, folder)) == brute(rows)


@pytest.mark.parametrize("cell", [512, 2])
def test_families_of_near_copies(spark, docs, monkeypatch, cell):
    """Chains and clusters whose members link only through others, shared passages, and edge sizes."""
    monkeypatch.setattr(nj, "CELL", cell)
    monkeypatch.setattr(nj, "PART", 8 * cell)
    r = random.Random(5)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(400))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice((9, 30, 120)))]
        for step in range(9):
            rows.append(list(base) + (passage if r.random() < 0.4 else []))
            for _ in range(max(1, len(base) // r.choice((40, 90, 25)))):
                base[r.randrange(len(base))] = word()
    rows += [passage[: r.randrange(40, 60)] for _ in range(20)]
    rows = [(7 * i + 3, " ".join(w)) for i, w in enumerate(rows)]
    assert result(nj.ngram_join(docs(rows))) == brute(rows)


def test_edge_cases(spark, docs):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB "), (6, "a b c d e"), (7, "É x"), (8, "é x"), (9, long), (10, long + " end"), (11, "a b"), (None, "a b")]
    got = sorted((tuple(r) for r in nj.ngram_join(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    want = [(i, *v) for i, v in brute([x for x in rows if x[0] is not None]).items()] + [(None, 1, None)]
    assert got == sorted(want, key=str)
    assert nj.ngram_join(docs([])).collect() == []
    twice = nj.ngram_join(docs([(5, "a b c"), (5, "a b c"), (6, "d e"), (5, "d e"), (9, "d  e")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(5, 5), (5, 5), (5, 5), (6, 5), (9, 5)]


def test_ids_that_repeat_with_an_empty_text(spark, docs):
    """A row without words beside one with words of the same id, in either order; the id has one component."""
    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    near = text + " again"
    got = nj.ngram_join(docs([(1, text), (1, None), (2, near), (5, ""), (6, None), (6, "")])).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles > 0) for r in got) == [(1, 1, False), (1, 1, True), (2, 1, True), (5, 5, False), (6, 6, False), (6, 6, False)]
    got = nj.ngram_join(docs([(1, text), (2, near), (2, ""), (3, near), (3, " "), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 1), (3, 1)]


def test_keep_one(spark, docs):
    rows = [(3, "a b c d e f g h"), (2, "a b c d e f g h"), (8, "other words here"), (None, "a b c d e f g h"), (9, None)]
    kept = nj.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 8, 9, None]


def test_divide_skip_counts_overlaps():
    rng = np.random.default_rng(1)
    query = np.unique(rng.integers(0, 500, 120).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64)) for _ in range(40)] + [query]
    need = [int(rng.integers(1, 60)) for _ in sets]
    exact = [len(np.intersect1d(query, s)) for s in sets]
    assert nj.divide_skip(query, sets, need) == [n if n >= k else -1 for n, k in zip(exact, need)]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 3000, rng.integers(1, 2500)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert nj.least_difference(nj.parity_sketch(x), nj.parity_sketch(y)) <= len(np.setxor1d(x, y))
    assert nj.least_difference(nj.parity_sketch(x), nj.parity_sketch(x)) == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(900, 900 + k) for k in range(50)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "u long, v long")).collect())
    head = {i: i for e in edges for i in e}
    for _ in head:
        for u, v in edges:
            head[u] = head[v] = min(head[u], head[v])
    assert got == {i: h for i, h in head.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_words_are_split_as_text(texts):
    rows = [*texts.values(), None, "", "ÀB c", "x" * 100_000]
    hashes = [*texts_words(rows)]
    split = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(ASCII)) for t in rows]
    assert [len(h) for h in hashes] == [len(w) for w in split]
    seen = {}
    for h, w in zip(hashes, split):
        for a, b in zip(h.tolist(), w):
            assert seen.setdefault(b, a) == a
    assert len({*seen.values()}) == len(seen)
    assert all(len(shingle_set(h)) == len(s) for h, s in zip(hashes, sets_of(enumerate(rows)).values()))
