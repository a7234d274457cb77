"""Toxicity models against dictionaries, the join against the broadcast model, and held-out labels."""

import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest

from changetree.llm import toxicity as tx

ORDINARY = "the river over stone bread window morning paper table garden letter simple".split()
TOXIC = ["blarg", "snivelwort", "grubbik"]


def corpus(seed=2, n=240):
    """(docs, labels): a tenth and more of the documents hold some of the toxic words."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(ORDINARY) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(2 + len(text) // 30):
                text[rng.randrange(len(text))] = rng.choice(TOXIC)
        docs.append((k, " ".join(text).capitalize() + "."))
        labels.append((k, 0, int(toxic)))
    return docs, labels


def by_hand(texts, learnt):
    """The value of each word, from dictionaries: texts of the corpus and (text, toxic) of the counted documents."""
    seen = {g for t in texts for w in tx.words(t) for g in tx.grams(w)}
    levels, now = {}, seen
    for size in range(tx.ORDER - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in now)
        now = set(levels[size])
    total, kinds = Counter(), Counter()
    for level in levels.values():
        for g, n in level.items():
            total[len(g), g[:-1]] += n
            kinds[len(g), g[:-1]] += 1

    def shared(g):
        around = len(g), g[:-1]
        low = shared(g[1:]) if len(g) > 1 else 1 / kinds[around]
        return (levels[len(g)][g] - tx.SHARED_DISCOUNT + tx.SHARED_DISCOUNT * kinds[around] * low) / total[around]

    counts = (Counter(), Counter())
    for text, toxic in learnt:
        counts[toxic].update(g for w in set(tx.words(text)) for g in tx.grams(w))
    sums = [Counter() for _ in counts]
    types = [Counter() for _ in counts]
    for c, s, t in zip(counts, sums, types):
        for g, n in c.items():
            s[g[:-1]] += n
            t[g[:-1]] += 1

    def p(kind, g):
        n = sums[kind][g[:-1]]
        if not n:
            return shared(g[1:])
        return (max(counts[kind][g] - tx.DISCOUNT, 0) + tx.DISCOUNT * types[kind][g[:-1]] * shared(g[1:])) / n

    return {w: sum(log(p(1, g) / p(0, g)) for g in tx.grams(w)) for t in texts for w in tx.words(t)}


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_word_values_equal_dictionaries(spark, tables):
    docs, labels = ([tuple(r) for r in t.collect()] for t in tables)
    learnt = [(t, labels[k][2]) for k, (_, t) in enumerate(docs) if k % 3]
    text = spark.createDataFrame(docs, "doc_id long, text string").select("text")
    shared = tx.shared_probabilities(text.mapInPandas(tx._corpus_grams, "gram string").distinct())
    counted = spark.createDataFrame(learnt, "text string, toxic int").mapInPandas(tx._class_grams, "gram string, ordinary long, toxic long")
    found = tx.ratios(counted.groupBy("gram").agg(*(tx.F.sum(c).alias(c) for c in ("ordinary", "toxic"))), shared).toPandas()
    model = tx.Ratios(found["gram"].to_list(), found["value"].to_numpy())
    want = by_hand([t for _, t in docs], learnt)
    some = sorted(want)
    assert np.allclose(model.words(some), [want[w] for w in some], atol=1e-4)
    assert max(want, key=want.get) in TOXIC
    value = tx.text_values(model, ["blarg, the!", None, "", "12 34"])
    wanted = sum(log(1 - tx.SHARE + tx.SHARE * exp(want[w])) for w in ("blarg", "the")) / (2 + tx.SHORT)
    assert np.allclose(value, [wanted, 0, 0, 0], atol=1e-4)


def test_catches_toxic_documents_and_spares_others(tables):
    docs, labels = tables
    got = tx.toxicity_scores(docs, labels).toPandas()
    held = got[got.held_out]
    toxic = held.doc_id % 6 == 0
    assert held.predicted[toxic].mean() >= 0.9 and held.predicted[~toxic].sum() == 0
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_joined_model_gives_the_same_scores(tables):
    docs, labels = tables
    one = {r.doc_id: r.score for r in tx.toxicity_scores(docs, labels).collect()}
    two = {r.doc_id: r.score for r in tx.toxicity_scores(docs, labels, most_entries=0).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-4


def test_nulls_empty_long_repeats_and_clashing_names(spark, tables):
    docs, labels = tables
    odd = [(1, None), (1, ""), (None, "blarg"), (7, "x" * 300_000), (7, "x" * 300_000), (8, "the river " * 50_000)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    more = more.selectExpr("doc_id", "text", "'a' AS score", "'b' AS value", "'c' AS row_key", "'d' AS id")
    extra = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (0, 0, 0)], labels.schema))
    got = tx.toxicity_scores(more, extra).collect()
    assert len(got) == docs.count() + len(odd) and got[0].score == "a" and all(0 <= r.score_ <= 1 for r in got)
    assert len({r.score_ for r in got if r.doc_id == 7 and r.text.startswith("xx")}) == 1
    assert len({r.score_ for r in got if not r.text}) == 1
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    none = tx.toxicity_scores(docs, labels.where("false")).collect()
    assert len(none) == docs.count() and {r.predicted for r in none} == {0}
    assert tx.toxicity_scores(docs.where("false"), labels).count() == 0
