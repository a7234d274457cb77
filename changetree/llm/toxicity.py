"""Operator 12, toxicity: class-conditional Kneser-Ney models of the letters of words.

A word's letters, with marks around it, are predicted from the five signs before each. The counts of the highest order belong to one class,
toxic or ordinary: words count once for each learning document that holds them, so that a document can't outvote others by
repeating itself. Their discounted mass falls back on lower orders that both classes share: Kneser-Ney continuation
counts (distinct signs on the left) over the words of all documents, labelled or not. A toxic text is ordinary language
with a share of toxic expressions, so its likelihood mixes both models; the difference of the two
log-likelihoods, divided by the text's length, becomes a probability by a logistic curve fitted on labelled
documents that the counts leave out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, free_name, give_back, persisted, small_batches, table
from .ngram_join import filter_of, probed
from .quality import held_out
from .words import BASE, mix

WORD = re.compile(r"[^\W\d_]+")
ORDER = 6
START, END = "^", "$"  # no letters, so they can't be in a word
SHARED_DISCOUNT = 0.75
#: What is subtracted from each class count: all of a count of 1, so that what one document says isn't evidence.
DISCOUNT = 1.0
#: Share of a toxic text's words that are toxic expressions.
SHARE = 0.02
#: Words added to a text's length, so that a few words decide little.
SHORT = 8
#: Entries of the model that are broadcast at most (12 bytes each); a larger model is joined instead.
MOST_ENTRIES = 1 << 22
#: Words that a task holds before it hands on what it counted.
HELD = 1 << 18


def words(text) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def grams(word: str) -> list[str]:
    padded = START * (ORDER - 1) + word + END
    return [padded[k : k + ORDER] for k in range(len(word) + 1)]


def _corpus_grams(batches):
    """The distinct grams of the words of each part of the corpus."""
    seen: set[str] = set()

    def out():
        return pd.DataFrame({"gram": list({g for w in seen for g in grams(w)})}, dtype=object)

    for pdf in batches:
        for text in pdf["text"]:
            seen.update(words(text))
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()
    give_back()


def _class_grams(batches):
    """(gram, ordinary, toxic): over the learning documents, the sum of their distinct words that hold the gram."""
    held = (Counter(), Counter())

    def out():
        found: dict[str, list[int]] = {}
        for kind, counter in enumerate(held):
            for word, n in counter.items():
                for g in grams(word):
                    found.setdefault(g, [0, 0])[kind] += n
        return pd.DataFrame([(g, *n) for g, n in found.items()], columns=["gram", "ordinary", "toxic"])

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            held[toxic].update(set(words(text)))
            if len(held[0]) + len(held[1]) > HELD:
                yield out()
                held[0].clear(), held[1].clear()
    yield out()
    give_back()


def shared_probabilities(corpus: DataFrame) -> DataFrame:
    """(gram, p) for each gram of ORDER - 1 signs in the distinct grams of ORDER signs: the probability of its last sign after
    the others, from the numbers of distinct signs on the left at this and all lower orders."""
    levels, grams_now = [], corpus
    for _ in range(ORDER - 1):
        grams_now = persisted(grams_now.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        levels.append(grams_now)
    lower = None
    for size, level in enumerate(reversed(levels), 1):
        around = W.partitionBy(F.expr(f"substring(gram, 1, {size - 1})"))
        level = level.withColumn("total", F.sum("n").over(around)).withColumn("kinds", F.count(F.lit(1)).over(around))
        below = F.lit(1.0) / F.col("kinds")
        if lower is not None:
            level = level.withColumn("tail", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
            below = F.col("below")
        p = (F.col("n") - SHARED_DISCOUNT + SHARED_DISCOUNT * F.col("kinds") * below) / F.col("total")
        done, lower = lower, persisted(level.select("gram", p.alias("p")))
        if done is not None:
            dropped(done)
    dropped(*levels)
    return lower


def ratios(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """(gram, value): the logarithm of the toxic over the ordinary probability of a gram's last sign after the others, and for the
    ORDER - 1 signs before it the value of every sign not listed. What equals the value it would get anyway is left out."""
    around = W.partitionBy("before")
    c = counts.withColumn("before", F.expr(f"substring(gram, 1, {ORDER - 1})"))
    for kind in ("ordinary", "toxic"):
        total, kinds = F.sum(kind).over(around), F.sum((F.col(kind) > 0).cast("int")).over(around)
        c = c.withColumn(f"total_{kind}", total).withColumn(f"rest_{kind}", F.when(total > 0, DISCOUNT * kinds / total).otherwise(1.0))
    c = persisted(c)
    rest = F.log(F.col("rest_toxic") / F.col("rest_ordinary"))
    before = c.groupBy("before").agg(F.first(rest).alias("value")).where("value <> 0").select(F.col("before").alias("gram"), "value")
    listed = c.where((F.col("ordinary") > DISCOUNT) | (F.col("toxic") > DISCOUNT)).withColumn("tail", F.expr("substring(gram, 2)"))
    listed = listed.join(shared.select(F.col("gram").alias("tail"), "p"), "tail")
    p = lambda kind: F.when(F.col(f"total_{kind}") > 0, F.greatest(F.col(kind) - DISCOUNT, F.lit(0)) / F.col(f"total_{kind}")).otherwise(0.0) + F.col(f"rest_{kind}") * F.col("p")
    out = persisted(listed.select("gram", F.log(p("toxic") / p("ordinary")).alias("value")).unionByName(before))
    dropped(c)
    return out


def codes(signs: str) -> np.ndarray:
    return np.frombuffer(signs.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def keys(signs: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many signs."""
    return keys_at(signs, size, slice(0, max(len(signs) - size + 1, 0)))


def keys_at(signs: np.ndarray, size: int, places) -> np.ndarray:
    """The same for the runs that begin at these places."""
    windows = np.lib.stride_tricks.sliding_window_view(signs, size)[places]
    h = np.full(len(windows), np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ windows[:, k]) * BASE
            h ^= h >> np.uint64(29)
        return mix(h)


class Ratios:
    """Values of grams and of the signs before them, in a table by hash: each entry lies at its slot or in the next free ones."""

    def __init__(self, names: list[str], values: np.ndarray):
        h = np.zeros(len(names), np.uint64)
        for size in (ORDER - 1, ORDER):
            own = [k for k, g in enumerate(names) if len(g) == size]
            if own:
                h[own] = keys(codes("".join(names[k] for k in own)), size)[::size]
        self.shift = np.uint64(64 - max(4, (4 * len(names)).bit_length()))
        order = np.argsort(h)
        slots = (h[order] >> self.shift).astype(np.int64)
        at = np.maximum.accumulate(slots - np.arange(len(h))) + np.arange(len(h))
        self.keys, self.values = np.zeros((1 << int(64 - self.shift)) + len(h) + 1, np.uint64), np.zeros(0, np.float32)
        self.values = np.zeros(len(self.keys), np.float32)
        self.keys[at], self.values[at] = h[order], values[order]

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, nan where there is none."""
        out = np.full(len(h), np.nan, np.float32)
        left, at = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            found = self.keys[at]
            hit = found == h[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (found != 0)
            left, at = left[more], at[more] + 1
        return out

    def words(self, some: list[str]) -> np.ndarray:
        """The logarithm of the toxic over the ordinary probability of each word."""
        if not some:
            return np.zeros(0)
        signs = codes("".join(START * (ORDER - 1) + w + END for w in some))
        value = self.get(keys(signs, ORDER))
        rest = np.flatnonzero(np.isnan(value))
        value[rest] = np.nan_to_num(self.get(keys_at(signs, ORDER - 1, rest)))
        sizes = np.array([len(w) + ORDER for w in some])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        total = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
        return total[starts + sizes - ORDER + 1] - total[starts]


def mixed(ratio):
    """The logarithm of the mixed toxic over the ordinary probability of words."""
    return np.log(1 - SHARE + SHARE * np.exp(np.minimum(ratio, 50.0)))


def text_values(model: Ratios, texts, known: dict[str, float] | None = None) -> list[float]:
    """For each text the difference of its log-likelihoods, divided by its length in words; 0 without words. known holds
    words' values from one batch to the next."""
    known = {} if known is None else known
    split = [words(t) for t in texts]
    if len(known) > HELD:
        known.clear()
    some = list(set().union(*split).difference(known))
    known.update(zip(some, mixed(model.words(some)).tolist()))
    return [sum(map(known.__getitem__, x)) / (len(x) + SHORT) for x in split]


def values_by_join(texts: DataFrame, model: DataFrame) -> DataFrame:
    """texts (row, text) as (row, value), as text_values() gives it, with a model of any size: each distinct word gets its value
    by a join of its grams, each text by a join of its words."""

    @F.pandas_udf("array<string>")
    def split(some: pd.Series) -> pd.Series:
        return some.map(words)

    @F.pandas_udf("array<string>")
    def cut(some: pd.Series) -> pd.Series:
        return some.map(grams)

    held = persisted(texts.select("row", split("text").alias("words")))
    per_text = held.select("row", F.explode("words").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    of_word = per_text.select("word").distinct().select("word", F.explode(cut("word")).alias("gram"))
    of_word = of_word.withColumn("before", F.expr(f"substring(gram, 1, {ORDER - 1})"))
    of_word = of_word.join(model, "gram", "left").join(model.select(F.col("gram").alias("before"), F.col("value").alias("other")), "before", "left")
    ratio = of_word.groupBy("word").agg(F.sum(F.coalesce("value", "other", F.lit(0.0))).alias("ratio"))
    ratio = ratio.select("word", F.log(1 - SHARE + SHARE * F.exp(F.least("ratio", F.lit(50.0)))).alias("value"))
    sums = per_text.join(ratio, "word").groupBy("row").agg(F.sum(F.col("value") * F.col("n")).alias("total"))
    return held.join(sums, "row", "left").select("row", (F.coalesce("total", F.lit(0.0)) / (F.size("words") + SHORT)).alias("value"))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability at a value, by Newton steps with a weak pull towards a fixed curve."""
    at = np.array([100.0, -6.0])
    w, pull = at.copy(), np.array([1e-4, 1e-2])
    a = np.stack((x, np.ones_like(x)), 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (p - y) + pull * (w - at))
        w = w - np.clip(step, [-20, -1], [20, 1])
    return max(float(w[0]), 1.0), float(w[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """docs with held_out, score and predicted behind its columns (underscores are added to names that docs has
    already); one row for each row of docs, in which repeated rows get equal scores.

    labels has doc_id and toxic; of an id's several labels the largest counts, null ids and labels aren't used. Three quarters of the labelled
    documents of the learning folds are counted, by a hash of the id, and of the rest about most_rows are used for the
    curve (twice as many at most). Null and empty texts, and texts without letters, have the value 0, which the curve turns into a score as
    any other. Without a usable label scores follow from the fixed curve at 0. An empty table gives an empty
    result. A model of more than most_entries entries isn't broadcast but joined; the scores are the same to 1e-4."""
    spark = docs.sparkSession
    small_batches(spark)
    held, score, predicted = (free_name(docs, c) for c in ("held_out", "score", "predicted"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Of all texts only those that a Bloom filter of the labelled ids may hold are shuffled to their labels, at any size in the same way.
    known = labels.select(F.col("doc_id").alias("id"), "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    for_curve = F.crc32(F.concat(F.col("id").cast("string"), F.lit("c")).cast("binary")) % 4 == 0
    known = persisted(known.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("for_curve", for_curve))
    asked = spark.sparkContext.broadcast(filter_of(known.select(F.xxhash64("id").alias("h"))))
    labelled = probed(texts.withColumn("h", F.xxhash64("id")), asked, True).join(known.hint("merge"), "id")
    labelled = persisted(labelled.select("id", "text", "toxic", "for_curve"))
    corpus = persisted(texts.select("text").mapInPandas(_corpus_grams, "gram string").distinct())
    shared = shared_probabilities(corpus)
    learnt = labelled.where("NOT for_curve").select("text", "toxic")
    counts = learnt.mapInPandas(_class_grams, "gram string, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    table_of = ratios(counts, shared)
    dropped(corpus, shared)
    small = table_of.count() <= most_entries
    if small:
        found = table_of.toPandas()
        model = spark.sparkContext.broadcast(Ratios(found["gram"].to_list(), found["value"].to_numpy()))

        @F.pandas_udf("double")
        def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, float] = {}
            for some in batches:
                yield pd.Series(text_values(model.value, some, known), dtype=float)

    def valued(rows: DataFrame, text: str, name: str) -> DataFrame:
        if small:
            return rows.withColumn(name, value(F.col(f"`{text}`")))
        key = free_name(rows, "row_key")
        rows = persisted(rows.withColumn(key, F.monotonically_increasing_id()))
        by_row = values_by_join(rows.select(F.col(key).alias("row"), F.col(f"`{text}`").alias("text")), table_of)
        return rows.join(by_row.select(F.col("row").alias(key), F.col("value").alias(name)), key).drop(key)

    tests = labelled.where("for_curve")
    n = tests.count()
    if n > most_rows:
        tests = tests.where(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < int(most_rows / n * (1 << 24)))
    some = valued(tests.select("text", "toxic"), "text", "value").select("toxic", "value").limit(2 * most_rows).toPandas().sort_values(["value", "toxic"])
    dropped(known, labelled)
    y = some["toxic"].to_numpy(float)
    slope, offset = curve(some["value"].to_numpy(float), y) if len(y) else (100.0, -6.0)
    name = free_name(docs, "value")
    out = valued(docs, text_col, name).withColumn(held, held_out(F.col(f"`{id_col}`")))
    out = out.withColumn(score, 1 / (1 + F.exp(-F.greatest(F.least(F.col(name) * slope + offset, F.lit(30.0)), F.lit(-30.0)))))
    return out.drop(name).withColumn(predicted, (F.col(score) >= 0.7).cast("int"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")
