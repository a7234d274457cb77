"""Operator 5, benchmark decontamination: spaced-seed hashing.

A spaced seed is a fixed mask over a few neighbouring words of which some positions are ignored, so that a
substituted word spoils only the seeds that look at it. Seeds of the benchmark's items are joined with
those of the documents; around a hit the item is laid over the document and words that agree are counted.
The benchmark side of the join is dealt in blocks of a fixed number of seeds, each of which is broadcast:
a larger benchmark makes more blocks, never a larger broadcast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, table
from .words import STEP, mix, texts_words

U = np.uint64
# The masks; 1 is a position that counts. Four words each, over spans of four to nine.
MASKS = ["1111", "110101", "1001011", "101000011"]
# Masks besides for items of fewer than SHORT words. With them every way to place the substitutions that
# 80 % allows leaves a seed whole, in items of 4 to 25 words (all ways were tried).
SHORT, SHORT_MASKS = 7, ["11011", "10111", "11101"]
#: Bits of the table that tells most seeds apart before they are looked up.
SIEVE = 1 << 22


def lowered(texts):
    """The word hashes of the texts in lower case, whatever the script."""
    return texts_words(t.lower() if isinstance(t, str) else None for t in texts)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each place of the mask; none where the words are fewer than its span."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        h = np.full(n, U(len(mask)), U)
        for k, c in enumerate(mask):
            if c == "1":
                h = (h ^ words[k : k + n]) * STEP
                h ^= h >> U(29)
        return mix(h)


def masks_of(words: np.ndarray) -> list[str]:
    """The masks for an item: MASKS, with SHORT_MASKS for a short one, or all of its words where they are fewer
    than the shortest mask's."""
    if len(words) < min(map(len, MASKS)):
        return ["1" * len(words)]
    return MASKS + SHORT_MASKS if len(words) < SHORT else MASKS


class Block:
    """Some benchmark items: their words, and their seeds sorted by hash with item and place."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        found = [(h, i, p) for i, (_, words) in enumerate(items) for m in masks_of(words) for p, h in enumerate(seeds(words, m).tolist())]
        found.sort()
        self.masks = sorted({m for _, words in items for m in masks_of(words)})
        self.hashes = np.array([f[0] for f in found], U)
        self.item, self.place = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.hashes % U(SIEVE)).astype(np.int64)] = True

    def starts(self, words: np.ndarray) -> np.ndarray:
        """(item, where it would begin) of every hit, each once, in order; some hits at a time are spread out."""
        out = [np.empty(0, np.int64)]  # item and start in one number
        for m in self.masks:
            h = seeds(words, m)
            at = np.flatnonzero(self.sieve[(h & U(SIEVE - 1)).astype(np.int64)]) if len(h) else np.empty(0, np.int64)
            low, high = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            at, low, n = (x[high > low] for x in (at, low, high - low))
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) >> 18)) + 1):
                times = n[part]
                j = np.repeat(low[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
                out.append(np.unique((self.item[j] << 40) + np.repeat(at[part], times) - self.place[j] + (1 << 39)))
        found = np.unique(np.concatenate(out))
        return np.stack((found >> 40, (found & ((1 << 40) - 1)) - (1 << 39)))

    def overlaps(self, words: np.ndarray) -> dict[int, tuple[int, int]]:
        """For each item hit in a text: (words that agree, where the item begins) at its best place, the first of equal ones."""
        best: dict[int, tuple[int, int]] = {}
        for i, start in self.starts(words).T.tolist():
            item = self.items[i][1]
            if i in best and best[i][0] == len(item):
                continue
            a, b = max(start, 0), min(start + len(item), len(words))
            agree = int(np.count_nonzero(words[a:b] == item[a - start : b - start]))
            if agree > best.get(i, (0, 0))[0]:
                best[i] = (agree, start)
        return best


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most_seeds: int):
    """Blocks of about most_seeds seeds, in the order of items; rows come to the driver one partition
    at a time. Items without words are left out."""
    held, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).orderBy(item_col).toLocalIterator():
        words = next(lowered([row[1]]))
        if not len(words):
            continue
        held.append((row[0], words))
        size += len(words) * len(MASKS)
        if size >= most_seeds:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, least_share: float = 0.8, most_seeds: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """docs with contaminated, n_items, item, agreeing and share behind its columns (underscores are added
    to names that docs has already); one row for each row of docs.

    A document is contaminated when at least least_share of an item's words agree with the document's at one place
    (words are lower-cased and split at white space; substitutions are tolerated, shifts are not). n_items
    counts such items; item, agreeing and share describe the best one (most of its words agreeing, then
    the smallest id) and are null without one. Items of fewer than four words must agree whole. Null and
    empty texts, and null or empty items, match nothing.
    Repeated rows are all kept; empty tables are allowed."""
    spark = docs.sparkSession
    small_batches(spark)
    names = [free_name(docs, c) for c in ("contaminated", "n_items", "item", "agreeing", "share")]
    hit, item_type = free_name(docs, "hit"), benchmark.schema[item_col].dataType.simpleString()
    schema = f"n_items long, item {item_type}, agreeing long, share double"

    def find(shared):
        @F.pandas_udf(schema)
        def run(texts: pd.Series) -> pd.DataFrame:
            out = []
            for words in lowered(texts):
                good = [(-n / len(shared.value.items[i][1]), shared.value.items[i][0], n) for i, (n, _) in shared.value.overlaps(words).items() if n >= least_share * len(shared.value.items[i][1])]
                first = min(good) if good else (None, None, None)
                out.append((len(good), first[1], first[2], -first[0] if good else None))
            return pd.DataFrame(out, columns=["n_items", "item", "agreeing", "share"]).astype({"n_items": "int64", "agreeing": "Int64", "share": "Float64"} | ({"item": "Int64"} if item_type in ("bigint", "int") else {}))

        return run

    found = [find(spark.sparkContext.broadcast(b))(F.col(text_col)) for b in blocks(benchmark, item_col, item_text_col, most_seeds)]
    if not found:
        empty = [F.lit(False), F.lit(0).cast("long"), F.lit(None).cast(item_type), F.lit(None).cast("long"), F.lit(None).cast("double")]
        return docs.select("*", *[c.alias(n) for c, n in zip(empty, names)])
    marked = docs.withColumn(hit, F.array(*found))
    total = F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + x["n_items"])
    best = F.array_min(F.transform(F.filter(hit, lambda x: x["n_items"] > 0), lambda x: F.struct((-x["share"]).alias("s"), x["item"].alias("item"), x["agreeing"].alias("agreeing"))))
    out = marked.select(*[F.col(f"`{c}`") for c in docs.columns], total.alias(names[1]), best.alias(hit))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(names[1]) > 0).alias(names[0]), names[1], F.col(hit)["item"].alias(names[2]), F.col(hit)["agreeing"].alias(names[3]), (-F.col(hit)["s"]).alias(names[4]))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_items", F.col("item").alias("item_id"), "agreeing", F.round("share", 6).alias("share"))
