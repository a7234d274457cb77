"""Operator 9, URL filters: character language-model ratio.

URLs that a rule accepts or rejects train two variable-order Markov models over bytes; each order's
estimate is smoothed by the next shorter one, as far as its context has been seen. A URL without a rule
is judged by the difference of its log-likelihoods a byte, against a threshold calibrated by folds:
each ruled URL is scored with its fold's counts taken off the total. Verdicts use the counts of all ruled URLs.

Counts are exact and grow with the input: an order's context and the byte behind it are one number, and
the counts of these numbers are Parquet tables. As an estimate depends on the longest context only, each
distinct number of the corpus gets its value once, by joins from order to order. URLs are dealt in chunks of bounded
size; the distinct numbers of a chunk fetch their values in a join, with which the chunk's URLs are scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, persisted, small_batches, table

#: Longest context in bytes, weight of the shorter context's estimate.
ORDER, WEIGHT = 5, 4.0
# Symbols are bytes, the end and what stands before the beginning; bits of a symbol.
END, START, BITS = 256, 257, 9
#: Bytes of the URLs that are scored together.
CHUNK = 1 << 18
#: Folds of the ruled URLs; width and number of the histogram's bins.
FOLDS, BIN, BINS = 5, 0.005, 4000
# The rules of the contract, (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of each predicted symbol: the symbol in the lowest bits, above it the ORDER symbols before it,
    the nearest first."""
    lengths = np.array([len(r) + 1 for r in raws], np.int64)
    rows = np.repeat(np.arange(len(raws)), lengths)
    flat = np.frombuffer(b"".join(r + b"\0" for r in raws), np.uint8).astype(np.int64)
    flat[np.cumsum(lengths) - 1] = END
    at = np.arange(len(flat)) + (rows + 1) * ORDER
    data = np.full(len(flat) + len(raws) * ORDER, START, np.int64)
    data[at] = flat
    out = np.zeros(len(flat), np.int64)
    for k in range(ORDER + 1):
        out |= data[at - k] << (BITS * k)
    return rows, out


def _chunked(batches):
    """The rows with a chunk: a task's rows of one fold, as many as CHUNK bytes hold; the lowest three bits are the fold."""
    made, task = 0, TaskContext.get().partitionId()
    open_chunks: dict[int, tuple[int, int]] = {}
    for batch in batches:
        out = []
        for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist()):
            number, held = open_chunks.get(fold, (0, CHUNK))
            if held >= CHUNK:
                number, held, made = made, 0, made + 1
            open_chunks[fold] = (number, held + len(text) + 1)
            out.append((task << 32 | number) << 3 | fold)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "chunk"])


def _counted(batches):
    """For each chunk its distinct grams and how often they stand in accepted and in rejected ruled URLs."""
    for batch in batches:
        chunks, said = np.array(batch.column(0)), batch.column(2).to_pylist()
        raws = batch.column(1).to_pylist()
        for chunk in np.unique(chunks):
            of = np.flatnonzero(chunks == chunk)
            rows, found = grams([raws[i] for i in of])
            which, where = np.unique(found, return_inverse=True)
            yes, no = (np.bincount(where, weights=np.array([said[i] == v for i in of], float)[rows], minlength=len(which)).astype(np.int64) for v in ("allow", "block"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), chunk)), pa.array(which), pa.array(yes), pa.array(no)], ["chunk", "gram", "yes", "no"])


def estimates(counts: DataFrame, names: list[str]) -> DataFrame:
    """gram and, for each name of a count column, the smoothed probability of its last symbol, from the rows
    (gram, counts...) of the longest contexts; grams without counts may stand among them."""
    levels = [counts]
    for k in range(ORDER - 1, -1, -1):
        levels.insert(0, persisted(levels[0].groupBy(F.col("gram").bitwiseAND((1 << BITS * (k + 1)) - 1).alias("gram")).agg(*[F.sum(n).alias(n) for n in names])))
    below = None
    for k, level in enumerate(levels):
        context = Window.partitionBy(F.shiftright("gram", BITS))
        level = level.select("gram", *names, *[F.sum(n).over(context).alias(f"{n}_all") for n in names])
        if k:
            level = level.withColumn("shorter", F.col("gram").bitwiseAND((1 << BITS * k) - 1)).join(below, "shorter")
        else:
            level = level.select("*", *[F.lit(1 / 257).alias(f"{n}_p") for n in names])
        out = level.select("gram", *[((F.col(n) + WEIGHT * F.col(f"{n}_p")) / (F.col(f"{n}_all") + WEIGHT)).alias(n) for n in names])
        below = out.select(F.col("gram").alias("shorter"), *[F.col(n).alias(f"{n}_p") for n in names])
    return out


def _scored(rows: pa.Table, values: pa.Table) -> pa.Table:
    """A chunk's rows with the means of the values of their grams, by all counts and without those of their fold."""
    gram = np.array(values["gram"])
    order = np.argsort(gram)
    of, found = grams(rows["text"].to_pylist())
    at, out = order[np.searchsorted(gram[order], found)], rows.select(["row", "said", "fold"])
    for name in ("score", "held"):
        out = out.append_column(name, pa.array(np.bincount(of, weights=np.array(values[name])[at]) / np.bincount(of)))
    return out


def calibrate(histogram: dict[tuple[bool, int], int]) -> float:
    """The threshold with the least mean of both classes' error rates: the middle of the best bins."""
    n = np.zeros((2, BINS))
    for (accepted, b), count in histogram.items():
        n[int(accepted), b] = count
    if not n.sum(axis=1).all():
        return 0.0
    missed = np.concatenate(([0], np.cumsum(n[1]))) / n[1].sum()
    passed = 1 - np.concatenate(([0], np.cumsum(n[0]))) / n[0].sum()
    best = np.flatnonzero(np.isclose(missed + passed, (missed + passed).min()))
    return float((best[0] + best[-1]) / 2 - BINS // 2) * BIN


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest rule that fits, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score behind its columns (underscores are added to names
    that pages has already); one row for each row of pages.

    The models read the whole URL as it stands, scheme, query and fragment too; host and path are for the rules. A null
    URL or one without :// has an empty host and path and no rule; a null one is judged as the empty text. Without ruled URLs of both classes the models don't differ and every other URL is allowed.
    Repeated rows are all kept and count as often as they stand; an empty table gives an empty result."""
    small_batches(pages.sparkSession)
    host, path, rule, verdict, score = (free_name(pages, c) for c in ("host", "path", "rule", "verdict", "score"))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = pages.withColumn(host, F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower())).withColumn(path, F.regexp_extract(url, pattern, 2))
    named, said = rule_of(F.col(host), F.col(path), rules)
    text = url.cast("binary")
    columns = [*(F.col(f"`{c}`") for c in pages.columns), F.col(host), F.col(path), named.alias(rule)]
    fold = F.when(said.isNotNull(), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")).otherwise(FOLDS)
    split = split.select(F.struct(*columns).alias("row"), said.alias("said"), text.alias("text"), fold.alias("fold"))
    rows = persisted(split.mapInArrow(_chunked, T.StructType([*split.schema, T.StructField("chunk", T.LongType())])))
    counted = persisted(rows.select("chunk", "text", "said").mapInArrow(_counted, "chunk long, gram long, yes long, no long"))
    own, kinds = F.col("chunk").bitwiseAND(7).cast("int"), ("yes", "no")
    counts = persisted(counted.groupBy("gram").agg(*[F.sum(F.when(own == j, F.col(c)).otherwise(0)).alias(f"{c}{j}") for j in range(FOLDS) for c in kinds]))
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns[1:]]).first()
    total = {c: sum(sums[f"{c}{j}"] for j in range(FOLDS)) for c in kinds}
    # A fold that holds all of a class can't be taken off; it is scored by all counts.
    apart = [j for j in range(FOLDS) if all(total[c] > sums[f"{c}{j}"] for c in kinds)]
    without = [sum(F.col(f"{c}{i}") for i in range(FOLDS) if i != j or j not in apart).alias(f"{c}{j}") for j in range(FOLDS + 1) for c in kinds]
    values = estimates(counts.select("gram", *without), [f"{c}{j}" for j in range(FOLDS + 1) for c in kinds])
    values = values.select("gram", F.array(*[F.log(f"yes{j}") - F.log(f"no{j}") for j in range(FOLDS + 1)]).alias("ratios"))
    values = counted.select("chunk", "gram").join(values, "gram").select("chunk", "gram", F.get("ratios", F.lit(FOLDS)).alias("score"), F.get("ratios", own).alias("held"))
    schema = T.StructType([*rows.select("row", "said", "fold").schema, T.StructField("score", T.DoubleType()), T.StructField("held", T.DoubleType())])
    judged = persisted(rows.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(_scored, schema))

    held = judged.where(F.col("fold") < FOLDS).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("held") / BIN).cast("int") + BINS // 2)))
    threshold = calibrate({(r[0], r[1]): r[2] for r in held.groupBy(F.col("said") == "allow", "bin").count().collect()}) if all(total.values()) else float("-inf")
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    given = [F.col("row")[c].alias(c) for c in (*pages.columns, host, path, rule)]
    return judged.select(*given, F.coalesce("said", by_model).alias(verdict), F.col("score").alias(score))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
