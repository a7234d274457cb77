"""Operator 11, hard-negative mining: exact integer scores by a residue-number-system GEMM, then windowed selection.

Vectors are quantised to integers. Rows and anchors are dealt into blocks of bounded size, and each pair of a row block with an
anchor block is one group. There the residues modulo several small primes are multiplied in float32, which is exact as
long as a chunk's sums stay below 2**24, and Chinese remaindering gives the signed scores. The anchors are a stated query set
against all rows: every row is scored against every anchor, in blocks, and a group sends on its best few rows only; a window
over them chooses. A first pass finds the positives, a second the negatives within each positive's range of scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, persisted, table

ROWS, ANCHORS = 2048, 1024  # rows and anchors in a block, on average
#: Residues lie within half a prime of 0, so CHUNK products of two of them sum to less than 2**24.
PRIMES = [509, 503, 499, 491, 487, 479, 467, 463]
CHUNK = 256
#: The longest squared norm whose scores surely fit a long.
MOST_SQUARE = float(1 << 62)
NONE = np.iinfo(np.int64).min


def quantised(vectors) -> np.ndarray:
    """floor(256 * x) of each component as float64, which holds it exactly; shorter vectors are padded with 0."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(256 * np.asarray(v, np.float64))
    return out


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all scores from -bound to bound apart."""
    out: list[int] = []
    while reduce(int.__mul__, out, 1) <= 2 * bound + 1:
        out.append(PRIMES[len(out)])
    return out


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """x modulo each prime, within half of it, as float32."""
    out = []
    for p in primes:
        r = np.fmod(x, p)
        r -= p * np.rint(r / p)
        out.append(r.astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact inner products of the rows behind the residues a with those behind b, as int64."""
    size = reduce(int.__mul__, primes, 1)
    half, digits = size // 2, []
    for p, x, y in zip(primes, a, b):
        r = np.full((len(x), len(y)), half % p, np.int64)  # shifted by half, so that all are in 0 .. size - 1
        for k in range(0, x.shape[1], CHUNK):
            r += (x[:, k : k + CHUNK] @ y[:, k : k + CHUNK].T).astype(np.int64)
        r %= p
        weight = 1
        for q, d in zip(primes, digits):  # take off what smaller places hold, then divide by their product
            r -= d * (weight % p)
            weight *= q
        digits.append(r % p * pow(weight, -1, p) % p)
    out, weight = np.zeros(digits[0].shape, np.uint64), 1
    with np.errstate(over="ignore"):
        for p, d in zip(primes, digits):
            out += d.astype(np.uint64) * np.uint64(weight % (1 << 64))
            weight *= p
        return (out - np.uint64(half % (1 << 64))).view(np.int64)


def best(s: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the most columns of each row with the highest s where fits; ties go to earlier columns."""
    n = s.shape[1]
    if not s.size:
        return np.zeros(0, int), np.zeros(0, int)
    if np.abs(s).max() < (1 << 62) // n:
        key = np.where(fits, s * n + np.arange(n - 1, -1, -1), NONE)
        columns = np.argpartition(key, max(n - most, 0), axis=1)[:, max(n - most, 0) :]
    else:
        columns = np.lexsort((np.broadcast_to(np.arange(n), s.shape), -s, ~fits), axis=1)[:, :most]
    row = np.repeat(np.arange(len(s)), columns.shape[1])
    column = columns.ravel()
    ok = fits[row, column]
    return row[ok], column[ok]


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each id, by ascending id: the one with the smallest label, then vector."""
    if pdf["vec_id"].duplicated().any():
        pdf = pdf.assign(order=[(x, tuple(v)) for x, v in zip(pdf["label"], pdf["vector"])]).sort_values(["vec_id", "order"]).drop_duplicates("vec_id")
    return pdf.sort_values("vec_id")


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _scored(rows: pd.DataFrame, anchors: pd.DataFrame, primes: list[int]):
    """For few anchors at a time: (the anchors, ids of the rows, their labels, scores)."""
    rows, anchors = _once(rows), _once(anchors)
    if not len(rows) or not len(anchors):
        return
    x, y = quantised(anchors["vector"].to_list()), quantised(rows["vector"].to_list())
    width = max(x.shape[1], y.shape[1])
    x, y = _padded(x, width), residues(_padded(y, width), primes)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    for k in range(0, len(x), 256):
        yield anchors.iloc[k : k + 256], ids, labels, scores(residues(x[k : k + 256], primes), y, primes)


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row whose id is divisible by
    every, and each of its positives, the other rows of its label with the highest scores, the rows of other
    labels with the highest scores from 0.8 times the positive's score up to that score. Ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do rows whose squared
    norm after quantising reaches 2**62, because their scores needn't fit a long. Shorter vectors count as padded with zeros. Rows
    that share an id count once: the one with the smallest label, then vector. An empty table, or an anchor without
    positives or negatives, gives no rows. Other columns aren't read."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * 256).cast("double"), F.lit(2)))
    v = v.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)
    v = persisted(v.withColumn("square", square).where(F.col("square") < MOST_SQUARE))
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors, longest = v.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1)), F.max("square")).first()
    primes = primes_for(int((longest or 0) * (1 + 1e-6)) + 1)
    row_blocks, anchor_blocks = -(-n // ROWS) or 1, -(-n_anchors // ANCHORS) or 1
    block = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    everywhere = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = v.select("vec_id", "label", "vector", block(row_blocks).alias("rb"), everywhere(anchor_blocks).alias("ab"))
    apart = v.sparkSession.read.schema(v.schema).parquet(v.table_path)  # with columns of its own
    anchors = apart.where(is_anchor).select("vec_id", "label", "vector", block(anchor_blocks).alias("ab"))

    def against(queries: DataFrame, found, layout: str) -> DataFrame:
        placed = queries.select("*", everywhere(row_blocks).alias("rb"))
        return rows.groupBy("rb", "ab").cogroup(placed.groupBy("rb", "ab")).applyInPandas(found, layout)

    def nearest(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype=np.int64)]
        for some, ids, labels, s in _scored(rows, anchors, primes):
            own = some["vec_id"].to_numpy()
            at, c = best(s, (labels == some["label"].to_numpy()[:, None]) & (ids != own[:, None]), positives)
            out.append(pd.DataFrame({"anchor_id": own[at], "positive_id": ids[c], "positive_score": s[at, c]}))
        return pd.concat(out)

    near = against(anchors, nearest, "anchor_id long, positive_id long, positive_score long")
    first = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    chosen = persisted(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")))

    def hard(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")}, dtype=np.int64)]
        for some, ids, labels, s in _scored(rows, anchors, primes):
            others = labels != some["label"].to_numpy()[:, None]
            for k in range(positives):
                own = [x[k] if k < len(x) else None for x in some["positives"]]
                has = np.array([x is not None for x in own])
                high = np.array([x["positive_score"] if x is not None else 0 for x in own], np.int64)
                low = high - high // 5  # 80 % of it, rounded up
                at, c = best(s, others & has[:, None] & (s <= high[:, None]) & (s >= low[:, None]), negatives)
                ids_p = np.array([x["positive_id"] if x is not None else 0 for x in own], np.int64)
                out.append(pd.DataFrame({"anchor_id": some["vec_id"].to_numpy()[at], "positive_id": ids_p[at], "negative_id": ids[c], "positive_score": high[at], "negative_score": s[at, c]}))
        return pd.concat(out)

    queries = anchors.join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    met = against(queries, hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    best_first = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    met = persisted(met.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= negatives))
    dropped(v, chosen)
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label is (label + 1) % 10."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return mine(v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP11_SQL = """WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
        CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(r.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""
