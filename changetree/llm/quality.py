"""Operator 10, quality classifier: positive-unlabelled learning with a non-negative risk.

A text's shape features, standardised over all texts, and fixed random combinations of them feed a linear score. Its risk is
prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)), whose second part would turn
negative by overfitting and is kept from it. With the squared loss every part depends on the data only through
first and second moments, so Spark sums these over all positives and all unlabelled texts, and the minimum is
found exactly: it solves a linear system for a weight of the second part that is 1, or less where that part would be
negative. The class prior is the share of label 1 where both labels are known, and else estimated from the margins of
positives and unlabelled texts; a bounded sample of labelled rows (a documented parameter)
turns scores into probabilities."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free_name, persisted, small_batches, table
from .words import texts_words

#: Groups of bytes whose shares are features.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\r\n", ".", ",", "!", "?", ":;", "'\"`", "()[]{}", "<>", "|", "%", "&", "#$", "*", "-_=+~", "/\\@^"]
NAMES_BEHIND = 16
N_FEATURES = len(GROUPS) + 1 + NAMES_BEHIND


def _group_table() -> np.ndarray:
    out = np.full(256, len(GROUPS))
    for i, chars in enumerate(GROUPS):
        out[[ord(c) for c in chars]] = i
    return out


GROUP_OF = _group_table()


def _entropy(counts: np.ndarray) -> float:
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


def features(texts) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; all zero for an empty or null one."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for row, (text, words) in zip(out, zip(texts, texts_words(texts))):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(words):
            continue
        counts = np.bincount(raw, minlength=256)
        shares = np.bincount(GROUP_OF, weights=counts, minlength=len(GROUPS) + 1) / len(raw)
        row[: len(GROUPS) + 1] = np.sqrt(shares)
        lines = text.split("\n")
        solid = [x for x in lines if x.strip()]
        unique, times = np.unique(words, return_counts=True)
        n = len(words)
        pairs = words[:-1] * np.uint64(31) + words[1:] if n > 1 else words
        distinct_pairs = len(np.unique(pairs))
        lengths = np.array([len(x) for x in solid])
        lines_times = Counter(solid)
        row[len(GROUPS) + 1 :] = (
            np.log1p(n),
            np.log1p(len(raw) / n),
            len(unique) / n,
            len(unique) / n**0.8,
            distinct_pairs / len(pairs),
            times.max() / n,
            float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
            _entropy(times),
            _entropy(times) / np.log(n + 1),
            _entropy(counts[counts > 0]),
            len(lines_times) / len(solid),
            np.log1p(len(solid)),
            np.log1p(lengths.mean()),
            np.log1p(lengths.std()),
            sum(x.rstrip()[-1] in ".!?:;\"')" for x in solid) / len(solid),
            sum(len(x) * c for x, c in lines_times.items() if c > 1) / lengths.sum(),
        )
    return out


class Model:
    """features -> standardised -> fixed random combinations -> linear score -> calibrated probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 128, seed: int = 7):
        rng, d = np.random.default_rng(seed), len(mean)
        self.mean, self.scale = mean, scale
        self.mixed, self.shift = rng.normal(0, 1.5 / d**0.5, (d, hidden)), rng.normal(0, 1, hidden)
        self.weights = np.zeros(1 + d + hidden)
        self.slope, self.offset = 1.0, 0.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        """A row of inputs of the linear score for each row of features."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.ones((len(z), 1)), z, np.tanh(z @ self.mixed + self.shift)), axis=1)

    def fit(self, mean_p: np.ndarray, square_p: np.ndarray, mean_u: np.ndarray, square_u: np.ndarray, prior: float) -> None:
        """The minimum of the non-negative risk, from the moments of positives and of unlabelled texts."""
        ridge = 1e-3 * np.eye(len(mean_p))

        def at(part: float) -> tuple[np.ndarray, float]:
            """Weights that minimise the risk with so much of its second part, and that part's value."""
            w = np.linalg.solve(prior * (1 - part) * square_p + part * square_u + ridge, prior * (1 + part) * mean_p - part * mean_u)
            return w, float(1 + 2 * w @ mean_u + w @ square_u @ w - prior * (1 + 2 * w @ mean_p + w @ square_p @ w)) / 4

        self.weights, rest = at(1.0)
        if rest < 0:
            low, high = 0.0, 1.0
            for _ in range(60):
                part = (low + high) / 2
                self.weights, rest = at(part)
                low, high = (part, high) if rest > 0 else (low, part)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of the probability, by Newton steps on labelled rows of both classes."""
        if len(y) and 0 < y.mean() < 1:
            z = self.margin(x)
            a = np.stack((z, np.ones_like(z)), 1)
            w = np.array([1.0, 0.0])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
                w = w - np.clip(np.linalg.solve(hess, a.T @ (p - y) + 1e-3 * (w - [1, 0])), -5, 5)
            if w[0] > 0:
                self.slope, self.offset = map(float, w)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3; a null
    id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([*features(texts)])


#: Rows of sums that come to the driver at most.
SUMS = 64


def sums(rows: DataFrame, of) -> dict[str, np.ndarray]:
    """For each kind of rows (kind, x) the sum of of(matrix of x), which is a flat array of a fixed length. Tasks add up
    their rows, SUMS others these sums, so what comes to the driver has a fixed bound."""
    layout = "kind string, part int, total binary"

    def batch_sums(batches):
        out, part = {}, TaskContext.get().partitionId() % SUMS
        for pdf in batches:
            for kind, group in pdf.groupby("kind", sort=False):
                x = np.stack(group["x"].to_numpy()).astype(np.float64)
                out[kind] = out.get(kind, 0) + of(x)
        yield pd.DataFrame([(k, part, v.tobytes()) for k, v in out.items()], columns=["kind", "part", "total"])

    def summed(batches):
        out = {}
        for pdf in batches:
            for kind, total in zip(pdf["kind"], pdf["total"]):
                out[kind] = out.get(kind, 0) + np.frombuffer(total)
        yield pd.DataFrame([(k, 0, v.tobytes()) for k, v in out.items()], columns=["kind", "part", "total"])

    found: dict[str, np.ndarray] = {}
    for kind, _, total in rows.mapInPandas(batch_sums, layout).repartition(SUMS, "part").mapInPandas(summed, layout).collect():
        found[kind] = found.get(kind, 0) + np.frombuffer(total)
    return found


#: Cells of a histogram of margins, over -4 to 4, and the least share of positives that an estimate of the prior looks at.
CELLS, LEAST_TAIL = 256, 0.1


def histogram(margins: np.ndarray) -> np.ndarray:
    return np.histogram(np.clip(margins, -3.999, 3.999), CELLS, (-4, 4))[0].astype(float)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from histograms of their margins: above any margin lie at least the prior
    times the positives' share of the unlabelled texts, so the least quotient of the two shares bounds it, and reaches it
    where only positives lie. Each quotient is raised by its sampling error, so that small tails don't decide."""
    p, u = (np.cumsum(h[::-1])[:-1] / max(h.sum(), 1) for h in (positives, unlabelled))
    tails = p >= LEAST_TAIL
    error = np.sqrt((1 - p[tails]) / (p[tails] * max(positives.sum(), 1)))
    return float(np.clip((u[tails] / p[tails] * (1 + error)).min(initial=1.0), 0.02, 0.98))


def _spread(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_rows: int) -> Model | None:
    """The model, from the moments of all texts and of all positives of the learning folds; None without positives.
    Calibration takes about most_rows labelled rows at most."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id").alias("id"), "quality").where(F.col("quality").isin(0, 1) & ~held_out(F.col("id")))
    known = persisted(known.groupBy("id").agg(F.max("quality").cast("int").alias("quality")))
    rows = persisted(texts.select("id", _features("text").alias("x")))
    labelled = persisted(rows.join(known, "id").select("id", "x", "quality"))
    n, n_good = labelled.agg(F.count(F.lit(1)), F.sum("quality")).first()
    if not n_good:
        return None
    kinds = rows.select(F.lit("all").alias("kind"), "x").unionByName(labelled.where("quality = 1").select(F.lit("good").alias("kind"), "x"))
    count, total, squares = np.split(sums(rows.select(F.lit("all").alias("kind"), "x"), _spread)["all"], [1, 1 + N_FEATURES])
    mean = total / count
    model = Model(mean, np.sqrt(np.maximum(squares / count - mean**2, 0)) + 1e-3)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def moments(x: np.ndarray) -> np.ndarray:
        b = shared.value.basis(x)
        return np.concatenate(([len(b)], b.sum(axis=0), (b.T @ b).ravel()))

    found = sums(kinds, moments)
    parts = []
    for kind in ("good", "all"):
        m, first, second = np.split(found[kind], [1, 1 + len(model.weights)])
        parts += [first / m, second.reshape(len(first), -1) / m]
    if n_good < n:
        model.fit(*parts, prior=min(0.98, max(0.02, n_good / n)))
    else:  # positives only: margins of a first fit tell the prior
        model.fit(*parts, prior=0.5)
        first = docs.sparkSession.sparkContext.broadcast(model)
        margins = sums(kinds, lambda x: histogram(first.value.margin(x)))
        model.fit(*parts, prior=estimated_prior(margins["good"], margins["all"]))
    share = min(1.0, most_rows / n)  # by a hash of id and features, so equal rows go together; hence the limit
    chosen = labelled.where(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 24)) < int(share * (1 << 24)))
    some = sorted((r.id, r.quality, r.x) for r in chosen.orderBy(F.xxhash64("id", "x")).limit(2 * most_rows).collect())
    if some:
        model.calibrate(np.array([r[2] for r in some], np.float64).reshape(-1, N_FEATURES), np.array([r[1] for r in some], float))
    dropped(known, rows, labelled)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> DataFrame:
    """docs with held_out, score and predicted behind its columns (underscores are added to names that docs
    has already); one row for each row of docs.

    labels has doc_id and quality; of an id's several labels the largest counts, null ids and labels are not
    used. Null and empty texts are scored as a text without features; without a usable positive label every score is 0.5.
    Repeated rows get equal scores; an empty table gives an empty result. Scores don't depend on the order of rows. Calibration
    takes about most_rows labelled rows, chosen by a hash (twice as many at most); everything else covers all rows."""
    small_batches(docs.sparkSession)
    held, score, predicted = (free_name(docs, c) for c in ("held_out", "score", "predicted"))
    model = fit(docs, labels, id_col, text_col, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(shared.value.probability(features(texts).astype(np.float64)))

    out = docs.withColumn(held, held_out(F.col(id_col))).withColumn(score, probability(F.col(text_col)))
    return out.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")
