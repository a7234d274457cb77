"""Bloom filters of 64-bit hashes, built in Spark, of a size that the caller bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix

U = np.uint64


def positions(h: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit positions of each hash, by double hashing; shape (hashes, probes)."""
    with np.errstate(over="ignore"):
        second = mix(h) | U(1)
        return (h[:, None] + np.arange(1, probes + 1, dtype=U)[None, :] * second[:, None]) % U(bits)


def _filter_words(bits: int, probes: int):
    def run(batches):
        for pdf in batches:
            where = np.unique(positions(pdf["h"].to_numpy(np.int64).view(U), bits, probes))
            word, bit = (where >> U(6)).astype(np.int64), U(1) << (where & U(63))
            words, at = np.unique(word, return_inverse=True)
            masks = np.zeros(len(words), U)
            np.bitwise_or.at(masks, at, bit)
            yield pd.DataFrame({"word": words, "mask": masks.view(np.int64)})

    return run


def build_filter(hashes: DataFrame, bits: int = 1 << 25, probes: int = 4) -> np.ndarray:
    """A filter of the column h, as bits / 64 words; that many rows at most come to the driver."""
    words = hashes.mapInPandas(_filter_words(bits, probes), "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    out, got = np.zeros(bits // 64, np.int64), words.toArrow()
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(U)


def held_in(words: np.ndarray, h: np.ndarray, probes: int = 4) -> np.ndarray:
    """Whether each hash may be in the filter; false only for hashes that it lacks."""
    where = positions(h.view(U), len(words) * 64, probes)
    return ((words[(where >> U(6)).astype(np.int64)] >> (where & U(63))) & U(1)).all(axis=1)


def membership(spark: SparkSession, words: np.ndarray, probes: int = 4):
    """A column function of a hash: false only for hashes that the filter lacks; the filter is broadcast."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(held_in(shared.value, h.to_numpy(np.int64), probes))

    return known
