"""Operator 4, exact dedup: two-pass Bloom filtering.

Pass one deals 64-bit text hashes (never rows) to tasks, each of which inserts its share into a Bloom
filter; a hash whose bits were all set before, or that a batch held twice, is possibly repeated and
enters a second filter of bounded size. Pass two tests each row against that filter: rows that it does
not know are unique and pass straight through, the others shuffle and are settled exactly by SHA-256.
A false positive of either filter costs a shuffled row, never a wrong result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build_filter, membership, positions
from .common import collapse_space, dropped, free_name, persisted, table

U = np.uint64


def _batch_hashes(batches):
    for pdf in batches:
        h, counts = np.unique(pdf["h"].to_numpy(np.int64), return_counts=True)
        yield pd.DataFrame({"h": h, "again": counts > 1})


def _possibly_repeated(bits: int, probes: int):
    def run(batches):
        seen = np.zeros(bits, bool)
        for pdf in batches:
            h, at = np.unique(pdf["h"].to_numpy(np.int64), return_inverse=True)
            again = np.bincount(at, weights=pdf["again"].to_numpy(bool), minlength=len(h)) > 0
            again |= np.bincount(at, minlength=len(h)) > 1
            where = positions(h.view(U), bits, probes)
            again |= seen[where].all(axis=1)
            seen[where.ravel()] = True
            yield pd.DataFrame({"h": h[again]})

    return run


#: Hashes that a task of pass one takes, about, and the bits of its filter: 1 % of the hashes pass by mistake.
TASK_HASHES, TASK_BITS = 1 << 20, 1 << 23
#: Bits of the second filter at most (32 MB).
MOST_BITS = 1 << 28


def repeated_filter(hashes: DataFrame, rows: int, most_bits: int = MOST_BITS, task_hashes: int = TASK_HASHES, task_bits: int = TASK_BITS, probes: int = 4) -> np.ndarray:
    """The second Bloom filter, as 64-bit words. Pass one has a task for each task_hashes rows, so its filters are as
    empty at any size of the input. The second filter has ten bits for each hash in it, up to most_bits; that bounds
    what comes to the driver and is broadcast, and a fuller filter only lets more rows shuffle."""
    n = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_hashes))
    firsts = hashes.mapInPandas(_batch_hashes, "h long, again boolean")
    again = persisted(firsts.repartition(n, "h").mapInPandas(_possibly_repeated(task_bits, probes), "h long"))
    words = build_filter(again, min(most_bits, max(1 << 16, 1 << (10 * again.count()).bit_length())), probes)
    dropped(again)
    return words


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 behind its columns (underscores are added to a
    name that docs has already); one row for each row of docs.

    Texts are equal when identical after white-space runs become one space; a null text counts as empty.
    Of equal texts the row with the smallest id stays; a null id is larger than any other. Rows that
    repeat the kept row's id and text are all marked kept (keep_first leaves one of them). An empty table gives an empty result."""
    spark = docs.sparkSession
    keep, size, kept, sha = (free_name(docs, c) for c in ("keep_id", "group_size", "kept", "text_sha256"))
    maybe, g_sha, g_keep, g_size = (free_name(docs, c) for c in ("maybe_repeated", "g_sha", "g_keep", "g_size"))
    digest = F.sha2(collapse_space(F.col(text_col)).cast("binary"), 256)

    def h64(hexed: Column) -> Column:
        """The first 60 bits of a hex digest."""
        return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")

    words = repeated_filter(docs.select(h64(digest).alias("h")), docs.count(), **filter_options)
    known = membership(spark, words, filter_options.get("probes", 4))
    marked = docs.withColumn(sha, digest).withColumn(maybe, known(h64(F.col(sha))))
    base = [F.col(f"`{c}`") for c in docs.columns] + [F.col(sha)]
    alone = marked.where(~F.col(maybe)).select(*base, F.col(id_col).alias(keep), F.lit(1).cast("long").alias(size), F.lit(True).alias(kept))
    some = marked.where(F.col(maybe))
    groups = persisted(
        some.groupBy(F.col(sha).alias(g_sha)).agg(F.min(F.col(id_col)).alias(g_keep), F.count(F.lit(1)).alias(g_size))
    )
    joined = some.join(groups, F.col(sha) == F.col(g_sha))
    settled = joined.select(*base, F.col(g_keep).alias(keep), F.col(g_size).alias(size), F.col(id_col).eqNullSafe(F.col(g_keep)).alias(kept))
    return alone.unionByName(settled)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, with its own columns; where a kept row is repeated
    with the same id and text, one stays."""
    out = exact_dedup(docs.select("*"), id_col, text_col)
    sha, keep, size, kept = out.columns[len(docs.columns) :]
    stay = out.where(F.col(kept))
    alone = stay.where(F.col(size) == 1)
    # an id may be repeated only within a group, so only rows of groups are compared again
    return alone.unionByName(stay.where(F.col(size) > 1).dropDuplicates([id_col, sha])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
