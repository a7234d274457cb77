"""Fixed-window limits without a serial key: blocks of windows are searched each by itself and linked by pointer doubling, a limited window finds the last
attempt that each window allows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import dropped, persisted

#: Seconds of a block at least, as whole windows, one if that is longer.
BLOCK = 1 << 16


def follow(starts: DataFrame, jump: DataFrame) -> DataFrame:
    """(key, at) that lead on from starts (key, at) by jump (key, at, then), a persisted table with one row for each (key, at) at most and without cycles, which is
    deleted. Each round jumps twice as far as the one before."""
    reached = persisted(starts)
    while True:
        more = reached.join(jump, ["key", "at"]).select("key", F.col("then").alias("at"))
        if more.isEmpty():
            break
        last, reached = reached, persisted(reached.unionByName(more).distinct())
        step = jump.select("key", F.col("at").alias("then"), F.col("then").alias("beyond"))
        old, jump = jump, persisted(jump.join(step, ["key", "then"]).select("key", "at", F.col("beyond").alias("then")))
        dropped(last, old)
    dropped(jump)
    return reached


def window_starts(attempts: DataFrame, window: int) -> DataFrame:
    """(key, start), a persisted table: where the windows of each key begin, from its attempts (key, at in whole seconds). The first begins with the first
    attempt, each other one with the first attempt at least `window` seconds after the start before it.

    The distinct seconds of a block are one row. The first start in a block lies in its first `window` seconds or is the first attempt after them; from each of
    these entries the block is walked to the entry of the next block that follows. Only entries are linked over blocks, in log2(blocks) rounds. Then
    each block is walked once more from the entry that was reached."""
    length = window * max(1, BLOCK // window)
    block = F.floor(F.col("at") / length).alias("block")
    seconds = F.sort_array(F.collect_set(F.col("at").cast("long"))).alias("seconds")
    blocks = persisted(attempts.where("key IS NOT NULL AND at IS NOT NULL").groupBy("key", block).agg(seconds))
    n_first = F.size(F.filter("seconds", lambda x: x < F.col("block") * length + window))
    heads = blocks.select("key", "block", F.slice("seconds", F.lit(1), n_first + 1).alias("entries"))
    by_key = W.partitionBy("key").orderBy("block")
    heads = heads.withColumn("near", F.lead("entries").over(by_key)).withColumn("far", F.lead(F.col("entries")[0], 2).over(by_key))

    @F.pandas_udf("array<long>")
    def behind(seconds: pd.Series, entries: pd.Series, near: pd.Series, far: pd.Series) -> pd.Series:
        """The start in a later block that follows each entry."""
        out = []
        for s, e, n, f in zip(seconds, entries, near, far):
            then = np.append(np.searchsorted(s, s + window), len(s))
            at = np.arange(len(e))
            while (then[at] < len(s)).any():
                at = np.where(then[at] < len(s), then[at], at)
            n = np.array([] if n is None else n, np.int64)
            found = np.searchsorted(n, s[at] + window)
            out.append([int(n[k]) if k < len(n) else None if pd.isna(f) else int(f) for k in found])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<long>")
    def walked(seconds: pd.Series, entry: pd.Series) -> pd.Series:
        """The starts in a block from its first."""
        out = []
        for s, e in zip(seconds, entry):
            then, at, starts = np.searchsorted(s, s + window).tolist(), int(np.searchsorted(s, e)), []
            while at < len(s):
                starts.append(int(s[at]))
                at = then[at]
            out.append(starts)
        return pd.Series(out, dtype=object)

    linked = blocks.join(heads, ["key", "block"]).select("key", F.explode(F.arrays_zip("entries", behind("seconds", "entries", "near", "far").alias("then"))).alias("j"))
    jump = persisted(linked.select("key", F.col("j.entries").alias("at"), F.col("j.then").alias("then")).where("then IS NOT NULL"))
    reached = follow(blocks.groupBy("key").agg(F.min(F.col("seconds")[0]).alias("at")), jump)
    starts = persisted(reached.select("key", block, "at").join(blocks, ["key", "block"]).select("key", F.explode(walked("seconds", "at")).alias("start")))
    dropped(blocks, reached)
    return starts


def limit_by_windows(attempts: DataFrame, limit: int, window: int) -> DataFrame:
    """rate_limit_decisions for keys of any size: attempts (key, at in whole seconds, attempt_id, and others) with `outcome`, null if allowed, else the
    seconds to wait. Attempts count in the order of at, then of attempt_id, which names an attempt of its key."""
    return limited(persisted(attempts), limit, window)


def limited(a: DataFrame, limit: int, window: int) -> DataFrame:
    """limit_by_windows of a table that gives the same rows each time. A window is known by its start and by the last attempt that it allows, so attempts meet
    windows and not each other."""
    bucket = lambda c: F.floor(F.col(c) / window)
    starts = window_starts(a, window)

    def within(windows: DataFrame, rows: DataFrame) -> DataFrame:
        near = windows.withColumn("bucket", F.explode(F.array(bucket("start"), bucket("start") + 1)))
        return rows.withColumn("bucket", bucket("at")).join(near, ["key", "bucket"]).where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("start") + window))

    order = W.partitionBy("key", "start").orderBy("at", "attempt_id")
    placed = within(starts, a.select("key", "at", "attempt_id")).withColumn("place", F.row_number().over(order))
    last = placed.where(F.col("place") == limit).select("key", "start", F.struct("at", "attempt_id").alias("last"))
    rows = within(persisted(starts.join(last, ["key", "start"], "left")), a)
    ok = (F.col("last").isNull() | (F.struct("at", "attempt_id") <= F.col("last"))) & F.lit(limit > 0)
    return rows.select(*a.columns, F.when(~ok, F.col("start") + window - F.col("at")).cast("long").alias("outcome"))


def rate_limit_stages(attempts: DataFrame, all_limit: int, key_limit: int, window: int) -> DataFrame:
    """attempts (scope, key, at, attempt_id) with `stage` and `outcome`: all of a scope share one limit, and what passes it has one for each
    key. stage is `all` or `key`, which refused it, null if allowed; outcome the seconds to wait."""
    first = persisted(limit_by_windows(attempts.select(F.col("scope").alias("key"), F.col("key").alias("own"), "at", "attempt_id"), all_limit, window))
    refused = first.where("outcome IS NOT NULL").select(F.col("key").alias("scope"), F.col("own").alias("key"), "at", "attempt_id", F.lit("all").alias("stage"), "outcome")
    passed = first.where("outcome IS NULL").select(F.struct(F.col("key").alias("scope"), F.col("own").alias("key")).alias("key"), "at", "attempt_id")
    second = limited(passed, key_limit, window)
    return refused.unionByName(second.select("key.scope", "key.key", "at", "attempt_id", F.when(F.col("outcome").isNotNull(), "key").alias("stage"), "outcome"))
