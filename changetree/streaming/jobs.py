"""The continuous forms of operators. Each takes a streaming DataFrame; those that write return the started query."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import latest_state


def stream_route_metrics(requests: DataFrame, ts: str, route: str, duration: str, failed, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """route_metrics of a stream: one row for each route and window once the watermark has passed it."""
    return (
        requests.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), F.col(route).alias("route"))
        .agg(F.count(F.lit(1)).alias("n_requests"), F.sum(failed.cast("long")).alias("n_failed"), F.round(F.avg(duration), 4).alias("mean_duration"), F.max(duration).alias("max_duration"))
        .select(F.col("w.start").alias("window_start"), "route", "n_requests", "n_failed", "mean_duration", "max_duration")
    )


def stream_incident_rollup(detections: DataFrame) -> DataFrame:
    """(tenant, code) with first and last time seen and count, for update or complete mode; acknowledgements are compared by whoever reads it."""
    return detections.groupBy("tenant", "code").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("n_seen"))


def stream_latest_state(log: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest version of each object in folder/state-N, N being the batch; a batch that is tried again writes the same
    folder from the one before it, so nothing is counted twice. Reads of the newest folder see whole batches only."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch
        if n:
            new = new.unionByName(spark.read.parquet(f"{folder}/state-{n - 1}").drop("deleted"))
        latest_state(new).write.mode("overwrite").parquet(f"{folder}/state-{n}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful(rows: DataFrame, key: str, order: list[str], step: Callable, state_schema: str, out_schema: str) -> DataFrame:
    """step(state, row) -> (state, outcome) over each key's rows as they arrive, in the given order within a batch; state is a tuple, None at
    first, kept by Spark from batch to batch. out_schema is that of rows with the outcome behind it."""

    def run(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")  # the batch's rows of one key
        out = []
        for row in pdf.itertuples(index=False):
            now, outcome = step(now, row)
            out.append(outcome)
        state.update(now)
        yield pdf.assign(outcome=pd.Series(out, index=pdf.index, dtype=object))

    return rows.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def stream_operation_dedupe(operations: DataFrame) -> DataFrame:
    """operations (operation_id, arrival, digest) with outcome first, replay or mismatch, by the digest seen first."""

    def step(state, row):
        if state is None:
            return (row.digest,), "first"
        return state, "replay" if row.digest == state[0] else "mismatch"

    return stateful(operations.select("operation_id", "arrival", "digest"), "operation_id", ["arrival", "digest"], step, "digest string", "operation_id string, arrival long, digest string, outcome string")


def stream_version_filter(rows: DataFrame) -> DataFrame:
    """rows (key, at, generation, revision) with outcome accepted or stale: not older, as a pair, than any accepted before."""

    def step(state, row):
        pair = (int(row.generation), int(row.revision))
        return (pair, "accepted") if state is None or pair >= tuple(state) else (state, "stale")

    return stateful(rows.select("key", "at", "generation", "revision"), "key", ["at"], step, "generation long, revision long", "key long, at long, generation long, revision long, outcome string")


def stream_rate_limit(attempts: DataFrame, limit: int, window: int) -> DataFrame:
    """rate_limit_decisions of a stream: attempts (key, at, attempt_id) with outcome null if allowed, else the seconds to wait."""

    def step(state, row):
        at = int(row.at)
        if state is None or at - state[0] >= window or at < state[0]:
            return (at, 1), None
        start, n = state
        return ((start, n + 1), None) if n < limit else ((start, n), window - (at - start))

    return stateful(attempts.select("key", "at", "attempt_id"), "key", ["at", "attempt_id"], step, "start long, n long", "key string, at long, attempt_id long, outcome long")


def stream_registration_expiry(registrations: DataFrame, verifications: DataFrame, lifetime: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """registrations (registration_id, issued) with the verifications (registration_id, at) within their lifetime, or with null once
    the watermark has passed it: verified and expired ones."""
    r = registrations.withWatermark("issued", late)
    v = verifications.withColumnRenamed("registration_id", "v_id").withWatermark("at", late)
    within = F.expr(f"registration_id = v_id AND at >= issued AND at < issued + INTERVAL {lifetime}")
    return r.join(v, within, "leftOuter").select("registration_id", "issued", F.col("at").alias("verified_at"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's own setting is put back afterwards."""
    own = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, own) if own else spark.conf.unset(STORE)


def to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what a stream has now as Parquet files. In complete mode each batch replaces the folder before it."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocks(stream.sparkSession):
        if mode == "append":
            return writer.format("parquet").option("path", folder).start()
        return writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(folder)).start()
