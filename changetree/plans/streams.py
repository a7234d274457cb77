"""Registered queries of the streaming jobs: each reads its table as a stream to the end and gives what was written. Their SQL is that of
the batch twin, so both must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_folder, read
from ..streaming import jobs
from . import local


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's Parquet files, as they are and as they come, a few at a time."""
    return spark.readStream.schema(read(spark, d, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/{name}.parquet*")


def written(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    folder = new_folder(spark, "stream")
    jobs.to_table(out, f"{folder}/rows", f"{folder}/checkpoint", mode).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def latest(spark: SparkSession, d: str) -> DataFrame:
    e = stream(spark, d, "events")
    log = e.select((F.col("user_id") % 10).alias("tenant"), F.col("user_id").alias("object_id"), F.col("event_id").alias("cursor"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("mutation"))
    folder = new_folder(spark, "stream")
    job = jobs.stream_latest_state(log, folder, f"{folder}/checkpoint")
    job.awaitTermination()
    last = max((p["batchId"] for p in job.recentProgress if p["numInputRows"]), default=0)
    return spark.read.parquet(f"{folder}/state-{last}")


def attempts(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("attempt_id"), (F.col("event_id") * 3 + F.col("user_id") % 2).alias("at"))


QUERIES = {
    "stream_latest_state": latest,
    "stream_operation_dedupe": lambda s, d: written(
        s, jobs.stream_operation_dedupe(stream(s, d, "conversations").select(F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2)).alias("operation_id"), F.col("turn").alias("arrival"), F.col("role").alias("digest")))
    ),
    "stream_version_filter": lambda s, d: written(
        s, jobs.stream_version_filter(stream(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), (F.col("event_id") % 7).alias("generation"), (F.col("event_id") % 5).alias("revision")))
    ),
    "stream_rate_limit": lambda s, d: written(s, jobs.stream_rate_limit(attempts(stream(s, d, "events")), local.LIMIT, local.WINDOW)),
    "stream_incident_rollup": lambda s, d: written(s, jobs.stream_incident_rollup(stream(s, d, "events").select((F.col("user_id") % 10).alias("tenant"), F.col("event_type").alias("code"), F.col("event_id").alias("at"))), "complete"),
    "stream_route_metrics": lambda s, d: written(
        s, jobs.stream_route_metrics(stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", F.col("event_type") == "error", "1 hour", "3650 days"), "complete"
    ).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")),
}
SQL = {
    "stream_latest_state": "SELECT user_id % 10 AS tenant, user_id AS object_id, max(event_id) AS cursor, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'delete' ELSE 'update' END AS mutation, arg_max(event_type, event_id) = 'error' AS deleted FROM events GROUP BY 1, 2",
    "stream_operation_dedupe": """WITH a AS (SELECT conv_id || ':' || (turn // 2) AS operation_id, turn AS arrival, role AS digest FROM conversations),
f AS (SELECT *, row_number() OVER w AS k, first_value(digest) OVER w AS fd FROM a WINDOW w AS (PARTITION BY operation_id ORDER BY arrival, digest))
SELECT operation_id, arrival, digest, CASE WHEN k = 1 THEN 'first' WHEN digest = fd THEN 'replay' ELSE 'mismatch' END AS outcome FROM f""",
    "stream_version_filter": """SELECT user_id AS key, event_id AS at, event_id % 7 AS generation, event_id % 5 AS revision, CASE WHEN coalesce((event_id % 7) * 10 + event_id % 5 >=
  max((event_id % 7) * 10 + event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 'accepted' ELSE 'stale' END AS outcome FROM events""",
    "stream_rate_limit": local.SQL["rate_limit_decisions"],
    "stream_incident_rollup": "SELECT user_id % 10 AS tenant, event_type AS code, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS n_seen FROM events GROUP BY 1, 2",
    "stream_route_metrics": """SELECT date_trunc('hour', ts) AS window_start, event_type AS route, count(*) AS n_requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
  round(avg(value), 4) AS mean_duration, max(value) AS max_duration FROM events GROUP BY 1, 2""",
}
