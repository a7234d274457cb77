"""Joins of requests whose tokens are unknown."""

from pyspark.sql import functions as F

from changetree.operators import access


def largest_share(spark, df, n):
    """Of n rows, the share that the largest task of the last join has."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("false", "-1", "16")):
        spark.conf.set(k, v)
    try:
        return max(r["count"] for r in df().groupBy(F.spark_partition_id()).count().collect()) / n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_unknown_tokens_are_dealt_to_all_tasks(spark):
    n = 4000
    uses = spark.range(n).select(F.col("id").alias("use_id"), F.col("id").alias("request_id"), (F.col("id") + 10).alias("token_hash"), F.col("id").alias("at"))
    tokens = spark.createDataFrame([(10, 1, 0, 100, False), (11, 2, 0, 100, False)], "token_hash long, session_id long, issued long, expires long, revoked boolean")
    sessions = spark.createDataFrame([(1, 1, 1, 0, 100, False), (2, None, 1, 0, 100, False)], "session_id long, device_id long, user_id long, created long, expires long, revoked boolean")
    devices, users = spark.createDataFrame([(1, True)], "device_id long, active boolean"), spark.createDataFrame([(1, True)], "user_id long, active boolean")
    refresh = lambda: access.refresh_reuse_report(uses.drop("request_id"), tokens.drop("revoked"))
    valid = lambda: access.token_validity(uses.drop("use_id"), tokens, sessions, devices, users)
    assert largest_share(spark, refresh, n) < 0.2 and largest_share(spark, valid, n) < 0.2
    assert {(r.token_hash, r.outcome) for r in refresh().where("outcome <> 'unknown'").collect()} == {(10, "rotated"), (11, "rotated")}
    assert {(r.token_hash, r.reason) for r in valid().where("token_hash < 13").collect()} == {(10, None), (11, "device"), (12, "unknown_token")}
