"""Streams over several files and restarts against their batch twins."""

from datetime import datetime, timedelta

from test_admission import COLUMNS, key, random_rows

from pyspark.sql import functions as F

from changetree.operators import admission as ad
from changetree.streaming import jobs
from changetree.streaming.admission import stream_admission


def fed(spark, folder, parts, schema, build, mode="append"):
    """What a stream has written after it was started anew for each part, one file a part."""
    source, out = f"{folder}/in", f"{folder}/out"
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # few state stores, so that the many small batches are quick
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k % 3 == 2 or k == len(parts) - 1:  # a restart after some files; those in between are batches of one file
            job = jobs.to_table(build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), out, f"{folder}/check", mode)
            job.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    return spark.read.parquet(out)


def test_stream_admission_equals_batch_over_files_and_restarts(spark, tmp_path):
    rows = [r for r in random_rows(11, n=200, tenants=2)]
    parts = [rows[k : k + 20] for k in range(0, len(rows), 20)]
    got = fed(spark, str(tmp_path), parts, COLUMNS, stream_admission).collect()
    want = ad.admit_mutations(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    assert spark.conf.get(jobs.STORE, "") != jobs.ROCKS


def test_registrations_expire_when_the_watermark_has_passed(spark, tmp_path):
    """Verified ones come with their time, expired ones with null once both streams are an hour past their lifetime; later ones stay open."""
    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    rows = [[("issue", "a", at(0)), ("issue", "b", at(1))], [("verify", "a", at(20)), ("issue", "c", at(21))], [("verify", "b", at(26)), ("verify", "c", at(30))], [("issue", "d", at(60)), ("verify", "x", at(60))], [("issue", "e", at(61)), ("verify", "y", at(61))]]

    def build(s):
        part = lambda kind, name: s.where(f"kind = '{kind}'").select(F.col("id").alias("registration_id"), F.col("ts").alias(name))
        return jobs.stream_registration_expiry(part("issue", "issued"), part("verify", "at"))

    got = fed(spark, str(tmp_path), rows, "kind string, id string, ts timestamp", build).collect()
    assert {(r.registration_id, r.verified_at) for r in got} == {("a", at(20)), ("b", None), ("c", at(30))} and len(got) == 3
