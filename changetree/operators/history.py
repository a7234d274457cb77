"""Operators over the change log: (tenant, cursor) orders changes, (tenant, object_id, revision) versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OBJECT = ["tenant", "object_id"]


def latest_state(log: DataFrame) -> DataFrame:
    """The newest version of each object; deleted objects stay, flagged by their mutation. One partial
    aggregation by the largest cursor: an object with very many changes shuffles one row a task."""
    rest = [c for c in log.columns if c not in OBJECT]
    newest = log.groupBy(*OBJECT).agg(F.max_by(F.struct(*rest), "cursor").alias("s"))
    return newest.select(*OBJECT, "s.*").withColumn("deleted", F.col("mutation") == "delete")


def state_as_of(log: DataFrame, frontiers: DataFrame) -> DataFrame:
    """latest_state of the changes up to each tenant's frontier (tenant, frontier); tenants without one are left out."""
    return latest_state(log.join(frontiers, "tenant").where("cursor <= frontier").drop("frontier"))


def change_feed_page(log: DataFrame, after: DataFrame, limit: int = 100) -> DataFrame:
    """The next `limit` (1 to 500) changes of each tenant behind its cursor (tenant, after; default 0), with has_more and
    next_cursor of the page. A tenant of `after` without further changes gets one row of nulls with its cursor as next_cursor.
    Spark cuts each task's rows to limit + 1 a tenant before they shuffle."""
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 changes")
    rank = F.row_number().over(W.partitionBy("tenant").orderBy("cursor"))
    page = log.join(after, "tenant", "left").where("cursor > coalesce(after, 0)").drop("after").withColumn("k", rank).where(F.col("k") <= limit + 1)
    whole = W.partitionBy("tenant")
    page = page.withColumn("has_more", F.max("k").over(whole) > limit).where(F.col("k") <= limit)
    page = page.withColumn("next_cursor", F.max("cursor").over(whole)).drop("k")
    behind = log.groupBy("tenant").agg(F.max("cursor").alias("last"))
    empty = after.join(behind, "tenant", "left").where("last IS NULL OR last <= after")
    return page.unionByName(empty.select("tenant", F.lit(False).alias("has_more"), F.col("after").alias("next_cursor")), allowMissingColumns=True)


def revision_chain_audit(versions: DataFrame) -> DataFrame:
    """Rows (tenant, object_id, revision, problem): gaps, repeated revisions, a start other than create, anything
    behind a delete, a create behind the start."""
    w = W.partitionBy(*OBJECT).orderBy("revision")
    seen = versions.select(*OBJECT, "revision", "mutation", F.lag("revision").over(w).alias("before"), F.lag("mutation").over(w).alias("was"))
    problem = (
        F.when(F.col("before").isNull() & (F.col("revision") != 1), "starts_late")
        .when(F.col("before").isNull() & (F.col("mutation") != "create"), "no_create")
        .when(F.col("before") == F.col("revision"), "repeated")
        .when(F.col("revision") > F.col("before") + 1, "gap")
        .when(F.col("was") == "delete", "after_delete")
        .when(F.col("before").isNotNull() & (F.col("mutation") == "create"), "created_again")
    )
    return seen.withColumn("problem", problem).where("problem IS NOT NULL").select(*OBJECT, "revision", "problem")


#: Cursors of a tenant that one task orders; larger tenants are many such buckets.
BUCKET = 1 << 16


def cursor_gap_report(log: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Missing cursor ranges (tenant, gap_from, gap_to) between a tenant's first and last cursor, and below the first.

    Gaps within a bucket of cursors are seen in the bucket, those between buckets from the buckets' first and last cursors, so
    that no task orders a whole tenant. Null cursors take no part."""
    rows = log.where("cursor IS NOT NULL").select("tenant", "cursor", F.floor(F.col("cursor") / bucket).alias("bucket"))
    inside = rows.withColumn("before", F.lag("cursor").over(W.partitionBy("tenant", "bucket").orderBy("cursor")))
    ends = rows.groupBy("tenant", "bucket").agg(F.min("cursor").alias("cursor"), F.max("cursor").alias("high"))
    between = ends.withColumn("before", F.coalesce(F.lag("high").over(W.partitionBy("tenant").orderBy("bucket")), F.lit(0)))
    steps = inside.unionByName(between.drop("high")).where("cursor > before + 1")
    return steps.select("tenant", (F.col("before") + 1).alias("gap_from"), (F.col("cursor") - 1).alias("gap_to"))


def duplicate_operations(log: DataFrame) -> DataFrame:
    """(tenant, operation_id, n_rows, n_cursors, first_cursor, last_cursor) of operations that stand more than once in a tenant's log;
    null ids are no operation."""
    sums = log.where("operation_id IS NOT NULL").groupBy("tenant", "operation_id", "cursor").agg(F.count(F.lit(1)).alias("n"))
    out = sums.groupBy("tenant", "operation_id").agg(
        F.sum("n").alias("n_rows"), F.count("cursor").alias("n_cursors"), F.min("cursor").alias("first_cursor"), F.max("cursor").alias("last_cursor")
    )
    return out.where("n_rows > 1")


def contiguous_frontier(inbox: DataFrame, confirmed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(tenant, confirmed, frontier): the highest cursor that applied rows reach from `confirmed` without a gap; of rows that share a
    cursor one must be applied, and a null isn't.

    Cursors are ordered within buckets counted from `confirmed` on. Each bucket gives the length of its run from its start, and runs add
    up over buckets without a gap until one isn't full."""
    above = inbox.join(confirmed, "tenant").where("cursor > confirmed")
    rows = above.groupBy("tenant", "confirmed", "cursor").agg(F.max(F.coalesce("applied", F.lit(False))).alias("applied")).where("applied")
    step = F.col("cursor") - F.col("confirmed") - 1
    rows = rows.select("tenant", F.floor(step / bucket).alias("bucket"), (step % bucket).alias("at"))
    placed = rows.withColumn("k", F.row_number().over(W.partitionBy("tenant", "bucket").orderBy("at")))
    runs = placed.groupBy("tenant", "bucket").agg(F.count(F.when(F.col("at") == F.col("k") - 1, 1)).alias("run"))
    order = W.partitionBy("tenant").orderBy("bucket")
    full = F.coalesce(F.min(F.col("run") == bucket).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    joined = runs.withColumn("goes_on", full & (F.col("bucket") == F.row_number().over(order) - 1)).where("goes_on").groupBy("tenant").agg(F.sum("run").alias("run"))
    return confirmed.join(joined, "tenant", "left").select("tenant", "confirmed", (F.col("confirmed") + F.coalesce("run", F.lit(0))).cast("long").alias("frontier"))


def merge_baselines(base: DataFrame, results: DataFrame) -> DataFrame:
    """(tenant, object_id, revision, operation_id): the larger revision of base and results; it never moves back."""
    both = base.select(*OBJECT, "revision", "operation_id").unionByName(results.select(*OBJECT, "revision", "operation_id"))
    return both.groupBy(*OBJECT).agg(F.max(F.struct("revision", "operation_id")).alias("s")).select(*OBJECT, "s.*")


def monotonic_version_filter(rows: DataFrame, key: str, generation: str, revision: str, order: str) -> DataFrame:
    """rows with `accepted`: not older, as (generation, revision), than any before it in the key's order. Rejected
    rows never raise the maximum, so the running maximum of all rows decides."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    version = F.struct(generation, revision)
    return rows.withColumn("accepted", F.coalesce(version >= F.max(version).over(w), F.lit(True)))


def operation_replay_check(operations: DataFrame) -> DataFrame:
    """operations (tenant, operation_id, arrival, digest) with outcome first, replay or mismatch, by the digest of the
    first arrival (of several at once, the smallest digest is first). The first is found by aggregation, so a much repeated
    operation is no hot group. Equal rows get equal outcomes."""
    firsts = operations.groupBy("tenant", "operation_id").agg(F.min(F.struct("arrival", "digest")).alias("f"))
    joined = operations.join(firsts, ["tenant", "operation_id"])
    outcome = F.when((F.col("arrival") == F.col("f.arrival")) & (F.col("digest") == F.col("f.digest")), "first").when(F.col("digest") == F.col("f.digest"), "replay").otherwise("mismatch")
    return joined.withColumn("outcome", outcome).drop("f")


def replica_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Objects (tenant, object_id) that differ between two states, with the first difference: missing_left, missing_right,
    revision, name or hash."""
    x, y = (s.select(*OBJECT, *[F.col(c).alias(f"{c}_{k}") for c in ("revision", "name", "blob_hash")]) for s, k in ((a, "a"), (b, "b")))
    both = x.join(y, OBJECT, "full")
    difference = (
        F.when(F.col("revision_a").isNull(), "missing_left")
        .when(F.col("revision_b").isNull(), "missing_right")
        .when(F.col("revision_a") != F.col("revision_b"), "revision")
        .when(~F.col("name_a").eqNullSafe(F.col("name_b")), "name")
        .when(~F.col("blob_hash_a").eqNullSafe(F.col("blob_hash_b")), "hash")
    )
    return both.select(*OBJECT, difference.alias("difference")).where("difference IS NOT NULL")
