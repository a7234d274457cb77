"""Operators over a replica's outbox (tenant, sequence, operation_id, object_id, kind, status), the dependencies of its
operations (operation_id, needs), its inbox and what it already knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import persisted
from .limits import follow

OBJECT = ["tenant", "object_id"]
OPEN = ["pending", "attempted", "mismatch"]


def unresolved_objects(outbox: DataFrame, covered: DataFrame, resolved: DataFrame) -> DataFrame:
    """(tenant, object_id) with open local intent: an operation still open that no finished recovery covers
    (covered: operation_id), or a conflict that is neither covered nor resolved (resolved: operation_id)."""
    rest = outbox.where(F.col("status").isin(*OPEN, "conflict")).join(covered.select("operation_id").distinct(), "operation_id", "left_anti")
    settled = resolved.select("operation_id", F.lit(True).alias("settled")).distinct()
    return rest.join(settled, "operation_id", "left").where("status <> 'conflict' OR settled IS NULL").select(*OBJECT).distinct()


def open_conflicts(outbox: DataFrame, canonical: DataFrame, resolved: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest unresolved conflicts, `limit` at most, with the object's canonical revision and name (null without)."""
    rest = outbox.where("status = 'conflict'").join(resolved.select("operation_id").distinct(), "operation_id", "left_anti")
    oldest = rest.orderBy("sequence", "operation_id").limit(limit)
    state = canonical.select(*OBJECT, F.col("revision").alias("canonical_revision"), F.col("name").alias("canonical_name"))
    return oldest.join(state, OBJECT, "left").select(*OBJECT, "sequence", "operation_id", "kind", "canonical_revision", "canonical_name")


def ready_operations(outbox: DataFrame, deps: DataFrame, resolutions: DataFrame, limit: int = 500, attempted: bool = False) -> DataFrame:
    """Pending operations (attempted ones too if asked for) all of whose prerequisites are accepted, or resolved as
    reverted or equivalent; of each tenant the first `limit` by sequence."""
    done = outbox.where("status = 'accepted'").select(F.col("operation_id").alias("needs"))
    done = done.unionByName(resolutions.where("resolution IN ('reverted', 'equivalent')").select(F.col("operation_id").alias("needs"))).distinct()
    unmet = deps.join(done, "needs", "left_anti").select("operation_id").distinct()
    ready = outbox.where(F.col("status").isin("pending", *(["attempted"] if attempted else []))).join(unmet, "operation_id", "left_anti")
    place = F.row_number().over(W.partitionBy("tenant").orderBy("sequence", "operation_id"))
    return ready.withColumn("place", place).where(F.col("place") <= limit).select(*OBJECT, "sequence", "operation_id", "kind", "place")


def blocked_subtree_deletes(outbox: DataFrame, deps: DataFrame, inbox: DataFrame) -> DataFrame:
    """Deletes that wait for deletes not yet accepted: how many, and the first cursor of a downloaded move of the
    same object, null without one."""
    unfinished = outbox.where("kind = 'delete' AND status <> 'accepted'")
    waiting = deps.join(unfinished.select(F.col("operation_id").alias("needs")), "needs").groupBy("operation_id").agg(F.countDistinct("needs").alias("n_waiting"))
    moves = inbox.where("mutation = 'move'").groupBy(*OBJECT).agg(F.min("cursor").alias("moved_at"))
    return unfinished.join(waiting, "operation_id").join(moves, OBJECT, "left").select(*OBJECT, "operation_id", "n_waiting", "moved_at")


def own_echoes(inbox: DataFrame, outbox: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(tenant, cursor) of downloaded changes that are own accepted operations (same operation, object, kind, revision and
    cursor), and of deletes that a tombstone of the same object and revision already holds."""
    keys = ["tenant", "operation_id", "object_id", "mutation", "revision", "cursor"]
    own = inbox.join(outbox.where("status = 'accepted'").select(*keys).distinct(), keys, "left_semi")
    held = inbox.where("mutation = 'delete'").join(tombstones.select(*OBJECT, "revision").distinct(), [*OBJECT, "revision"], "left_semi")
    return own.select("tenant", "cursor").unionByName(held.select("tenant", "cursor")).distinct()


def history_consistency_audit(log: DataFrame, versions: DataFrame, operations: DataFrame) -> DataFrame:
    """Rows of the log without their version or accepted operation or at odds with it, and versions and accepted
    operations without a row: tenant, cursor, problem (the first that applies)."""
    facts = ["object_id", "revision", "mutation", "name", "blob_hash"]
    side = lambda df, k, cols: df.select("tenant", "cursor", F.lit(True).alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
    whole = side(log, "l", [*facts, "operation_id"]).join(side(versions, "v", facts), ["tenant", "cursor"], "full")
    whole = whole.join(side(operations.where("status = 'accepted'"), "o", ["object_id", "revision", "operation_id"]), ["tenant", "cursor"], "full")
    same = lambda k, cols: F.array([F.col(f"l_{c}").eqNullSafe(F.col(f"{k}_{c}")) for c in cols])
    problem = (
        F.when(F.col("l").isNull(), "not_logged").when(F.col("v").isNull(), "no_version").when(F.col("o").isNull(), "no_operation")
        .when(F.exists(same("v", facts), lambda x: ~x), "version_differs").when(F.exists(same("o", ["object_id", "revision", "operation_id"]), lambda x: ~x), "operation_differs")
    )
    return whole.select("tenant", "cursor", problem.alias("problem")).where("problem IS NOT NULL")


def tree_manifest_check(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Differences between an expected tree and a listing, both (root, path, type, content_hash): missing, unexpected,
    type, hash, or parent (its parent is listed, but not as a folder)."""
    e, f = (df.select("root", "path", F.col("type").alias(f"type_{k}"), F.col("content_hash").alias(f"hash_{k}")) for df, k in ((manifest, "e"), (inventory, "f")))
    above = inventory.select("root", F.col("path").alias("up"), F.col("type").alias("type_up"))
    both = e.join(f, ["root", "path"], "full").withColumn("up", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(above, ["root", "up"], "left")
    problem = (
        F.when(F.col("type_f").isNull(), "missing").when(F.col("type_e").isNull(), "unexpected").when(F.col("type_e") != F.col("type_f"), "type")
        .when(~F.col("hash_e").eqNullSafe(F.col("hash_f")), "hash").when(F.coalesce(F.col("type_up") != "folder", F.lit(False)), "parent")
    )
    return both.select("root", "path", problem.alias("problem")).where("problem IS NOT NULL")


def suppress_echoes(diff: DataFrame, applied: DataFrame) -> DataFrame:
    """Derived changes (object_id, mutation, path, content_hash) without those that equal an applied remote state (the
    same columns; a null path fits any): deletes by id, others by id, hash and path."""
    a = applied.select(F.col("object_id").alias("i"), (F.col("mutation") == "delete").alias("gone"), F.col("path").alias("p"), F.col("content_hash").alias("h"))
    deleted = diff["mutation"] == "delete"
    same = (F.col("i") == diff["object_id"]) & (F.col("gone") == deleted) & (deleted | (F.col("h").eqNullSafe(diff["content_hash"]) & (F.col("p").isNull() | (F.col("p") == diff["path"]))))
    return diff.join(a, same, "left_anti")


def projected_revision(baselines: DataFrame, outbox: DataFrame) -> DataFrame:
    """Each object's revision once its pending and attempted operations are through, the last of these, and
    whether the object has a baseline at all."""
    ops = outbox.where("status IN ('pending', 'attempted')").groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("n"), F.max_by("operation_id", "sequence").alias("depends_on"))
    both = baselines.select(*OBJECT, "revision").join(ops, OBJECT, "full")
    return both.select(*OBJECT, (F.coalesce("revision", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("projected"), "depends_on", F.col("revision").isNotNull().alias("durable"))


def incident_rollup(detections: DataFrame, acks: DataFrame) -> DataFrame:
    """Open incidents by (tenant, code), detected again after their last acknowledgement or never acknowledged: first and last
    time seen and how often."""
    seen = detections.groupBy("tenant", "code").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("n_seen"))
    known = acks.groupBy("tenant", "code").agg(F.max("at").alias("acknowledged"))
    return seen.join(known, ["tenant", "code"], "left").where("acknowledged IS NULL OR last_seen > acknowledged").drop("acknowledged")


def collectable_blobs(uses: DataFrame, protectors: DataFrame, cleanups: DataFrame) -> DataFrame:
    """Hashes whose uses (blob_hash, sequence, finished) are all finished, that nothing protects, and that were used
    since they were last cleaned (blob_hash, cleaned)."""
    finished = uses.groupBy("blob_hash").agg(F.max("sequence").alias("last_sequence"), F.min("finished").alias("all_finished")).where("all_finished")
    free = finished.join(protectors.select("blob_hash").distinct(), "blob_hash", "left_anti")
    last = cleanups.groupBy("blob_hash").agg(F.max("cleaned").alias("cleaned"))
    return free.join(last, "blob_hash", "left").where("cleaned IS NULL OR last_sequence > cleaned").select("blob_hash", "last_sequence")


def supersede_pending(outbox: DataFrame, deps: DataFrame, new_ops: DataFrame) -> DataFrame:
    """(tenant, operation_id, by): pending operations that a newer one (new_ops: tenant, object_id, sequence, operation_id) of the
    same object replaces, unless any operation depends on them."""
    newest = new_ops.groupBy(*OBJECT).agg(F.max(F.struct("sequence", "operation_id")).alias("n"))
    older = outbox.where("status = 'pending'").join(newest, OBJECT).where("sequence < n.sequence")
    return older.join(deps.select(F.col("needs").alias("operation_id")).distinct(), "operation_id", "left_anti").select("tenant", "operation_id", F.col("n.operation_id").alias("by"))


def doomed_dependents(outbox: DataFrame, deps: DataFrame, failed: DataFrame) -> DataFrame:
    """operation_id of all that depends, directly or not, on a failed operation and is still open. Each round follows
    the dependencies of what the last one found; nothing is followed twice, so cycles end."""
    seen = frontier = persisted(failed.select("operation_id").distinct())
    while True:
        found = deps.join(frontier.withColumnRenamed("operation_id", "needs"), "needs").select("operation_id").distinct()
        frontier = persisted(found.join(seen, "operation_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = persisted(seen.unionByName(frontier))
    reached = seen.join(failed.select("operation_id"), "operation_id", "left_anti")
    return reached.join(outbox.where(F.col("status").isin(OPEN)).select("operation_id"), "operation_id", "left_semi")


def ingest_changes(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Each page (tenant, page, from_cursor, next_cursor and rows of cursor, payload) with its verdict, taken one after the other by page: append (it is dense and
    begins at the last cursor that stored rows and pages appended before it have), replay (dense, its rows are stored or were appended before it, with
    equal payloads), else reject. A page goes in whole or not; append_changes gives the rows. Nulls in payloads are equal, those in cursors reject a page.

    A page leads on to the first page behind it that begins where it ends, so the appended ones are found by pointer doubling over
    pages; no task orders a tenant."""
    key = ["tenant", "page", "from_cursor", "next_cursor"]
    sums = persisted(pages.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cursor").alias("n"), F.min("cursor").alias("low"), F.max("cursor").alias("high")))
    dense = F.expr("coalesce(low = from_cursor + 1 AND high = next_cursor AND n = n_rows AND n = next_cursor - from_cursor, false)")
    whole = sums.where(dense).select(F.col("tenant").alias("key"), F.struct("page", "from_cursor", "next_cursor").alias("at"))
    begins = whole.select("key", "at", F.col("at.from_cursor").alias("c"), F.lit(0).alias("asks"))
    asked = whole.select("key", "at", F.col("at.next_cursor").alias("c"), F.lit(1).alias("asks"))
    behind = W.partitionBy("key", "c").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    jump = begins.unionByName(asked).withColumn("then", F.min(F.when(F.col("asks") == 0, F.col("at"))).over(behind)).where("asks = 1 AND then IS NOT NULL")
    frontier = stored.groupBy(F.col("tenant").alias("key")).agg(F.max("cursor").alias("frontier"))
    first = whole.join(frontier, "key", "left").where("at.from_cursor = coalesce(frontier, 0)").groupBy("key").agg(F.min("at").alias("at"))
    appended = follow(first, persisted(jump.select("key", "at", "then")))
    appended = appended.select(F.col("key").alias("tenant"), "at.*", F.lit(True).alias("appended"))
    marked = pages.join(appended, key, "left").withColumn("at", F.struct(*key[1:]))
    old = stored.select("tenant", "cursor", "payload", F.lit(True).alias("is_old"), F.lit(None).cast(marked.schema["at"].dataType).alias("since"))
    new = marked.where("appended").select("tenant", "cursor", "payload", F.lit(None).cast("boolean").alias("is_old"), F.col("at").alias("since"))
    had = old.unionByName(new).groupBy(F.col("tenant").alias("t"), F.col("cursor").alias("c"), F.col("payload").alias("p")).agg(F.max("is_old").alias("is_old"), F.min("since").alias("since"))
    again = marked.where("appended IS NULL").join(had, (F.col("tenant") == F.col("t")) & (F.col("cursor") == F.col("c")) & F.col("payload").eqNullSafe(F.col("p")), "left")
    equal = again.groupBy(*key).agg(F.min(F.coalesce("is_old", F.col("since") < F.col("at"), F.lit(False))).alias("equal"))
    verdict = F.when(F.col("appended"), "append").when(dense & F.col("equal"), "replay").otherwise("reject")
    return sums.join(appended, key, "left").join(equal, key, "left").select(*key, "n_rows", verdict.alias("verdict"))


def append_changes(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(tenant, cursor, payload) that ingest_changes' verdicts add to what is stored; each cursor of a tenant comes once."""
    taken = verdicts.where("verdict = 'append'").select("tenant", "page", "from_cursor", "next_cursor")
    return pages.join(taken, taken.columns, "left_semi").select("tenant", "cursor", "payload")


def rebase_deletes(conflicts: DataFrame, baselines: DataFrame, copies: DataFrame) -> DataFrame:
    """Deletes to issue again at the canonical revision (conflicts: tenant, object_id, operation_id, canonical_revision), where the baseline
    equals it; each depends on the last create of the rescue copy (copies: operation_id, create_id, sequence)."""
    same = conflicts.join(baselines.select(*OBJECT, "revision"), OBJECT).where("revision = canonical_revision")
    last = copies.groupBy("operation_id").agg(F.max_by("create_id", F.struct("sequence", "create_id")).alias("depends_on"))
    return same.join(last, "operation_id").select(*OBJECT, F.col("operation_id").alias("replaces"), F.col("revision").alias("base_revision"), "depends_on")
