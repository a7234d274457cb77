"""Operators over mutations and requests as they arrive: shapes, admission, sessions, tokens, limits, blobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .content import PATH_BYTES

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
HASH = "^[0-9a-f]{64}$"


def mutation_shape_check(muts: DataFrame) -> DataFrame:
    """muts (operation_id, object_id, kind, type, base_revision, parent_id, name, blob_hash, depends_on) with `reason`, the first rule
    that a mutation's shape breaks, null if none. Operation ids are UUIDs of version 7."""
    note, has = F.col("type") == "note", lambda c: F.col(c).isNotNull()
    kind, base = F.col("kind"), F.coalesce("base_revision", F.lit(0))
    hash_ok = F.coalesce(F.col("blob_hash").rlike(HASH), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("operation_id").rlike(UUID) & (F.substring("operation_id", 15, 1) == "7"), F.lit(False)), "operation_id")
        .when(~F.coalesce(F.col("object_id").rlike(UUID), F.lit(False)), "object_id")
        .when(F.coalesce(F.col("depends_on") == F.col("operation_id"), F.lit(False)), "depends_on_itself")
        .when(~F.coalesce(F.col("type").isin("note", "folder"), F.lit(False)), "type")
        .when(~F.coalesce(kind.isin("create", "update", "move", "delete"), F.lit(False)), "kind")
        .when((kind == "create") == (base > 0), "base_revision")
        .when(kind.isin("create", "move") != has("name"), "name")
        .when(kind.isin("update", "delete") & has("parent_id"), "parent")
        .when((kind == "update") & ~note, "folder_update")
        .when(((kind == "update") | ((kind == "create") & note)) & ~hash_ok, "hash_missing")
        .when((kind.isin("move", "delete") | ((kind == "create") & ~note)) & has("blob_hash"), "hash_not_allowed")
    )
    return muts.withColumn("reason", reason)


def change_shape_check(inbox: DataFrame) -> DataFrame:
    """inbox (type, mutation, revision, deleted, blob_hash) with `reason`: the first rule that a downloaded change breaks."""
    reason = (
        F.when((F.col("mutation") == "create") != (F.col("revision") == 1), "create_revision")
        .when((F.col("mutation") == "delete") != F.col("deleted"), "deleted_flag")
        .when((F.col("type") == "folder") & (F.col("mutation") == "update"), "folder_update")
        .when((F.col("type") == "folder") & F.col("blob_hash").isNotNull(), "folder_hash")
        .when((F.col("type") == "note") & ~F.col("deleted") & F.col("blob_hash").isNull(), "note_hash")
    )
    return inbox.withColumn("reason", reason)


def token_validity(requests: DataFrame, tokens: DataFrame, sessions: DataFrame, devices: DataFrame, users: DataFrame) -> DataFrame:
    """requests (request_id, token_hash, at) with `reason`, the first ground on which one isn't valid, null if it is: unknown token,
    revoked, not within [issued, expires), session unknown, revoked or not within [created, expires), device or user not active.

    Sessions meet devices and users, and tokens their sessions, before requests do, which are joined once; rows without a key are dealt out."""
    t = tokens.select("token_hash", "session_id", "issued", "expires", "revoked")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = devices.select("device_id", F.col("active").alias("d_active"))
    u = users.select("user_id", F.col("active").alias("u_active"))
    s = sessions.select("session_id", "device_id", "user_id", F.col("created").alias("s_created"), F.col("expires").alias("s_expires"), F.col("revoked").alias("s_revoked"))
    s = _left_by(_left_by(s, d, "device_id", "session_id"), u, "user_id", "session_id").select("session_id", "s_created", "s_expires", "s_revoked", on("d_active").alias("d_active"), on("u_active").alias("u_active"))
    rows = _left_by(requests, _left_by(t, s, "session_id", "token_hash"), "token_hash", "request_id")
    reason = (
        F.when(F.col("issued").isNull(), "unknown_token").when(F.col("revoked"), "revoked").when(F.expr("at < issued OR at >= expires"), "expired")
        .when(F.col("s_created").isNull() | F.col("s_revoked"), "session").when(F.expr("at < s_created OR at >= s_expires"), "session_expired")
        .when(~on("d_active"), "device").when(~on("u_active"), "user")
    )
    return rows.select(*requests.columns, reason.alias("reason"))


def _left_by(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """left joined with right by key. Rows without a key meet nothing; they are dealt to tasks by the column spread, for by their key one task would have them all."""
    dealt = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0))
    same = F.pmod(F.xxhash64(key), F.lit(1))  # 0, but no literal, which would be no key
    return left.withColumn("dealt", dealt).join(right.withColumn("dealt", same), [key, "dealt"], "left").drop("dealt")


def blob_access_check(requests: DataFrame, entitlements: DataFrame, blobs: DataFrame, users: DataFrame) -> DataFrame:
    """requests (request_id, user_id, tenant, blob_hash) with `outcome`: available or unavailable; why it isn't is never told."""
    may = users.where("active").select("user_id", F.lit(True).alias("is_user")).distinct()
    held = entitlements.select("tenant", "blob_hash", F.lit(True).alias("is_held")).distinct()
    stored = blobs.where("available").select("blob_hash", F.lit(True).alias("is_stored")).distinct()
    rows = requests.join(may, "user_id", "left").join(held, ["tenant", "blob_hash"], "left").join(stored, "blob_hash", "left")
    return rows.select(*requests.columns, F.when(F.expr("is_user AND is_held AND is_stored"), "available").otherwise("unavailable").alias("outcome"))


def refresh_reuse_report(uses: DataFrame, tokens: DataFrame) -> DataFrame:
    """uses (use_id, token_hash, at) of refresh tokens (token_hash, session_id, issued, expires) with their outcome. The first use of a
    token within its time rotates it; any later one revokes its session from then on; what comes at or after that instant fails.
    Uses of unknown tokens have no session and are dealt out in the joins."""
    rows = _left_by(uses, tokens, "token_hash", "use_id")
    valid = F.expr("issued IS NOT NULL AND at >= issued AND at < expires")
    firsts = rows.where(valid).groupBy("token_hash").agg(F.min(F.struct("at", "use_id")).alias("f"))
    rows = _left_by(rows, firsts, "token_hash", "use_id").withColumn("reuse", F.col("f").isNotNull() & (F.struct("at", "use_id") > F.col("f")))
    revoked = rows.where("reuse").groupBy("session_id").agg(F.min(F.struct("at", "use_id")).alias("r"))
    rows = _left_by(rows, revoked, "session_id", "use_id")
    here = F.struct("at", "use_id")
    outcome = (
        F.when(F.col("session_id").isNull(), "unknown").when(F.col("r").isNotNull() & (here == F.col("r")), "reuse_revokes")
        .when(F.col("r").isNotNull() & (here > F.col("r")), "session_revoked").when(valid, "rotated").otherwise("expired")
    )
    return rows.select(*uses.columns, "session_id", outcome.alias("outcome"))


def revocation_cascade(devices: DataFrame, sessions: DataFrame, tokens: DataFrame, requests: DataFrame) -> DataFrame:
    """When each access token (token_hash, session_id, issued, revoked_at) is revoked by requests (device_id, at) to revoke devices, through their
    sessions; an earlier time that is already there is kept, and none lies before the token was issued."""
    first = requests.join(devices.select("device_id"), "device_id", "left_semi").groupBy("device_id").agg(F.min("at").alias("at"))
    down = tokens.join(sessions.select("session_id", "device_id"), "session_id").join(first, "device_id", "left")
    return down.select("token_hash", "session_id", "device_id", F.coalesce("revoked_at", F.greatest("at", F.when(F.col("at").isNotNull(), F.col("issued")))).alias("revoked_at"))


def registration_expiry(registrations: DataFrame, verifications: DataFrame, now: int, lifetime: int = 24 * 3600) -> DataFrame:
    """registrations (registration_id, issued in seconds) with status: verified at the first verification (registration_id, at) within
    [issued, issued + lifetime), else pending, or expired once that time is over."""
    within = verifications.join(registrations, "registration_id").where((F.col("at") >= F.col("issued")) & (F.col("at") < F.col("issued") + lifetime))
    first = within.groupBy("registration_id").agg(F.min("at").alias("verified_at"))
    status = F.when(F.col("verified_at").isNotNull(), "verified").when(F.col("issued") + lifetime <= now, "expired").otherwise("pending")
    return registrations.join(first, "registration_id", "left").select("registration_id", "issued", "verified_at", status.alias("status"))


def erase_tenant(tables: dict[str, DataFrame], tenants: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the tenants (tenant); every table has a column tenant."""
    gone = tenants.select("tenant").distinct()
    return {name: df.join(gone, "tenant", "left_anti") for name, df in tables.items()}


def orphaned_blobs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hashes that entitlements (tenant, blob_hash) held before and no longer do."""
    return before.select("blob_hash").distinct().join(after.select("blob_hash"), "blob_hash", "left_anti")


def session_roster(sessions: DataFrame, devices: DataFrame, current: DataFrame) -> DataFrame:
    """Sessions (user_id, session_id, device_id, created) with their device's name, their place (newest first, then by id) and whether they are current."""
    rows = sessions.join(devices.select("device_id", "device_name"), "device_id", "left")
    rows = rows.join(current.select("session_id", F.lit(True).alias("is_current")).distinct(), "session_id", "left")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created"), "session_id"))
    return rows.select("user_id", "session_id", "device_name", "created", F.coalesce("is_current", F.lit(False)).alias("is_current"), place.alias("place"))


def delivery_due_queue(outbox: DataFrame, attempts: DataFrame, now: int, first_wait: int = 15, most_steps: int = 8) -> DataFrame:
    """Messages (message_id, created, expires) due at `now` and not expired: failures so far, and when they may be tried, which is first_wait
    seconds after the last failure (message_id, at), doubled with each up to most_steps. Times are seconds."""
    tried = attempts.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    wait = F.lit(first_wait) * F.pow(F.lit(2), F.least("n", F.lit(most_steps)) - 1)
    rows = outbox.join(tried, "message_id", "left").withColumn("due", F.coalesce(F.col("last") + wait, F.col("created")).cast("long"))
    return rows.where((F.col("due") <= now) & (F.col("expires") > now)).select("message_id", F.coalesce("n", F.lit(0)).alias("n_failed"), "due", "created")


def fold(rows: DataFrame, key: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """step(state, row) -> (state, outcome) over each key's rows in order; state begins as None. Keys are dealt to tasks, which read
    their rows in order and hold one state at a time; schema is that of rows with the outcome behind it."""

    def run(batches):
        last, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if k != last:
                    last, state = k, None
                state, outcome = step(state, row)
                out.append(outcome)
            yield pdf.assign(outcome=pd.Series(out, index=pdf.index, dtype=object))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit_decisions(attempts: DataFrame, limit: int, window: int) -> DataFrame:
    """attempts (key, at in seconds, attempt_id) with `outcome`: null if allowed, else the seconds to wait. A key's window begins with its first
    attempt and ends `window` seconds later, or when time goes backwards; rejected attempts don't extend it."""

    def step(state, row):
        if state is None or row.at - state[0] >= window or row.at < state[0]:
            return (row.at, 1), None
        start, n = state
        return ((start, n + 1), None) if n < limit else (state, window - (row.at - start))

    return fold(attempts.select("key", "at", "attempt_id"), "key", ["at", "attempt_id"], step, "key string, at long, attempt_id long, outcome long")


def quota_admission(uploads: DataFrame, limit: int) -> DataFrame:
    """uploads (tenant, sequence, blob_hash, size) with `admitted`: in order, a hash that the tenant already has is free, another one must
    fit into what is left. What a tenant uses never shrinks, so a hash's first upload decides for all later ones, and
    only first uploads are folded, with one number as state."""
    firsts = uploads.groupBy("tenant", "blob_hash").agg(F.min(F.struct("sequence", "size")).alias("f")).select("tenant", "blob_hash", "f.sequence", "f.size")

    def step(used, row):
        used = used or 0
        fits = row.size <= limit - used
        return (used + row.size if fits else used), int(fits)

    kinds = dict(firsts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("tenant", "blob_hash", "sequence", "size")) + ", outcome long"
    decided = fold(firsts, "tenant", ["sequence"], step, schema).select("tenant", "blob_hash", (F.col("outcome") == 1).alias("admitted"))
    return uploads.join(decided, ["tenant", "blob_hash"])


def blob_store_audit(registry: DataFrame, files: DataFrame) -> DataFrame:
    """registry (blob_hash, size, available) against files (path, size, content_hash) named by their hash: blob_hash, status (ok, missing, corrupt, orphan,
    malformed, unavailable)."""
    named = files.withColumn("blob_hash", F.regexp_extract("path", "([0-9a-f]{64})$", 1))
    bad = named.where("blob_hash = ''").select(F.col("path").alias("blob_hash"), F.lit("malformed").alias("status"))
    f = named.where("blob_hash <> ''").select("blob_hash", F.col("size").alias("f_size"), "content_hash")
    both = registry.join(f, "blob_hash", "full")
    status = (
        F.when(F.col("size").isNull(), "orphan").when(F.col("f_size").isNull(), F.when(F.col("available"), "missing").otherwise("unavailable"))
        .when((F.col("size") != F.col("f_size")) | (F.col("blob_hash") != F.col("content_hash")), "corrupt").otherwise("ok")
    )
    return both.select("blob_hash", status.alias("status")).unionByName(bad)


def classify_proposals(proposals: DataFrame, objects: DataFrame, paths: DataFrame) -> DataFrame:
    """proposals (operation_id, kind, object_id, type, base_revision, parent_id, name_key) against one state, objects (object_id, parent_id, type, revision, deleted,
    name_key) and its ancestor_paths: `code` is accepted or the first ground for a conflict. The order of the rules is their meaning. Where proposals have
    `name`, a create or move whose path, or after a folder's move the longest path below it, has more than PATH_BYTES is
    `invalid`, which comes before path_collision."""
    known = objects.select("object_id", F.col("type").alias("k_type"), "revision", "deleted")
    parents = objects.select(F.col("object_id").alias("parent_id"), F.col("type").alias("p_type"), F.col("deleted").alias("p_deleted"))
    alive = objects.where("NOT deleted")
    placed = F.col("kind").isin("create", "move")
    rows = proposals.join(known, "object_id", "left").join(parents, "parent_id", "left")
    rows = rows.join(paths.select(F.col("object_id").alias("parent_id"), F.col("ancestors").alias("above")), "parent_id", "left")
    # of siblings of a key, at most one is active; two are kept so that an object doesn't collide with itself
    keys = alive.groupBy(F.col("parent_id").alias("s_parent"), F.col("name_key").alias("s_key")).agg(F.min("object_id").alias("one"), F.max("object_id").alias("other"))
    rows = rows.join(keys, F.col("parent_id").eqNullSafe(F.col("s_parent")) & (F.col("name_key") == F.col("s_key")), "left")
    holders = alive.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("object_id"), F.lit(True).alias("has_child")).distinct()
    rows = rows.join(holders, "object_id", "left")
    too_long = F.lit(False)
    if "name" in proposals.columns:
        ok = paths.where("status = 'ok'").select("object_id", "ancestors", F.octet_length("path").alias("bytes"))
        rows = rows.join(ok.select(F.col("object_id").alias("parent_id"), F.col("bytes").alias("parent_bytes")), "parent_id", "left")
        folders = proposals.where("kind = 'move' AND type = 'folder'").select("object_id").distinct()
        below = ok.select(F.explode("ancestors").alias("object_id"), "bytes").join(folders, "object_id", "left_semi").groupBy("object_id").agg(F.max("bytes").alias("deepest"))
        below = below.join(ok.select("object_id", "bytes"), "object_id").select("object_id", (F.col("deepest") - F.col("bytes")).alias("more"))
        rows = rows.join(below, "object_id", "left")
        more = F.when((F.col("kind") == "move") & (F.col("type") == "folder"), F.coalesce("more", F.lit(0))).otherwise(0)
        too_long = F.coalesce(F.col("parent_bytes") + 1, F.lit(0)) + F.octet_length("name") + more > PATH_BYTES
    code = (
        F.when((F.col("kind") == "create") & F.col("revision").isNotNull(), "object_exists")
        .when((F.col("kind") != "create") & F.col("revision").isNull(), "object_missing")
        .when((F.col("kind") != "create") & F.col("deleted"), "object_deleted")
        .when((F.col("kind") != "create") & (F.col("type") != F.col("k_type")), "type_mismatch")
        .when((F.col("kind") != "create") & (F.col("base_revision") != F.col("revision")), "base_revision_mismatch")
        .when(placed & F.col("parent_id").isNotNull() & (F.col("p_type").isNull() | F.coalesce("p_deleted", F.lit(False)) | (F.col("p_type") != "folder")), "parent_unavailable")
        .when((F.col("kind") == "move") & (F.col("type") == "folder") & ((F.col("parent_id") == F.col("object_id")) | F.coalesce(F.array_contains("above", F.col("object_id")), F.lit(False))), "folder_cycle")
        .when(placed & F.coalesce(too_long, F.lit(False)), "invalid")
        .when(placed & F.col("one").isNotNull() & ((F.col("one") != F.col("object_id")) | (F.col("other") != F.col("object_id"))), "path_collision")
        .when((F.col("kind") == "delete") & (F.col("type") == "folder") & F.coalesce("has_child", F.lit(False)), "folder_not_empty")
        .otherwise("accepted")
    )
    return rows.select("operation_id", "kind", "object_id", code.alias("code"))
