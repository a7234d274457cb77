"""Operators that decide what a replica does next: conflict actions, the order of mutations, names of copies, tags and addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import collision_key
from ..sources.tables import persisted
from .content import NAME_BYTES, name_problem


def resolve_conflicts(conflicts: DataFrame) -> DataFrame:
    """conflicts with `action`, the first rule that fits. Columns: kind, type (note, folder), code (the conflict's), base_revision, canonical_revision and
    canonical_type and canonical_deleted (null without canonical object), same_target and same_parent (whether the proposed place, and its
    parent, is the canonical one). Nulls in flags count as false; a conflict that no rule fits needs_attention."""
    c = lambda x: F.coalesce(x, F.lit(False))
    kind, code = (lambda *k: c(F.col("kind").isin(*k))), (lambda *k: c(F.col("code").isin(*k)))
    folder, note = c(F.col("type") == "folder"), c(F.col("type") == "note")
    known = F.col("canonical_revision").isNotNull()
    newer, gone = c(F.col("canonical_revision") > F.col("base_revision")), c(F.col("canonical_deleted"))
    alive = known & ~gone
    stale, missing, deleted = code("base_revision_mismatch"), code("object_missing"), code("object_deleted")
    blocked = code("path_collision", "parent_unavailable")
    target, parent = c(F.col("same_target")), c(F.col("same_parent"))
    tombstone = deleted & gone & newer & c(F.col("canonical_type") == F.col("type"))
    rules = [
        (folder & kind("create") & blocked & ~known, "recover_folder"),
        (folder & kind("move") & deleted, "recover_moved_folder"),
        (folder & kind("delete") & stale & alive & newer, "preserve_then_delete"),
        (folder & kind("move") & stale & ~target, "split_divergent_folder"),
        (folder & kind("move") & (blocked | code("folder_cycle") | target), "revert_move"),
        (folder & kind("delete") & code("folder_not_empty"), "restore_folder"),
        (kind("delete") & (missing & ~known | tombstone), "already_deleted"),
        (note & kind("move") & stale & target, "equivalent"),
        (note & ~known & (kind("create") & blocked | kind("update", "move") & missing), "copy_orphan"),
        (note & kind("move") & (blocked | stale & parent), "copy_and_restore"),
        (note & newer & (kind("update") & (stale | deleted) | kind("move") & deleted), "keep_both"),
        (note & kind("delete") & stale & alive & newer, "rescue_remote_then_delete"),
    ]
    action = F.when(rules[0][0], rules[0][1])
    for fits, name in rules[1:]:
        action = action.when(fits, name)
    return conflicts.withColumn("action", action.otherwise("needs_attention"))


def numbered(rows: DataFrame, key: str, order: list[str], place: str, marked: Column) -> DataFrame:
    """rows with place, which counts from 1 in each key by `order`, n_all, the key's rows, and n_marked, those of them that are marked.

    All rows are sorted at once by ranges, so a key with a third of them lies in many tasks. The sorted rows are written with their
    task and place there; what tasks before hold of a key is added from a table of (key, task)."""
    whole = rows.orderBy(key, *order).withColumn("n_task", F.spark_partition_id()).withColumn("n_at", F.monotonically_increasing_id())
    whole = persisted(whole)
    sums = whole.groupBy(F.col(key).alias("n_key"), F.col("n_task").alias("n_part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("n_at").alias("n_low"), F.count(F.when(marked, 1)).alias("m")
    )
    by_key = W.partitionBy("n_key")
    before = by_key.orderBy("n_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "n_key", "n_part", "n_low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("n").over(by_key).alias("n_all"), F.sum("m").over(by_key).alias("n_marked")
    )
    out = whole.join(sums, F.col(key).eqNullSafe(F.col("n_key")) & (F.col("n_task") == F.col("n_part")))
    return out.withColumn(place, F.col("n_at") - F.col("n_low") + F.col("n_before") + 1).drop("n_key", "n_part", "n_low", "n_before", "n_task", "n_at")


def plan_mutation_order(diff: DataFrame) -> DataFrame:
    """diff (replica, object_id, parent_id, mutation, path, revision) with place, depends_on and base_revision. Creates come by depth and path, each depending on
    its parent's create if there is one; then moves and updates by path, an object's move before its update, which depends on it and counts on one
    revision more; then deletes, deepest first, each depending on the delete before it. place counts from 1 in each replica; depends_on
    is the place of the mutation that must be through first, null if none. Rows whose mutation is null or another are left out. No task
    orders a whole replica: see numbered()."""
    depth = F.size(F.split("path", "/"))
    phase = F.when(F.col("mutation") == "create", 1).when(F.col("mutation").isin("move", "update"), 2).when(F.col("mutation") == "delete", 3)
    deep = F.when(F.col("phase") == 1, depth).when(F.col("phase") == 3, -depth).otherwise(0)
    last = F.when(F.col("mutation") == "update", 1).otherwise(0)
    rows = diff.withColumn("phase", phase).where("phase IS NOT NULL").withColumn("deep", deep).withColumn("last", last)
    placed = numbered(rows, "replica", ["phase", "deep", "path", "object_id", "last"], "place", F.col("phase") == 3)
    of_object = W.partitionBy("replica", "object_id", "phase").orderBy("place")
    moved = (F.col("mutation") == "update") & F.coalesce(F.lag("mutation").over(of_object) == "move", F.lit(False))
    placed = placed.withColumn("move_place", F.when(moved, F.lag("place").over(of_object)))
    parents = placed.where("mutation = 'create'").groupBy("replica", F.col("object_id").alias("parent_id")).agg(F.min("place").alias("parent_place"))
    before = F.when((F.col("phase") == 3) & (F.col("place") > F.col("n_all") - F.col("n_marked") + 1), F.col("place") - 1)
    joined = placed.withColumn("delete_place", before).join(parents, ["replica", "parent_id"], "left")
    depends_on = F.when(F.col("phase") == 1, F.col("parent_place")).when(F.col("phase") == 2, F.col("move_place")).otherwise(F.col("delete_place"))
    base = F.when(F.col("phase") == 1, F.lit(0)).otherwise(F.col("revision") + F.when(F.col("move_place").isNotNull(), 1).otherwise(0)).cast("long")
    return joined.select("replica", F.col("place").cast("long").alias("place"), "object_id", "mutation", depends_on.cast("long").alias("depends_on"), base.alias("base_revision"))


@F.pandas_udf(T.StringType())
def _cut(names: pd.Series, most: pd.Series) -> pd.Series:
    """Names of most bytes at most, cut between characters."""
    return pd.Series([x if x is None else x.encode()[: max(0, n)].decode(errors="ignore") for x, n in zip(names, most)], dtype=object)


def conflict_names(rows: DataFrame, label: str = "Konflikt", note: str = "Notiz", folder: str = "Ordner") -> DataFrame:
    """rows (name, type, operation_id) with copy_name: the stem, the label and the operation, the stem cut at a character so that all fits a name's bytes.
    A note's stem is its name without the last extension, and the copy ends in .md; an empty stem becomes the word for its type."""
    is_note = F.col("type") == "note"
    suffix = F.concat(F.lit(f" ({label} - "), F.col("operation_id").cast("string"), F.when(is_note, ").md").otherwise(")"))
    name = F.coalesce("name", F.lit(""))
    stem = F.when(is_note, F.regexp_replace(name, r"\.[^./]*$", "")).otherwise(name)
    room = F.lit(NAME_BYTES) - F.octet_length(suffix)
    stem = F.when(F.octet_length(stem) <= room, stem).otherwise(_cut(F.when(F.octet_length(stem) > room, stem), room))
    return rows.withColumn("copy_name", F.concat(F.when(stem == "", F.when(is_note, note).otherwise(folder)).otherwise(stem), suffix))


def recovery_names(rows: DataFrame, occupied: DataFrame, label: str = "Wiederhergestellt", most: int = 999) -> DataFrame:
    """rows (operation_id, parent_id, stem) with name and number: the stem, the label and the operation, and the smallest number from 1 to `most` behind
    it where names of the parent (occupied: parent_id, name) have those before; number is 0 for the name without one. The stem is cut at a character so that all fits a
    name's bytes. Names are equal by collision key. name and number are null where every number is taken, where no character of the stem fits (an empty
    stem stays empty), or where the name isn't portable. operation_id is unique.

    Only names that end like a row's own can be in its way, so these are joined by parent and ending, and the first number missing among
    them is found from their places in order; no row is tried against every number."""
    text = F.col("operation_id").cast("string")
    suffix = F.concat(F.lit(f" ({label} - "), text, F.lit(")"))
    key = collision_key(suffix)

    def candidate(number: Column) -> Column:
        end = F.concat(suffix, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(""))
        room = F.lit(NAME_BYTES) - F.octet_length(end)
        stem = F.when(F.octet_length("stem") <= room, F.col("stem")).otherwise(_cut(F.when(F.octet_length("stem") > room, F.col("stem")), room))
        return F.when((room >= 0) & ((stem != "") | (F.col("stem") == "")), F.concat(stem, end))

    own = rows.select("operation_id", F.col("parent_id").alias("r_parent"), "stem", key.alias("r_key"))
    there = occupied.select(F.col("parent_id").alias("o_parent"), collision_key(F.col("name")).alias("o_key")).distinct()
    start = F.coalesce(F.regexp_extract("o_key", r"( \([^()]*\))(?:-[1-9][0-9]{0,8})?$", 1), F.lit(""))
    number = F.when(F.col("o_key").rlike(r"\)-[1-9][0-9]{0,8}$"), F.regexp_extract("o_key", r"-([0-9]+)$", 1).cast("int")).otherwise(0)
    there = there.select("o_parent", "o_key", start.alias("o_end"), number.alias("o_number")).where("o_end <> ''")
    met = own.join(there, F.col("r_parent").eqNullSafe(F.col("o_parent")) & (F.col("r_key") == F.col("o_end")))
    taken = met.where(collision_key(candidate(F.col("o_number"))) == F.col("o_key")).select("operation_id", "o_number").distinct()
    placed = taken.withColumn("k", F.row_number().over(W.partitionBy("operation_id").orderBy("o_number")) - 1).where("k = o_number")
    free = placed.groupBy("operation_id").agg(F.count(F.lit(1)).cast("int").alias("free"))
    joined = rows.join(free, "operation_id", "left").withColumn("number", F.coalesce("free", F.lit(0))).withColumn("name", candidate(F.col("number")))
    good = F.col("name").isNotNull() & name_problem(F.col("name")).isNull() & (F.col("number") <= most)
    return joined.select("operation_id", "parent_id", "stem", F.when(good, F.col("name")).alias("name"), F.when(good, F.col("number")).alias("number"))


@F.pandas_udf(T.StringType())
def _trimmed(tags: pd.Series) -> pd.Series:
    return tags.map(lambda x: unicodedata.normalize("NFC", x.strip()), na_action="ignore")


def normalize_tags(docs: DataFrame, id_col: str = "doc_id", tags: str = "tags") -> DataFrame:
    """(id_col, tags, valid) for each distinct id: tags trimmed and composed, later ones of an equal collision key dropped, order kept. Where a tag
    is null, empty, longer than 40 characters or 80 bytes, or holds a control character, valid is false and tags null. Ids are unique."""
    each = docs.select(id_col, F.posexplode_outer(tags).alias("at", "tag")).withColumn("tag", _trimmed("tag"))
    fits = F.col("at").isNull() | F.coalesce((F.col("tag") != "") & (F.char_length("tag") <= 40) & (F.octet_length("tag") <= 80) & ~F.col("tag").rlike(r"\p{Cc}"), F.lit(False))
    kept = each.withColumn("fits", fits).groupBy(id_col, collision_key(F.col("tag")).alias("k")).agg(F.min(F.struct("at", "tag")).alias("first"), F.min("fits").alias("fits"))
    whole = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("first.at").isNotNull(), F.col("first")))).alias("all"), F.min("fits").alias("valid"))
    return whole.select(id_col, F.when(F.col("valid"), F.col("all.tag")).alias("tags"), "valid")


# Fixed value: characters of the local part of an address.
LOCAL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*$"
LABELS = r"^(?!(.*\.)?(?!xn)[a-z0-9][a-z0-9-]--)[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$"


def canonical_email(address: Column) -> Column:
    """The key under which addresses are equal: trimmed and in lower case; null for an invalid one. Domains are ASCII (international ones in their xn-- form, which isn't decoded)."""
    trimmed = F.regexp_replace(address, r"^[ \t]+|[ \t]+$", "")
    local, domain = F.substring_index(trimmed, "@", 1), F.lower(F.substring_index(trimmed, "@", -1))
    ok = (F.length(trimmed) - F.length(F.replace(trimmed, F.lit("@"))) == 1) & local.rlike(LOCAL) & (F.length(local) <= 64) & domain.rlike(LABELS) & (F.length(domain) <= 253) & (F.length(trimmed) <= 254)
    return F.when(ok, F.lower(trimmed))


def email_identity(accounts: DataFrame, id_col: str = "account_id", email: str = "email") -> DataFrame:
    """(id_col, canonical, n_same): the account's key and how many accounts share it; both null for an invalid or null address. The counts are joined by key,
    so that invalid ones make no group."""
    keyed = accounts.select(id_col, canonical_email(F.col(email)).alias("canonical"))
    counts = keyed.where("canonical IS NOT NULL").groupBy("canonical").agg(F.count(F.lit(1)).alias("n_same"))
    return keyed.join(counts, "canonical", "left").select(id_col, "canonical", "n_same")


def independent_changes(inbox: DataFrame, baselines: DataFrame, paths: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(tenant, cursor, object_id) of downloaded changes that may be applied out of order. inbox (tenant, cursor, object_id, type, mutation, revision) holds what isn't
    applied; baselines object_id and revision; paths comes from ancestor_paths; unresolved has object_id. A change qualifies if it updates or deletes
    a note whose baseline is the revision before, nothing earlier of the object waits, the object isn't unresolved, and each folder above it has a
    baseline, isn't unresolved and has no earlier change waiting. Objects that paths doesn't lead to the root are left out. Object ids are
    unique across tenants."""
    first = inbox.groupBy("object_id").agg(F.min("cursor").alias("first"))
    base = baselines.groupBy("object_id").agg(F.max("revision").alias("baseline"))
    open_ = unresolved.select("object_id", F.lit(True).alias("open")).distinct()
    facts = base.join(first, "object_id", "full").join(open_, "object_id", "full")
    rows = inbox.where("type = 'note' AND mutation IN ('update', 'delete')").join(facts, "object_id").where("baseline = revision - 1 AND cursor = first AND open IS NULL").select("tenant", "cursor", "object_id")
    above = rows.join(paths.where("status = 'ok'").select("object_id", "ancestors"), "object_id").select("tenant", "cursor", "object_id", F.explode_outer("ancestors").alias("folder"))
    judged = above.join(facts.withColumnRenamed("object_id", "folder"), "folder", "left")
    free = F.expr("folder IS NULL OR baseline IS NOT NULL AND open IS NULL AND (first IS NULL OR first > cursor)")
    return judged.groupBy("tenant", "cursor", "object_id").agg(F.min(free).alias("free")).where("free").drop("free")
