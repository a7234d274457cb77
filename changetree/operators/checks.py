"""Checks of pages before they are applied, of listings, and of sealed chains; and the tree of folders with its notes counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import collision_key
from .content import name_problem


def page_conflict_check(page: DataFrame, objects: DataFrame, unresolved: DataFrame, blobs: DataFrame) -> DataFrame:
    """page (tenant, cursor, object_id, type, mutation, revision, parent_id, name, blob_hash) with `reason`, the first ground against applying a change; null
    if there is none.

    objects (tenant, object_id, type, parent_id, name, blob_hash) is what is stored, unresolved (tenant, object_id) has open intents, blobs (blob_hash,
    content_hash, note_id) the bytes at hand: their real hash and the id they carry. Each change is held against the one of its object before
    it in the page, or against the stored object: a window by object that the stored rows begin. Reasons in order: local_intent,
    shape, extension, parent_missing (neither stored nor created earlier in the page as a folder), missing_blob, hash_mismatch,
    identity_mismatch, unknown_object, after_delete, repeated_create, path_changed, bytes_changed, delete_differs."""
    p = page.select("tenant", "cursor", "object_id", "type", "mutation", "revision", "parent_id", "name", "blob_hash")
    stored = objects.select("tenant", F.lit(None).cast(p.schema["cursor"].dataType).alias("cursor"), "object_id", "type", F.lit("stored").alias("mutation"), F.lit(None).cast(p.schema["revision"].dataType).alias("revision"), "parent_id", "name", "blob_hash")
    by_object = W.partitionBy("tenant", "object_id").orderBy(F.asc_nulls_first("cursor"))
    before = lambda c: F.lag(c).over(by_object).alias(f"was_{c}")
    rows = p.unionByName(stored).select("*", *map(before, ["mutation", "type", "parent_id", "name", "blob_hash"])).where("mutation <> 'stored'")
    folders = p.where("type = 'folder' AND mutation = 'create'").select("tenant", "object_id", "cursor").unionByName(objects.where("type = 'folder'").select("tenant", "object_id", F.lit(-1).cast(p.schema["cursor"].dataType).alias("cursor")))
    folders = folders.groupBy("tenant", F.col("object_id").alias("parent_id")).agg(F.min("cursor").alias("since"))
    rows = rows.join(folders, ["tenant", "parent_id"], "left").join(unresolved.select("tenant", "object_id", F.lit(True).alias("open")).distinct(), ["tenant", "object_id"], "left")
    held = blobs.groupBy("blob_hash").agg(F.min("content_hash").alias("content_hash"), F.min("note_id").alias("note_id"))
    rows = rows.join(held, "blob_hash", "left")
    note, kind, had = F.col("type") == "note", F.col("mutation"), F.col("was_mutation").isNotNull()
    same_place = F.col("parent_id").eqNullSafe(F.col("was_parent_id")) & (F.col("name") == F.col("was_name"))
    same_bytes = F.col("blob_hash").eqNullSafe(F.col("was_blob_hash"))
    shape = ~kind.isin("create", "update", "move", "delete") | (F.col("revision") < F.when(kind == "create", 1).otherwise(2)) | ((kind == "create") & (F.col("revision") != 1)) | ((kind == "update") & ~note)
    shape |= F.col("name").isNull() | name_problem(F.col("name")).isNotNull() | (~note & F.col("blob_hash").isNotNull())
    reason = (
        F.when(F.col("open"), "local_intent").when(F.coalesce(shape, F.lit(True)), "shape").when(note & ~F.lower("name").endswith(".md"), "extension")
        .when(F.col("parent_id").isNotNull() & (F.col("since").isNull() | (F.col("since") >= F.col("cursor"))), "parent_missing")
        .when(note & F.col("content_hash").isNull(), "missing_blob").when(note & (F.col("content_hash") != F.col("blob_hash")), "hash_mismatch")
        .when(note & ~F.col("note_id").eqNullSafe(F.col("object_id")), "identity_mismatch")
        .when((kind != "create") & ~had, "unknown_object").when(F.col("was_mutation") == "delete", "after_delete")
        .when((kind == "create") & had & ((F.col("was_mutation") != "stored") | (F.col("was_type") != F.col("type")) | ~same_place), "repeated_create")
        .when((kind == "update") & ~same_place, "path_changed").when((kind == "move") & ~same_bytes, "bytes_changed").when((kind == "delete") & ~(same_place & same_bytes), "delete_differs")
    )
    return rows.select("tenant", "cursor", "object_id", "mutation", reason.alias("reason"))


def inventory_issues(inventory: DataFrame) -> DataFrame:
    """Issues (path, code, detail) of an inventory (path, type, note_id, problem, readable): invalid_name, name_collision (each of several siblings with
    one collision key), invalid_front_matter with its problem, duplicate_note_id (each holder) and unreadable. A path may have several."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = inventory.select("path", "type", "note_id", "problem", "readable", name.alias("name"), F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("parent"))
    bad = name_problem(F.col("name"))
    issue = lambda rows, code, detail: rows.select("path", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    named = rows.where(bad.isNull()).withColumn("key", collision_key(F.col("name")))
    keys = named.groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = rows.where("type = 'note' AND note_id IS NOT NULL").groupBy("note_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = issue(rows.where(bad.isNotNull()), "invalid_name", bad).unionByName(issue(named.join(keys, ["parent", "key"]), "name_collision", F.col("key")))
    out = out.unionByName(issue(rows.where("problem IS NOT NULL"), "invalid_front_matter", F.col("problem")))
    out = out.unionByName(issue(rows.where("type = 'note'").join(ids, "note_id"), "duplicate_note_id", F.col("note_id")))
    return out.unionByName(issue(rows.where("NOT readable"), "unreadable", F.lit(None)))


def natural_key(path: Column) -> Column:
    """Sorts names by case-insensitive letters and by the value of numbers up to 20 digits; between folders by level."""
    padded = F.regexp_replace(F.lower(path), "([0-9]+)", "0" * 20 + "$1")
    return F.replace(F.regexp_replace(padded, "[0-9]*([0-9]{20})", "$1"), F.lit("/"), F.lit("\x01"))


def tag_tree_rollup(docs: DataFrame, folders: DataFrame, tag: str | None = None) -> DataFrame:
    """(folder, depth, n_notes, n_direct, sort_key): folders with the notes below them and those directly in them. docs are (path, tag_keys), folders
    (path). With a tag only notes that carry it count, and only folders that hold one are listed; else all are. A folder that only its notes'
    paths name is listed, too. Ordered by sort_key, folders stand as a tree does."""
    notes = docs.where(F.array_contains("tag_keys", tag)) if tag is not None else docs
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = notes.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("folder"), F.lit(1).alias("n"), F.regexp_extract("path", "^(.*)/", 1).alias("own"))
    counts = rows.groupBy("folder").agg(F.sum("n").alias("n_notes"), F.sum((F.col("own") == F.col("folder")).cast("long")).alias("n_direct"))
    if tag is None:
        every = folders.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder")).select("folder").distinct()
        counts = counts.join(every, "folder", "full")
    return counts.select("folder", F.size(F.split("folder", "/")).cast("long").alias("depth"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("n_direct", F.lit(0)).alias("n_direct"), natural_key(F.col("folder")).alias("sort_key"))


def ancestry_seal_check(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """(seal_id, valid, n_sealed, n_current, n_equal): whether a stored chain of ancestors still is the current one. Both are (seal_id, depth, ancestor_id,
    parent_id, path, device, inode, revision); they must have the same length, agree in every link, be known to device, inode and
    revision, and end at a root."""
    link = ["ancestor_id", "parent_id", "path", "device", "inode", "revision"]
    s, c = sealed.select("seal_id", "depth", *link), current.select("seal_id", "depth", *[F.col(x).alias(f"c_{x}") for x in link])
    both = s.withColumn("in_s", F.lit(1)).join(c.withColumn("in_c", F.lit(1)), ["seal_id", "depth"], "full")
    equal = F.forall(F.array(*[F.col(x).eqNullSafe(F.col(f"c_{x}")) for x in link]), lambda x: x) & (F.col("device") > 0) & (F.col("inode") > 0) & (F.col("revision") > 0)
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    counts = both.groupBy("seal_id").agg(
        F.count("in_s").alias("n_sealed"), F.count("in_c").alias("n_current"), one(F.col("in_s").isNotNull() & F.col("in_c").isNotNull() & equal).alias("n_equal"), one(F.col("in_c").isNotNull() & F.col("c_parent_id").isNull()).alias("roots")
    )
    valid = (F.col("n_sealed") == F.col("n_current")) & (F.col("n_sealed") == F.col("n_equal")) & (F.col("roots") > 0)
    return counts.where("n_sealed > 0").select("seal_id", valid.alias("valid"), "n_sealed", "n_current", "n_equal")
