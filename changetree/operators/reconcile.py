"""Reconciliation of two listings of folder trees: what a folder is, once it may have moved.

Folders carry no id in themselves. A listing has (tree, path, type, object_id) and for folders device and inode; paths are relative with
/ between names. All operators are joins and aggregations by tree and path; none gathers a tree in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import persisted


def _prefixes(path: Column, own: bool) -> Column:
    """The folders that a path lies in, from the root down, with the path itself at the end if own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - (0 if own else 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _inside(path: Column, own: bool = False) -> Column:
    deep = F.lit(True) if own else F.contains(path, F.lit("/"))
    return F.when(deep, _prefixes(path, own)).otherwise(F.array().cast("array<string>"))


def folder_signatures(listing: DataFrame, unique_ids: bool = False) -> DataFrame:
    """(tree, path, signature) of each folder of listing (tree, path, type, object_id): equal where the same names of folders, and the same names
    and ids of notes, lie below; empty where nothing does. With unique_ids notes without an id and ids that two notes of a tree
    carry don't count. A signature is the number of records with the exclusive or of their SHA-256, so that folders of any
    size are added up before they meet."""
    kept = listing.where("tree IS NOT NULL AND path IS NOT NULL")
    folders = kept.where("type = 'folder'").select("tree", "path").distinct()
    if unique_ids:
        times = kept.where("type = 'note' AND object_id IS NOT NULL").groupBy("tree", "object_id").agg(F.count(F.lit(1)).alias("times"))
        kept = kept.join(times, ["tree", "object_id"], "left").where("type = 'folder' OR times = 1")
    rows = kept.select("tree", "path", "type", "object_id", F.explode(_inside(F.col("path"))).alias("folder"))
    rest = F.expr("substring(path, length(folder) + 2)")
    record = F.when(F.col("type") == "folder", F.concat(F.lit("D:"), rest)).otherwise(F.concat(F.lit("N:"), rest, F.lit(":"), F.coalesce("object_id", F.lit(""))))
    digest = rows.select("tree", F.col("folder").alias("path"), F.sha2(record.cast("binary"), 256).alias("d"))
    part = lambda k: F.hex(F.expr(f"bit_xor(CAST(conv(substring(d, {16 * k + 1}, 16), 16, -10) AS BIGINT))"))
    found = digest.groupBy("tree", "path").agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[part(k) for k in range(4)]).alias("signature"))
    return folders.join(found, ["tree", "path"], "left").select("tree", "path", F.coalesce("signature", F.lit("")).alias("signature"))


def infer_moves_from_hints(prev: DataFrame, cur: DataFrame, hints: DataFrame) -> DataFrame:
    """(tree, old_path, new_path) of folders that moved with a hinted folder.

    prev and cur are folders (tree, path, signature), hints (tree, path) old folders that a watcher saw move. A new top folder is one
    that prev lacks and that lies in none such. Hints are taken by depth, then by path: one maps to the only new top folder, not yet
    taken, whose signature equals that of the old one, or to the only one left at all where the old one was empty. What lay below
    follows where the new path exists; of several hints above one path the last decides.

    No loop is needed: a target of a signature that two targets have is never the only one, so targets with a signature of their own go to the
    first hint that has it, and an empty hint takes part only where all but one of its tree's targets are taken before it."""
    old, now = (persisted(rows.select("tree", "path", "signature")) for rows in (prev, cur))  # each is read several times
    order = F.struct(F.size(F.split("path", "/")).alias("depth"), "path")
    fresh = persisted(now.join(old.select("tree", "path"), ["tree", "path"], "left_anti"))
    below = fresh.select("tree", F.col("path").alias("child"), F.explode(_inside(F.col("path"))).alias("path")).join(fresh.select("tree", "path"), ["tree", "path"], "left_semi")
    targets = fresh.join(below.select("tree", F.col("child").alias("path")).distinct(), ["tree", "path"], "left_anti")
    asked = hints.select("tree", "path").distinct().join(old, ["tree", "path"]).withColumn("at", order)
    single = targets.where("signature <> ''").groupBy("tree", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).where("n = 1")
    takes = asked.where("signature <> ''").join(single, ["tree", "signature"]).groupBy("tree", "target").agg(F.min(F.struct("at", "path")).alias("first"))
    takes = persisted(takes.select("tree", "target", F.col("first.at").alias("at"), F.col("first.path").alias("old_root")))
    last_two = takes.withColumn("k", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("at")))).where("k <= 2")
    ends = last_two.groupBy("tree").agg(F.max("at").alias("last"), F.min(F.when(F.col("k") == 2, F.col("at"))).alias("before"), F.max_by("target", "at").alias("last_target"))
    totals = targets.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).join(takes.groupBy("tree").agg(F.count(F.lit(1)).alias("taken")), "tree", "left").join(ends, "tree", "left")
    every = F.coalesce("taken", F.lit(0)) == F.col("n")
    all_but_one = every | (F.coalesce("taken", F.lit(0)) == F.col("n") - 1)
    after = F.when(every, F.col("before")).otherwise(F.col("last"))
    empty = asked.where("signature = ''").join(totals.where(all_but_one), "tree")
    empty = empty.where((after.isNull() | (F.col("at") > after)) & (~every | (F.col("at") < F.col("last")))).groupBy("tree").agg(F.min(F.struct("at", "path")).alias("first"))
    left_over = targets.join(takes.select("tree", F.col("target").alias("path")), ["tree", "path"], "left_anti").groupBy("tree").agg(F.min("path").alias("rest"))
    empty = empty.join(totals, "tree").join(left_over, "tree", "left").select("tree", F.coalesce("rest", "last_target").alias("target"), F.col("first.at").alias("at"), F.col("first.path").alias("old_root"))
    takes = takes.join(empty.select("tree", "target"), ["tree", "target"], "left_anti")
    moved = takes.unionByName(empty)
    follows = old.select("tree", F.col("path").alias("old_path"), F.explode(_inside(F.col("path"), own=True)).alias("old_root")).join(moved, ["tree", "old_root"])
    follows = follows.withColumn("path", F.concat("target", F.expr("substring(old_path, length(old_root) + 1)"))).join(now.select("tree", "path"), ["tree", "path"], "left_semi")
    return follows.groupBy("tree", "old_path").agg(F.max_by("path", "at").alias("new_path"))


def match_moved_folders(prev: DataFrame, cur: DataFrame, forced: DataFrame | None = None, trusted_new: DataFrame | None = None, recovery: bool = False) -> DataFrame:
    """What each folder is: (tree, path, old_path, object_id, state).

    prev is (tree, path, object_id, device, inode, signature, state), cur (tree, path, device, inode, signature), forced (tree, old_path, new_path)
    moves known from elsewhere. An old folder may be a current one if device and inode are equal and either the path is, and the old one
    wasn't pending, or the signature is and isn't empty; a forced one can be its target only, which is nothing else's. Pairs in which
    neither has another partner are `known`. A current folder without one is `new` where its tree has no old one left over, or where
    trusted_new (tree, path) has it, else `ambiguous`, as all are in recovery. Old ones left over stay, as `pending`, while their tree has
    a current one without a partner. Null devices and inodes count as 0.

    Where several old or several current folders share device, inode and signature, none of them can have just one partner, so
    such groups are counted and never paired."""
    same = ["tree", "device", "inode"]
    old = prev.select("tree", F.col("path").alias("old_path"), "object_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in same[1:]), "signature", "state")
    now = persisted(cur.select("tree", "path", *(F.coalesce(c, F.lit(0)).alias(c) for c in same[1:]), "signature"))
    old = persisted(old)
    edges = None
    free_old, free_now = old, now
    if forced is not None:
        forced = forced.select("tree", "old_path", F.col("new_path").alias("path")).join(old.select("tree", "old_path"), ["tree", "old_path"], "left_semi").join(now.select("tree", "path"), ["tree", "path"], "left_semi")
        edges = forced.select("tree", "old_path", "path").distinct()
        free_old, free_now = old.join(edges, ["tree", "old_path"], "left_anti"), now.join(edges, ["tree", "path"], "left_anti")
    exact = free_old.where("state <> 'pending'").select(*same, "old_path", F.col("old_path").alias("path")).join(free_now.select(*same, "path"), [*same, "path"]).select("tree", "old_path", "path")
    alike = [*same, "signature"]
    olds = free_old.where("signature <> ''").groupBy(*alike).agg(F.count(F.lit(1)).alias("n_old"), F.min("old_path").alias("old_path"))
    nows = free_now.where("signature <> ''").groupBy(*alike).agg(F.count(F.lit(1)).alias("n_now"), F.min("path").alias("path"))
    groups = olds.join(nows, alike)
    edges = (edges.unionByName(exact) if edges is not None else exact).unionByName(groups.where("n_old = 1 AND n_now = 1").select("tree", "old_path", "path")).distinct()
    crowded = groups.where("n_old > 1 OR n_now > 1").select(*alike)
    n_of = lambda side: F.count(F.lit(1)).over(W.partitionBy("tree", side))
    edges = persisted(edges)
    pairs = edges.withColumn("n_now", n_of("old_path")).withColumn("n_old", n_of("path")).where("n_now = 1 AND n_old = 1").select("tree", "old_path", "path")
    for side, rows in (("old_path", free_old), ("path", free_now)):
        pairs = pairs.join(rows.join(crowded, alike, "left_semi").select("tree", side), ["tree", side], "left_anti")
    pairs = persisted(pairs)
    known = pairs.join(old.select("tree", "old_path", "object_id"), ["tree", "old_path"]).select("tree", "path", "old_path", "object_id", F.lit("known").alias("state"))
    rest_old = old.join(pairs.select("tree", "old_path"), ["tree", "old_path"], "left_anti").select("tree", "old_path", "object_id")
    rest_now = now.join(pairs.select("tree", "path"), ["tree", "path"], "left_anti").select("tree", "path")
    doubts = rest_old.select("tree", F.lit(True).alias("doubt")).distinct()
    rest_now = rest_now.join(doubts, "tree", "left")
    is_new = F.lit(False) if recovery else F.col("doubt").isNull()
    if trusted_new is not None:
        rest_now = rest_now.join(trusted_new.select("tree", "path", F.lit(True).alias("trusted")).distinct(), ["tree", "path"], "left")
        is_new = is_new | F.coalesce("trusted", F.lit(False))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = old.schema["object_id"].dataType
    current = rest_now.select("tree", "path", none("old_path", "string"), none("object_id", kind), F.when(is_new, "new").otherwise("ambiguous").alias("state"))
    pending = rest_old.join(rest_now.select("tree").distinct(), "tree", "left_semi").select("tree", F.col("old_path").alias("path"), "old_path", "object_id", F.lit("pending").alias("state"))
    return known.unionByName(current).unionByName(pending)


def snapshot_changes(prev: DataFrame, cur: DataFrame, durable: DataFrame) -> DataFrame:
    """Mutations (object_id, mutation) from one listing (object_id, parent, name, content_hash, state) to the next, when only some objects have
    reached the server: durable has their projected state (object_id, parent, name, content_hash).

    Objects whose identity is pending in cur are left alone, and those pending in prev count as absent there unless they look the same. A new
    object is a create, or, where it is durable, goes on from its projected state; a known one that isn't durable is created again if
    it looks different. What is gone is a delete if durable, else cancel. Changes are move (parent or name) and update (hash)."""
    cols = ["parent", "name", "content_hash"]
    side = lambda rows, k: rows.select("object_id", F.lit(True).alias(f"in_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in cols])
    p, q, c, d = (side(rows, k) for rows, k in ((prev.where("state <> 'pending'"), "p"), (prev.where("state = 'pending'"), "q"), (cur.where("state <> 'pending'"), "c"), (durable, "d")))
    rows = p.join(c, "object_id", "full").join(q, "object_id", "left").join(d, "object_id", "left")
    rows = rows.join(cur.where("state = 'pending'").select("object_id", F.lit(True).alias("waits")).distinct(), "object_id", "left").where("waits IS NULL OR in_c")
    differs = lambda k, some: ~F.forall(F.array(*[F.col(f"{x}_{k}").eqNullSafe(F.col(f"{x}_c")) for x in some]), lambda x: x)
    has = lambda k: F.col(f"in_{k}").isNotNull()
    rows = rows.where(~(has("c") & has("q") & ~differs("q", cols)))
    change = lambda k: F.array_compact(F.array(F.when(differs(k, cols[:2]), "move"), F.when(differs(k, cols[2:]), "update")))
    mutations = (
        F.when(~has("c"), F.array(F.when(has("d"), "delete").otherwise("cancel")))
        .when(has("d"), F.when(has("p"), change("p")).otherwise(change("d")))
        .when(~has("p"), F.array(F.lit("create")))
        .when(differs("p", cols), F.array(F.lit("create")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.select("object_id", F.explode(mutations).alias("mutation"))
