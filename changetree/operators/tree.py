"""Operators over trees given by parent pointers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import collision_key
from ..sources.tables import persisted

#: Levels beyond which a path is too deep; pointer doubling takes the logarithm of it in rounds.
MOST_LEVELS = 256


def ancestor_paths(objects: DataFrame, path: str = "name") -> DataFrame:
    """objects (object_id, parent_id, name) as object_id, depth, path, ancestors (nearest first) and status: ok, orphan
    (an ancestor isn't there), cycle or too_deep; path, depth and ancestors are null unless ok.

    Pointer doubling: each round joins every object's known ancestors with those of the last of them, so
    a depth of 256 takes nine rounds. Objects whose chain ended leave the joins. Rounds are over objects with something below them; then every object
    takes what its parent has, in one join. The result is a persisted table; objects are read several times."""
    ids = objects.select("object_id", "parent_id", F.col(path).alias("name"))
    inner = ids.join(ids.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("object_id")).distinct(), "object_id", "left_semi")
    open_ = persisted(inner.select("object_id", F.col("parent_id").alias("next"), F.array("name").alias("names"), F.array().cast(f"array<{ids.schema['object_id'].dataType.simpleString()}>").alias("ancestors")))
    done = []
    for _ in range(MOST_LEVELS.bit_length() + 1):
        done.append(open_.where("next IS NULL"))
        going = open_.where("next IS NOT NULL")
        steps = open_.select(F.col("object_id").alias("next"), F.col("next").alias("then"), F.col("names").alias("more"), F.col("ancestors").alias("above"))
        # what is done is needed as a step of others still
        steps = steps.unionByName(_all(done[:-1]).select(F.col("object_id").alias("next"), F.col("next").alias("then"), F.col("names").alias("more"), F.col("ancestors").alias("above"))) if len(done) > 1 else steps
        moved = persisted(going.join(steps, "next", "left").withColumn("found", F.col("more").isNotNull()))
        done.append((moved.where("NOT found").select("object_id", "next", F.lit(None).cast("array<string>").alias("names"), "ancestors")))
        open_ = moved.where("found").select("object_id", F.col("then").alias("next"), F.concat("more", "names").alias("names"), F.concat("ancestors", F.array("next"), "above").alias("ancestors"))
        if open_.isEmpty():
            break
    rest = open_.withColumn("status", F.when(F.size(F.array_distinct("ancestors")) < F.size("ancestors"), "cycle").otherwise("too_deep"))
    ended = _all(done).withColumn("status", F.when(F.col("names").isNull(), "orphan").when(F.size("names") > MOST_LEVELS, "too_deep").otherwise("ok"))
    above = ended.unionByName(rest).select(F.col("object_id").alias("parent_id"), F.col("names").alias("more"), F.col("ancestors").alias("above"), F.col("status").alias("parent_status"))
    under = ids.where("parent_id IS NOT NULL").join(above, "parent_id", "left")
    under = under.select("object_id", F.concat("more", F.array("name")).alias("names"), F.concat(F.array("parent_id"), "above").alias("ancestors"), F.coalesce("parent_status", F.lit("orphan")).alias("status"))
    roots = ids.where("parent_id IS NULL").select("object_id", F.array("name").alias("names"), F.array().cast(under.schema["ancestors"].dataType).alias("ancestors"), F.lit("ok").alias("status"))
    all_ = under.unionByName(roots).withColumn("status", F.when((F.col("status") == "ok") & (F.size("names") > MOST_LEVELS), "too_deep").otherwise(F.col("status")))
    ok = F.col("status") == "ok"
    return persisted(all_.select("object_id", F.when(ok, F.size("names").cast("long")).alias("depth"), F.when(ok, F.array_join("names", "/")).alias("path"), F.when(ok, F.col("ancestors")).alias("ancestors"), "status"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def subtree_sizes(paths: DataFrame) -> DataFrame:
    """Of ancestor_paths: each object with something below it, how much that is, and how deep it goes."""
    above = paths.where("status = 'ok'").select("depth", F.explode("ancestors").alias("object_id"))
    sizes = above.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_below"), F.max("depth").alias("deepest"))
    return sizes.join(paths.select("object_id", F.col("depth").alias("own")), "object_id").select("object_id", "n_below", (F.col("deepest") - F.col("own")).alias("levels_below"))


def subtree_members(paths: DataFrame, roots: DataFrame, most_levels: int = MOST_LEVELS, most_members: int = 10_000) -> DataFrame:
    """Of ancestor_paths, what lies at or below each root (root): root, object_id, level (0 is the root itself), and whether
    the subtree is too_large. Ancestor lists are exploded once for all roots."""
    chain = paths.where("status = 'ok'").select("object_id", F.posexplode(F.concat(F.array("object_id"), "ancestors")).alias("level", "root"))
    members = chain.join(roots.select("root").distinct(), "root")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("deepest"))
    large = sizes.select("root", ((F.col("n") > most_members) | (F.col("deepest") > most_levels)).alias("too_large"))
    return members.join(large, "root").select("root", "object_id", "level", "too_large")


def cycle_report(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (object_id, new_parent) that would make a cycle, as reason move, and objects that are in or below one already, as
    reason exists."""
    above = paths.select(F.col("object_id").alias("new_parent"), "ancestors")
    rows = moves.where("new_parent IS NOT NULL").join(above, "new_parent", "left")
    own = (F.col("new_parent") == F.col("object_id")) | F.coalesce(F.array_contains("ancestors", F.col("object_id")), F.lit(False))
    return rows.where(own).select("object_id", F.lit("move").alias("reason")).unionByName(paths.where("status = 'cycle'").select("object_id", F.lit("exists").alias("reason")))


def moved_path_check(paths: DataFrame, moves: DataFrame, most_bytes: int = 768, reserved: tuple[str, ...] = (), recovery: tuple[str, str] | None = None) -> DataFrame:
    """The new paths of moved objects (object_id, new_parent, new_name) and of all below them that are too_long or lie under a reserved
    root (compared by collision key): moved, object_id, new_path, problem. What moves directly or deeper into the folder that
    recovery names, by its root and its own name, need only be short enough; what lies below a folder moved there is held to
    the plain rule."""
    ok = paths.where("status = 'ok'")
    names = [unicodedata.normalize("NFC", r.casefold()) for r in reserved]
    barred = lambda c: collision_key(F.substring_index(c, "/", 1)).isin(*names) if names else F.lit(False)
    # parents and moved objects are looked up in one join; of the moves those stay that can have a problem, by the longest path of all
    asked = moves.select(F.explode(F.array("object_id", "new_parent")).alias("object_id")).where("object_id IS NOT NULL").distinct()
    known = persisted(ok.select("object_id", "path").join(asked, "object_id", "left_semi"))
    parents = known.select(F.col("object_id").alias("new_parent"), F.col("path").alias("parent_path"))
    at = moves.join(parents, "new_parent", "left").where("new_parent IS NULL OR parent_path IS NOT NULL").join(known, "object_id")
    at = at.select(F.col("object_id").alias("moved"), F.concat_ws("/", "parent_path", "new_name").alias("start"), F.length("path").alias("cut"), F.octet_length("path").alias("cut_bytes"))
    longest = ok.agg(F.max(F.octet_length("path"))).first()[0] or 0
    at = persisted(at.where((F.octet_length("start") - F.col("cut_bytes") + longest > most_bytes) | barred("start") | (F.col("cut") == 0)).drop("cut_bytes"))
    rows = ok.select("object_id", "path", F.explode(F.concat(F.array("object_id"), "ancestors")).alias("moved")).join(at, "moved")
    rows = rows.withColumn("new_path", F.concat("start", F.expr("substring(path, cut + 1)")))
    root = barred("new_path")
    if recovery:
        root &= ~((F.col("moved") == F.col("object_id")) & F.col("new_path").startswith("/".join(recovery) + "/"))
    problem = F.when(F.octet_length("new_path") > most_bytes, "too_long").when(root, "reserved_root")
    return rows.select("moved", "object_id", "new_path", problem.alias("problem")).where("problem IS NOT NULL")


def subtree_signature(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """(object_id, signature) of each folder (objects: object_id, parent_id, name, type): equal where all names, kinds and note ids below are;
    empty for an empty folder. Levels are taken from the deepest up, each by one aggregation over its children."""
    rows = persisted(objects.join(paths.where("status = 'ok'").select("object_id", "depth"), "object_id").select("object_id", "parent_id", "name", "type", "depth"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    done, below = [], None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == depth)
        folders = here.where("type = 'folder'")
        signed = folders.join(below, "object_id", "left") if below is not None else folders.withColumn("signature", F.lit(None).cast("string"))
        signed = persisted(signed.withColumn("signature", F.coalesce("signature", F.lit(""))))
        done.append(signed.select("object_id", "signature"))
        entries = signed.select("parent_id", F.concat_ws(":", F.lit("d"), "name", "signature").alias("e"))
        entries = entries.unionByName(here.where("type = 'note'").select("parent_id", F.concat_ws(":", F.lit("f"), "name", "object_id").alias("e")))
        below = entries.groupBy(F.col("parent_id").alias("object_id")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), ","), 256).alias("signature"))
    return _all(done) if done else rows.select("object_id", F.lit("").alias("signature"))


def clone_subtree_plan(objects: DataFrame, paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The plan that keeps a subtree's notes and deletes the rest (roots: root, operation_id, first_cursor): folders are cloned parents first under new
    ids, notes move to the clone of their parent, the originals are deleted deepest first. One row a step: root, cursor, phase, object_id,
    target (the clone's id, or the note's new parent). Ids come from the operation, so a plan can be made again."""
    members = subtree_members(paths, roots).where("NOT too_large").join(objects.select("object_id", "parent_id", "type"), "object_id").join(roots, "root")
    clone = lambda c: F.substring(F.sha2(F.concat_ws(":", "operation_id", c), 256), 1, 32)
    folder = F.col("type") == "folder"
    steps = F.when(folder, F.array(F.struct(F.lit("clone").alias("phase"), F.col("level").alias("o")), F.struct(F.lit("delete").alias("phase"), (-F.col("level")).alias("o")))).otherwise(F.array(F.struct(F.lit("move").alias("phase"), F.col("level").alias("o"))))
    rows = members.withColumn("s", F.explode(steps)).withColumn("phase", F.col("s.phase"))
    order = F.when(F.col("phase") == "clone", 1).when(F.col("phase") == "move", 2).otherwise(3)
    place = F.row_number().over(W.partitionBy("root").orderBy(order, "s.o", "object_id"))
    target = F.when(F.col("phase") == "clone", clone("object_id")).when(F.col("phase") == "move", clone("parent_id"))
    return rows.select("root", (F.col("first_cursor") + place - 1).alias("cursor"), "phase", "object_id", target.alias("target"))


def manifest_audit(plan: DataFrame) -> DataFrame:
    """Plans (as clone_subtree_plan gives them) that aren't sound: root, problem: cursors (not dense), phases (out of order), clones (ids not one to one, or
    not as many deleted as cloned), moves (to no clone)."""
    clones = plan.where("phase = 'clone'").select(F.col("root").alias("c_root"), F.col("target").alias("t"), F.lit(1).alias("is_clone")).distinct()
    rows = plan.join(clones, (F.col("root") == F.col("c_root")) & (F.col("phase") == "move") & (F.col("target") == F.col("t")), "left")
    at = lambda phase, f, c: f(F.when(F.col("phase") == phase, F.col(c)))
    sums = rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cursor").alias("nc"), (F.max("cursor") - F.min("cursor") + 1).alias("span"),
        at("clone", F.max, "cursor").alias("c1"), at("move", F.min, "cursor").alias("m0"), at("move", F.max, "cursor").alias("m1"), at("delete", F.min, "cursor").alias("d0"),
        at("clone", F.count, "target").alias("n_clones"), at("clone", F.countDistinct, "target").alias("n_ids"), at("delete", F.count, "object_id").alias("n_deleted"),
        at("move", F.count, "object_id").alias("n_moves"), at("move", F.count, "is_clone").alias("n_placed"),
    )
    out = F.expr("c1 > coalesce(m0, d0) OR coalesce(m1, c1) > d0")
    problems = F.array_compact(F.array(
        F.when((F.col("n") != F.col("nc")) | (F.col("n") != F.col("span")), "cursors"), F.when(out, "phases"),
        F.when((F.col("n_clones") != F.col("n_ids")) | (F.col("n_clones") != F.col("n_deleted")), "clones"), F.when(F.col("n_moves") != F.col("n_placed"), "moves"),
    ))
    return sums.select("root", F.explode(problems).alias("problem"))
