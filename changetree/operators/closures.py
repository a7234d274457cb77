"""Closures over dependencies and over trees that change: what belongs to a pending tree, and what has changed below a folder.

Rounds keep only pairs of ids; each writes its rows to the shared folder and deletes the table before it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import dropped, persisted
from . import places
from .content import name_problem
from .tree import ancestor_paths

OPEN = ["pending", "attempted", "replay_mismatch", "conflict"]


def new_id(*parts: Column) -> Column:
    """An id made of a hash, so that a repeated run makes the same one; 32 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 32)


def to_roots(pointers: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root, steps) for each row of pointers (id, up) from which a root (id) is reached; a root reaches itself in 0 steps.

    Pointer doubling: each round takes every pointer over as many steps as it has made so far, so a chain of n takes log2(n)
    rounds. Rows that point nowhere are left out, and those in a circle, which are still open when 2**rounds passes
    the number of rows."""
    own = roots.select("id").distinct()
    ended = own.select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("steps"))
    open_ = persisted(pointers.where("up IS NOT NULL").join(own, "id", "left_anti").select("id", "up", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")))
    n, reach = open_.count(), 1
    while reach <= 2 * (n + 1) and not open_.where("NOT done").isEmpty():
        going = open_.where("NOT done").drop("done")
        # what has ended is written once; only what still goes on is written again
        step = ended.withColumn("done", F.lit(True)).unionByName(going.withColumn("done", F.lit(False)))
        step = step.select(F.col("id").alias("up"), F.col("up").alias("then"), F.col("steps").alias("more"), "done")
        open_ = persisted(going.join(step, "up").select("id", F.col("then").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "done"))
        ended = ended.unionByName(open_.where("done").drop("done"))
        reach *= 2
    return ended.select("id", F.col("up").alias("root"), "steps")


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _flat(ops: DataFrame, *more: str) -> DataFrame:
    """Operations as narrow rows: what a rule needs of an operation alone is worked out before anything is shuffled."""
    note, create, folder = F.col("type") == "note", F.col("kind") == "create", F.col("type") == "folder"
    first = F.when(_no(F.col("kind").isin("create", "update")) | _no(F.col("type").isin("note", "folder")) | (F.col("kind").eqNullSafe("update") & ~note), "kind").when(_no(F.col("status") == "pending") | F.coalesce("attempted", F.lit(False)), "sent")
    named = create & (F.col("name").isNull() | name_problem(F.col("name")).isNotNull())
    return ops.select("operation_id", "object_id", F.when(create, F.col("parent_id")).alias("parent_id"), create.alias("is_create"), note.alias("is_note"), folder.alias("is_folder"), first.alias("first"), named.alias("bad_name"), (note == F.col("blob_hash").isNull()).alias("bad_hash"), *more)


def _own_problem() -> Column:
    """The problem of an operation as _flat has it with what it waits for: whether that is the root (on_root), of which kind (n_folder, n_note) and of which
    object, that of the parent (of_parent) or the same."""
    on_root, is_create = F.coalesce("on_root", F.lit(False)), F.col("is_create")
    return (
        F.when(F.col("first").isNotNull(), F.col("first"))
        .when(is_create & _no(on_root | F.col("n_folder")), "branch")
        .when(is_create & _no(F.col("of_parent")), "parent")
        .when(F.col("bad_name"), "name")
        .when(~is_create & (on_root | _no(F.col("same_object")) | _no(F.col("n_note"))), "chain")
        .when(F.col("bad_hash"), "hash")
    )


def chain_verdicts(ops: DataFrame, deps: DataFrame, roots: DataFrame, baselines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdicts of linear_chain_check with each root's root_object, and (root_operation, operation_id, steps) of what lies below the roots.

    Operations are judged by narrow rows. Rules on an object's history take one aggregation by object, whose findings go to its root and not back to its operations."""
    edges = deps.where("operation_id IS NOT NULL AND needs IS NOT NULL").select("operation_id", "needs")
    needed = persisted(edges.groupBy("operation_id").agg(F.min("needs").alias("needs"), F.max("needs").alias("most")))
    single, multi = needed.where("needs = most").drop("most"), needed.where("needs <> most").select("operation_id")
    reached = to_roots(single.select(F.col("operation_id").alias("id"), F.col("needs").alias("up")), roots.select(F.col("operation_id").alias("id")))
    reached = reached.select(F.col("id").alias("operation_id"), F.col("root").alias("root_operation"), "steps")
    note, create, folder = F.col("type") == "note", F.col("kind") == "create", F.col("type") == "folder"
    flat = _flat(ops)
    base = ops.select(F.col("operation_id").alias("needs"), F.col("object_id").alias("n_object"), (create & folder).alias("n_folder"), note.alias("n_note"))
    is_root = roots.select(F.col("operation_id").alias("needs"), F.lit(True).alias("on_root"), F.col("object_id").alias("r_object"))
    rows = single.join(flat, "operation_id").join(base, "needs", "left").join(is_root, "needs", "left")
    rows = rows.withColumns({"of_parent": F.col("parent_id") == F.coalesce("r_object", "n_object"), "same_object": F.col("n_object") == F.col("object_id")})
    on_root, is_create = F.coalesce("on_root", F.lit(False)), F.col("is_create")
    alone = rows.select("operation_id", "object_id", "is_create", "is_note", (on_root & is_create & F.col("is_folder")).alias("nested"), _own_problem().alias("own"))
    several = edges.join(multi, "operation_id").distinct()
    followers = single.select("needs").unionByName(several.select("needs")).groupBy(F.col("needs").alias("operation_id")).agg(F.count(F.lit(1)).alias("n_followers")).where("n_followers > 1")
    below = reached.where("steps > 0")
    problem = F.coalesce("own", F.when(F.col("is_note") & F.col("n_followers").isNotNull(), "branch"))
    judged = persisted(below.join(alone, "operation_id").join(followers, "operation_id", "left").select("root_operation", "object_id", "is_create", "nested", problem.alias("problem")))
    # an object's history, inside the trees and over all operations
    inside = judged.select("object_id", "root_operation", "is_create", F.col("problem").isNull().alias("clean"))
    every = ops.select("object_id", F.lit(None).cast(judged.schema["root_operation"].dataType).alias("root_operation"), F.lit(None).cast("boolean").alias("is_create"), F.lit(None).cast("boolean").alias("clean"))
    in_tree = F.col("root_operation").isNotNull()
    history = inside.unionByName(every).where("object_id IS NOT NULL").groupBy("object_id").agg(
        F.count(F.when(~in_tree, 1)).alias("n_all"), F.count(F.when(in_tree, 1)).alias("n_in"), F.count(F.when(F.col("is_create"), 1)).alias("n_creates"),
        F.min("root_operation").alias("least_root"), F.max("root_operation").alias("root_operation"), F.max("clean").alias("clean"),
    )
    history = history.where("n_in > 0 AND clean").join(baselines.select("object_id", F.lit(True).alias("settled")).distinct(), "object_id", "left")
    shared = F.col("least_root") != F.col("root_operation")
    found = F.when((F.col("n_creates") != 1) | shared, "repeated_object").when(F.col("n_all") != F.col("n_in"), "outside_history").when(F.col("settled").isNotNull(), "baseline")
    found = persisted(history.select("object_id", "root_operation", shared.alias("shared"), found.alias("problem")).where("problem IS NOT NULL"))
    of_shared = inside.where("clean").join(found.where("shared").select("object_id", "problem"), "object_id").select("root_operation", "problem")
    problems = judged.select("root_operation", "problem").where("problem IS NOT NULL").unionByName(found.where("NOT shared").select("root_operation", "problem")).unionByName(of_shared)
    problems = problems.unionByName(several.join(reached.select(F.col("operation_id").alias("needs"), "root_operation"), "needs").select("root_operation", F.lit("several_dependencies").alias("problem")))
    nested = judged.where("nested").select("root_operation", F.lit(None).cast("string").alias("problem"), F.lit(True).alias("nested"))
    sums = problems.withColumn("nested", F.lit(False)).unionByName(nested).groupBy("root_operation").agg(F.min("problem").alias("found"), F.max("nested").alias("nested"))
    verdicts = roots.select(F.col("operation_id").alias("root_operation"), F.col("object_id").alias("root_object")).distinct().join(sums, "root_operation", "left")
    return persisted(verdicts.select("root_operation", "root_object", F.coalesce("found", F.when(_no(F.col("nested")), "not_nested")).alias("problem"))), below


def chain_members(ops: DataFrame, verdicts: DataFrame, below: DataFrame) -> DataFrame:
    """From chain_verdicts, the members of linear_chain_check without path and depth, with root_object: one row for each object."""
    good = below.join(verdicts.where("problem IS NULL").select("root_operation", "root_object"), "root_operation").join(ops.select("operation_id", "object_id", "kind", "type", "parent_id", "name", "blob_hash"), "operation_id")
    made = F.max(F.when(F.col("kind") == "create", F.struct("type", "parent_id", "name", "operation_id", "root_object")))
    whole = good.groupBy("root_operation", "object_id").agg(made.alias("c"), F.max_by("blob_hash", "steps").alias("final_hash"), (F.count(F.lit(1)) - 1).alias("n_updates"))
    return whole.select("root_operation", "object_id", "c.type", "c.parent_id", "c.name", F.col("c.operation_id").alias("create_operation"), "final_hash", "n_updates", "c.root_object")


OP, DEP, ROOT, SETTLED = range(4)
HISTORY = pa.array([None, "repeated_object", "outside_history", "baseline"])
#: In order: of several problems the least is told.
PROBLEMS = ["baseline", "branch", "chain", "hash", "kind", "name", "outside_history", "parent", "repeated_object", "sent", "several_dependencies"]


def _tree_facts(rows: pa.Table) -> pa.Table:
    """What lies below the roots of whole places, with what each operation waits for and its object's history; a row for each root, and one for each
    operation of a tree that something with several dependencies waits for."""
    tag = rows["tag"].to_numpy()
    ops, deps, roots, settled = (rows.filter(pa.array(tag == k)) for k in (OP, DEP, ROOT, SETTLED))
    (own, low, high, tops), ids = places.codes(ops["operation_id"], deps["operation_id"], deps["needs"], roots["operation_id"])
    n = len(ids)
    low, high = np.divmod(np.unique(low * n + high), n) if n else (low, high)
    needs, followers = np.bincount(low, minlength=n), np.bincount(high, minlength=n)
    single = needs[low] == 1
    above, root_at, op_at = np.arange(n), np.full(n, -1), np.full(n + 1, -1)  # the last is of operations without an id
    above[low[single]], root_at[tops[tops >= 0]], op_at[own] = high[single], np.flatnonzero(tops >= 0), np.arange(len(own))
    op_at, is_root = op_at[:n], root_at >= 0
    up = np.where(is_root, np.arange(n), above)
    steps = (up != np.arange(n)).astype(np.int64)
    for _ in range(n.bit_length() + 1):  # pointer doubling
        steps, up = steps + steps[up], up[up]
    reached = is_root[up] & (steps > 0) if n else is_root
    flag = lambda c: ops[c].fill_null(False).to_numpy()
    create, note, folder, below = flag("is_create"), flag("is_note"), flag("is_folder"), (own >= 0) & np.append(reached, False)[own]
    (obj, parent, of_root, known), objects = places.codes(ops["object_id"], ops["parent_id"], roots["object_id"], settled["object_id"])
    m, inside = len(objects), below & (obj >= 0)
    n_in, n_all, n_creates = (np.bincount(obj[x], minlength=m) for x in (inside, obj >= 0, inside & create))
    shared = np.bincount(np.unique(obj[inside] * n + up[own[inside]]) // max(n, 1), minlength=m) > 1
    history = np.select([(n_creates != 1) | shared, n_all != n_in, np.isin(np.arange(m), known)], [1, 2, 3], 0)
    at = np.flatnonzero(below)
    o = own[at]
    to = above[o]
    # an operation that nothing tells of is neither folder nor note and of no object
    is_ = lambda f: np.append(f, False)[op_at[to]]
    n_object, r_object = np.append(obj, -1)[op_at[to]], np.append(of_root, -1)[root_at[to]]
    same = lambda a, b: (a == b) & (a >= 0)
    facts = {
        "on_root": is_root[to], "n_folder": is_(create & folder), "n_note": is_(note), "of_parent": same(parent[at], np.where(r_object >= 0, r_object, n_object)), "same_object": same(obj[at], n_object),
        "branched": followers[o] > 1, "steps": steps[o],
    }
    judged = ops.take(pa.array(at)).drop_columns(["tag", "place", "needs"]).append_column("root_operation", places.taken(ids, up[o])).append_column("needs", places.taken(ids, to))
    judged = judged.append_column("history", HISTORY.take(pa.array(np.append(history, 0)[obj[at]])))
    for name, values in facts.items():
        judged = judged.append_column(name, pa.array(values))
    several = high[(needs[low] > 1) & (reached | is_root)[high]]
    several = pa.table({"root_operation": places.taken(ids, up[several]), "several": pa.array(np.ones(len(several), bool))})
    return pa.concat_tables([judged, several, pa.table({"root_operation": roots["operation_id"], "root_object": roots["object_id"]})], promote_options="default")


def _judged(ops: DataFrame, deps: DataFrame, roots: DataFrame, baselines: DataFrame, place: Callable[[Column], Column], n_tasks: int, more: tuple[str, ...]) -> DataFrame:
    """The rows of _tree_facts with `nested` and `least`, the number of the problem, where no row refers from one place to another: one exchange of narrow rows."""
    flat = _flat(ops, *more)
    rows = flat.select(places.place_of(place, "operation_id", "object_id"), F.lit(OP).cast("byte").alias("tag"), "*")
    others = [
        deps.where("operation_id IS NOT NULL AND needs IS NOT NULL").select(places.place_of(place, "operation_id"), F.lit(DEP).cast("byte").alias("tag"), "operation_id", "needs"),
        roots.select(places.place_of(place, "operation_id"), F.lit(ROOT).cast("byte").alias("tag"), "operation_id", "object_id"),
        baselines.where("object_id IS NOT NULL").select(places.place_of(place, "object_id"), F.lit(SETTLED).cast("byte").alias("tag"), "object_id"),
    ]
    for x in others:
        rows = rows.unionByName(x, allowMissingColumns=True)
    types = {f.name: f.dataType.simpleString() for f in flat.schema}
    types |= {"root_operation": types["operation_id"], "needs": types["operation_id"], "root_object": types["object_id"], "history": "string", "steps": "long"} | dict.fromkeys(("on_root", "n_folder", "n_note", "of_parent", "same_object", "branched", "several"), "boolean")
    judge = ["root_operation", "root_object", "is_create", "is_note", "is_folder", "first", "bad_name", "bad_hash", "on_root", "n_folder", "n_note", "of_parent", "same_object", "branched", "history", "several"]
    kept = [*judge, "operation_id", "object_id", "parent_id", "needs", "steps", *more] if more else judge

    def of(table: pa.Table) -> pa.Table:
        return _tree_facts(table).select(kept)

    facts = places.by_place(rows, n_tasks, of, ", ".join(f"`{c}` {types[c]}" for c in kept))
    problem = F.coalesce(_own_problem(), F.when(F.col("is_note") & F.col("branched"), "branch"), F.col("history"))
    problem = F.when(F.col("several"), "several_dependencies").when(F.col("on_root").isNotNull(), problem)
    return facts.select("root_operation", "root_object", *(c for c in kept if c not in judge), "is_create", F.array_position(F.array(*map(F.lit, PROBLEMS)), problem).cast("int").alias("least"), (F.col("on_root") & F.col("is_create") & F.col("is_folder")).alias("nested"))


def _verdict() -> Column:
    # element_at counts as never null here, so a missing number is asked for first
    return F.when(F.col("least").isNotNull(), F.element_at(F.array(*map(F.lit, PROBLEMS)), F.col("least"))).when(_no(F.col("nested")), "not_nested").alias("problem")


def pending_trees(ops: DataFrame, deps: DataFrame, roots: DataFrame, baselines: DataFrame, place: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, members) as chain_verdicts and chain_members give them, members with parent_create, the create that a create waits for.

    place is a function of an id, of operations and objects alike. Where dependencies and objects stay within their places, rows are dealt by place
    once; what crosses, and places too large for that, take the joins of chain_verdicts. The results are the same for every function."""
    of_op, of_object = places.place_of(place, "operation_id", "object_id"), places.place_of(place, "object_id", "operation_id")
    links = ops.select(of_op.alias("a"), of_object.alias("b")), deps.where("operation_id IS NOT NULL AND needs IS NOT NULL").select(places.place_of(place, "operation_id").alias("a"), places.place_of(place, "needs").alias("b"))
    of_id, of_settled = places.place_of(place, "operation_id"), places.place_of(place, "object_id")
    buckets, n_tasks = places.open_buckets(*links, roots.select(of_id.alias("a"), of_id.alias("b")), baselines.select(of_settled.alias("a"), of_settled.alias("b")))
    parts = [places.split(df, c, buckets) for df, c in ((ops, of_op), (deps, of_id), (roots, of_id), (baselines, of_settled))]
    near, far = zip(*parts)
    verdicts = _judged(*near, place, n_tasks, ()).groupBy("root_operation").agg(F.max("root_object").alias("root_object"), F.min("least").alias("least"), F.max("nested").alias("nested"))
    verdicts = verdicts.select("root_operation", "root_object", _verdict())
    # a root's rows come to one task, in which its objects and then its verdict are made
    rows = places.dealt(_judged(*near, place, n_tasks, ("type", "name", "blob_hash")), "root_operation", n_tasks)
    made = F.max(F.when(F.col("is_create"), F.struct("type", "parent_id", "name", F.col("operation_id").alias("create_operation"), F.col("needs").alias("parent_create"))))
    whole = rows.groupBy("root_operation", "object_id").agg(
        made.alias("c"), F.max_by("blob_hash", "steps").alias("final_hash"), (F.count(F.lit(1)) - 1).alias("n_updates"), F.max("root_object").alias("root_object"), F.min("least").alias("least"), F.max("nested").alias("nested")
    )
    root = W.partitionBy("root_operation")
    whole = whole.withColumns({"least": F.min("least").over(root), "nested": F.max("nested").over(root), "root_object": F.max("root_object").over(root)}).where(F.col("c").isNotNull() & _verdict().isNull())
    members = whole.select("root_operation", "object_id", "c.type", "c.parent_id", "c.name", "c.create_operation", "final_hash", "n_updates", "root_object", F.when(F.col("c.parent_create") != F.col("root_operation"), F.col("c.parent_create")).alias("parent_create"))
    if buckets is not None:
        far_verdicts, below = chain_verdicts(*far)
        verdicts = verdicts.unionByName(far_verdicts)
        members = members.unionByName(with_parents(persisted(chain_members(far[0], far_verdicts, below))))
    return verdicts, members


def with_parents(members: DataFrame) -> DataFrame:
    """members with parent_create, the create of the parent."""
    above = members.select("root_operation", F.col("object_id").alias("parent_id"), F.col("create_operation").alias("parent_create"))
    return members.join(above, ["root_operation", "parent_id"], "left").select(*members.columns, "parent_create")


def linear_chain_check(ops: DataFrame, deps: DataFrame, roots: DataFrame, baselines: DataFrame, place: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Whether what waits below an operation is a tree of creates with at most a chain of updates behind each note, never sent
    and without other history. Returns (verdicts, members).

    ops are (operation_id, object_id, kind, type, status, attempted, parent_id, name, blob_hash), deps (operation_id, needs), roots (operation_id, object_id),
    baselines (object_id). verdicts has (root_operation, problem) for each root: null, `not_nested` where no folder's create hangs on the
    root directly, or the least of the problems found. members of the roots without a problem are (root_operation, object_id, type, parent_id, name, path,
    depth, create_operation, final_hash, n_updates); path and depth count from below the root. place is as in pending_trees."""
    if place:
        verdicts, members = pending_trees(ops, deps, roots, baselines, place)
    else:
        verdicts, below = chain_verdicts(ops, deps, roots, baselines)
        members = chain_members(ops, verdicts, below)
    members = persisted(members)
    paths = ancestor_paths(members.select("object_id", F.when(F.col("parent_id") != F.col("root_object"), F.col("parent_id")).alias("parent_id"), "name"))
    out = members.join(paths.select("object_id", "path", "depth"), "object_id")
    return verdicts.select("root_operation", "problem"), out.select("root_operation", "object_id", "type", "parent_id", "name", "path", "depth", "create_operation", "final_hash", "n_updates")


def reroot_pending_tree(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The creates that put the members of linear_chain_check under new roots: (root_operation, operation_id, object_id, type, parent_id, name, blob_hash,
    depends_on), the root's own among them. roots are (root_operation, new_object, parent_id, name). Members keep their ids; a
    note keeps its last hash only; each create waits for its parent's. New operations are named by a hash, after the joins. Members of
    chain_members do as well, whose root_object tells what is on top, and those of pending_trees, which know their parents' creates."""
    r = roots.select("root_operation", "new_object", F.col("parent_id").alias("root_parent"), F.col("name").alias("root_name"))
    top = F.col("parent_id") == F.col("root_object") if "root_object" in members.columns else F.col("depth") == 1
    m = members if "parent_create" in members.columns else with_parents(members)
    rows = m.select("root_operation", "object_id", "type", "parent_id", "name", "final_hash", "create_operation", "parent_create", top.alias("top")).join(r, "root_operation")
    none = F.lit(None).cast("string")
    root_create = new_id(F.lit("root"), F.col("root_operation"))
    waits_for = F.when(F.col("top"), root_create).when(F.col("parent_create").isNotNull(), new_id(F.col("root_operation"), F.col("parent_create")))
    above = F.when(F.col("top"), F.col("new_object")).otherwise(F.col("parent_id"))
    own = [new_id(F.col("root_operation"), F.col("create_operation")), F.col("object_id"), F.col("type"), above, F.col("name"), F.col("final_hash"), waits_for]
    roots_own = [root_create, F.col("new_object"), F.lit("folder"), F.col("root_parent"), F.col("root_name"), none, none]
    row = lambda values: F.struct(*(v.alias(c) for v, c in zip(values, ("operation_id", "object_id", "type", "parent_id", "name", "blob_hash", "depends_on"))))
    # the root's own create goes with the first of its members, which the join has brought to one task
    first = F.row_number().over(W.partitionBy("root_operation", "new_object", "root_parent", "root_name").orderBy("object_id")) == 1
    rows = rows.withColumn("first", first)
    return rows.select("root_operation", F.inline(F.when(F.col("first"), F.array(row(roots_own), row(own))).otherwise(F.array(row(own)))))


MEMBER, REQUEST, KNOWN, OPEN_OP = range(4)


def _split_facts(rows: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    """The verdicts, creates and superseded operations of split_subtree_plan for whole places, creates as _copied takes them."""
    tag = rows["tag"].to_numpy()
    members, requests, known, busy = (rows.filter(pa.array(tag == k)) for k in (MEMBER, REQUEST, KNOWN, OPEN_OP))
    (root, asked), roots = places.codes(members["root"], requests["root"])
    (obj, parent, has_base, has_op), objects = places.codes(members["object_id"], members["parent_id"], known["object_id"], busy["object_id"])
    n, m = len(roots), len(objects)
    among = lambda x: np.isin(obj, x[x >= 0])
    is_known = among(has_base)
    some, open_ = (np.append(np.bincount(root[(root >= 0) & x], minlength=n) > 0, False)[asked] for x in (is_known, is_known & among(has_op)))
    problem = pa.array(["open_intent", "nothing_known", None]).take(pa.array(np.select([open_, ~some], [0, 1], 2)))
    verdicts = pa.table({"operation_id": requests["operation_id"], "problem": problem})
    # a parent is a member of the same root
    key = lambda x: np.where((root >= 0) & (x >= 0), root * max(m, 1) + x, -1)
    order = np.argsort(key(obj), kind="stable")
    at = np.searchsorted(key(obj)[order], key(parent))
    of = np.append(order, -1)[at]
    there = (of >= 0) & (key(parent) >= 0) & (np.append(key(obj), -2)[of] == key(parent))
    # members of each good request
    good = np.flatnonzero(some & ~open_)
    order = np.argsort(root, kind="stable")
    first, last = (np.searchsorted(root[order], asked[good], side=x) for x in ("left", "right"))
    each = pairs(first, last)
    who, request = order[each[1]], good[each[0]]
    creates = members.select(["root", "object_id", "parent_id", "type", "name", "blob_hash"]).take(pa.array(who))
    creates = creates.append_column("operation_id", requests["operation_id"].take(pa.array(request))).append_column("new_root", requests["new_root"].take(pa.array(request)))
    creates = creates.append_column("known", pa.array(is_known[who])).append_column("parent_known", pa.array(np.append(is_known, False)[of[who]], mask=~there[who]))
    local = np.flatnonzero(~is_known[who] & (obj[who] >= 0))
    order = np.argsort(has_op, kind="stable")
    first, last = (np.searchsorted(has_op[order], obj[who[local]], side=x) for x in ("left", "right"))
    each = pairs(first, last)
    superseded = pa.table({"operation_id": creates["operation_id"].take(pa.array(local[each[0]])), "old_operation": busy["old_operation"].take(pa.array(order[each[1]]))})
    return verdicts, creates, superseded


def pairs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, i) for each range k and each i from first[k] up to last[k]."""
    n = last - first
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[k]


def _copied(rows: DataFrame) -> DataFrame:
    """creates of split_subtree_plan. Ids are hashed after the joins, for which a parent's flag is enough."""
    top, there = F.col("parent_id") == F.col("root"), F.col("parent_known").isNotNull()
    copy = lambda known, c: F.when(F.col(known), new_id(F.lit("copy"), F.col("operation_id"), F.col(c))).otherwise(F.col(c))
    made = lambda c: new_id(F.lit("create"), F.col("operation_id"), F.col(c))
    return rows.select(
        "operation_id", made("object_id").alias("new_operation"), F.col("object_id").alias("source_id"), copy("known", "object_id").alias("object_id"), F.when(top, F.col("new_root")).when(there, copy("parent_known", "parent_id")).alias("parent_id"),
        "type", "name", "blob_hash", F.when(top, new_id(F.lit("root"), F.col("operation_id"))).when(there, made("parent_id")).alias("depends_on"),
    )


def _split_by_joins(members: DataFrame, requests: DataFrame, baselines: DataFrame, outbox: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = members.join(requests, "root").join(baselines.select("object_id", F.lit(True).alias("known")).distinct(), "object_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    m = persisted(m)
    open_ops = outbox.where(F.col("status").isin(*OPEN)).select("object_id", F.col("operation_id").alias("old_operation"))
    busy = m.where("known").join(open_ops.select("object_id").distinct(), "object_id", "left_semi").select("operation_id", F.lit(True).alias("busy")).distinct()
    some = m.where("known").select("operation_id", F.lit(True).alias("some")).distinct()
    verdicts = requests.select("operation_id").distinct().join(busy, "operation_id", "left").join(some, "operation_id", "left")
    verdicts = verdicts.select("operation_id", F.when(F.col("busy"), "open_intent").when(F.col("some").isNull(), "nothing_known").alias("problem"))
    good = m.join(verdicts.where("problem IS NULL").select("operation_id"), "operation_id", "left_semi")
    above = m.select("operation_id", F.col("object_id").alias("parent_id"), F.col("known").alias("parent_known"))
    joined = good.join(above, ["operation_id", "parent_id"], "left")
    superseded = good.where("NOT known").join(open_ops, "object_id").select("operation_id", "old_operation")
    return verdicts, _copied(joined), superseded


def split_subtree_plan(members: DataFrame, requests: DataFrame, baselines: DataFrame, outbox: DataFrame, place: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder that two sides moved to two places: the confirmed side keeps its ids, the other becomes a copy. Returns (verdicts, creates,
    superseded).

    members are what lies below each root (root, object_id, parent_id, type, name, blob_hash), requests (operation_id, root, new_root),
    baselines (object_id), outbox (operation_id, object_id, status). verdicts has (operation_id, problem): null, `open_intent` where a known
    member, one with a baseline, has an operation that isn't settled, or `nothing_known`, for which reroot_pending_tree is
    right. creates (operation_id, new_operation, source_id, object_id, parent_id, type, name, blob_hash, depends_on) give known members a new id
    and let purely local ones keep theirs; parents are the new ones, and each waits for its parent's create, those directly
    below the root for the root's. superseded (operation_id, old_operation) are the local members' open operations. place is a function of the ids of
    roots and objects, as in pending_trees; a request has an operation of its own."""
    if not place:
        return _split_by_joins(members, requests, baselines, outbox)
    of_root, of_object = places.place_of(place, "root", "object_id"), places.place_of(place, "object_id", "root")
    of_request, of_id = places.place_of(place, "root"), places.place_of(place, "object_id")
    open_ops = outbox.where(F.col("status").isin(*OPEN))
    links = [df.select(a.alias("a"), b.alias("b")) for df, a, b in ((members, of_root, of_object), (requests, of_request, of_request), (baselines, of_id, of_id), (open_ops, of_id, of_id))]
    buckets, n_tasks = places.open_buckets(*links)
    parts = [places.split(df, c, buckets) for df, c in ((members, of_root), (requests, of_request), (baselines, of_id), (open_ops, of_id))]
    near, far = zip(*parts)
    dealt = [
        near[0].select(of_root, F.lit(MEMBER).cast("byte").alias("tag"), "root", "object_id", "parent_id", "type", "name", "blob_hash"),
        near[1].select(of_request, F.lit(REQUEST).cast("byte").alias("tag"), "operation_id", "root", "new_root"),
        near[2].where("object_id IS NOT NULL").select(of_id, F.lit(KNOWN).cast("byte").alias("tag"), "object_id"),
        near[3].where("object_id IS NOT NULL").select(of_id, F.lit(OPEN_OP).cast("byte").alias("tag"), "object_id", F.col("operation_id").alias("old_operation")),
    ]
    rows = dealt[0]
    for x in dealt[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    types = {f.name: f.dataType.simpleString() for f in rows.schema} | {"problem": "string", "known": "boolean", "parent_known": "boolean"}
    columns = [["operation_id", "problem"], ["operation_id", "root", "new_root", "object_id", "parent_id", "type", "name", "blob_hash", "known", "parent_known"], ["operation_id", "old_operation"]]
    made = [places.by_place(rows, n_tasks, lambda t, k=k: _split_facts(t)[k].select(columns[k]), ", ".join(f"`{c}` {types[c]}" for c in columns[k])) for k in range(3)]
    made[1] = _copied(made[1])
    if buckets is not None:
        made = [a.unionByName(b) for a, b in zip(made, _split_by_joins(*far))]
    return tuple(made)


def newest_below(nodes: DataFrame) -> DataFrame:
    """(tenant, object_id, newest) for each of nodes (tenant, object_id, parent_id, newest): the greatest newest of it and of all below it.

    Pointer doubling: in each round a node hands what it has gathered to the one as many steps above it as it has gathered levels, so a tree of n levels
    takes log2(n) rounds of one row a node. A greatest value may arrive twice, so circles do no harm; they end when the steps pass the number of nodes."""
    now = persisted(nodes.select("tenant", "object_id", F.col("parent_id").alias("up"), "newest"))
    n, reach = now.count(), 1
    while reach <= n and not now.where("up IS NOT NULL").isEmpty():
        step = now.select("tenant", F.col("object_id").alias("up"), F.col("up").alias("then"))
        given = now.where("up IS NOT NULL").groupBy("tenant", F.col("up").alias("object_id")).agg(F.max("newest").alias("given"))
        moved = now.join(step, ["tenant", "up"], "left").join(given, ["tenant", "object_id"], "left")
        last, now = now, persisted(moved.select("tenant", "object_id", F.col("then").alias("up"), F.greatest("newest", "given").alias("newest")))
        dropped(last)
        reach *= 2
    return now.select("tenant", "object_id", "newest")


def subtree_changed_since(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each of requests (request_id, tenant, root, cursor) whether anything below the root has `changed` after the cursor: what was there at the
    cursor, what is there now, and what a version after the cursor put below either of them, in any number of steps.

    versions are (tenant, cursor, object_id, parent_id, deleted), one row for each entry of the log. A version holds from its
    cursor to the object's next.

    No request walks its tree. A root with a version after the cursor has changed if it was there then or is there now. Any other is the same
    then and now, and nothing below it has changed if nothing in its present tree has: no object of that tree has a later version, none was put
    below one of them later, and no version below one of them ended later, for then the trees of then and now are one. Each of these is a
    greatest cursor over the present tree, which newest_below finds for all objects at once."""
    by_object = W.partitionBy("tenant", "object_id").orderBy("cursor")
    held = persisted(versions.select("tenant", "object_id", "parent_id", "deleted", F.col("cursor").alias("from"), F.lead("cursor").over(by_object).alias("to")))
    present = held.where("to IS NULL").select("tenant", "object_id", "parent_id", F.col("from").alias("last"), F.coalesce(~F.col("deleted"), F.lit(False)).alias("is_now"))
    ended = F.max(F.when(~F.col("deleted"), F.col("to")))
    below = held.where("parent_id IS NOT NULL").groupBy("tenant", F.col("parent_id").alias("object_id")).agg(F.greatest(F.max("from"), ended).alias("below"))
    nodes = present.where("is_now").join(below, ["tenant", "object_id"], "left").select("tenant", "object_id", "parent_id", F.greatest("last", "below").alias("newest"))
    newest = newest_below(nodes)
    # whether the root was there: the last version up to the cursor, found in one sort of versions and requests
    asked = requests.select("request_id", "tenant", F.col("root").alias("object_id"), F.col("cursor").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("boolean").alias("alive"))
    rows = held.select(F.lit(None).cast(asked.schema["request_id"].dataType).alias("request_id"), "tenant", "object_id", F.col("from").alias("at"), F.lit(0).alias("asks"), F.coalesce(~F.col("deleted"), F.lit(False)).alias("alive"))
    so_far = W.partitionBy("tenant", "object_id").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.unionByName(asked).withColumn("was", F.last("alive", ignorenulls=True).over(so_far)).where("asks = 1")
    rows = rows.join(present.drop("parent_id"), ["tenant", "object_id"], "left").join(newest, ["tenant", "object_id"], "left")
    no = F.lit(False)
    changed = F.when(F.col("last") > F.col("at"), F.coalesce("was", no) | F.col("is_now")).otherwise(F.col("is_now") & (F.col("newest") > F.col("at")))
    return rows.select("request_id", "tenant", F.col("object_id").alias("root"), F.col("at").alias("cursor"), F.coalesce(changed, no).alias("changed"))
