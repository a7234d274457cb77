"""Pending trees, copies and changes below folders against golden rows and plain models."""

import random
from collections import defaultdict

from changetree.operators import closures as cl

OPS = "operation_id string, object_id string, kind string, type string, status string, attempted boolean, parent_id string, name string, blob_hash string"
DEPS = "operation_id string, needs string"


def op(operation, obj, kind="create", type_="folder", parent="R", name=None, blob=None, status="pending", attempted=False):
    return (operation, obj, kind, type_, status, attempted, parent if kind == "create" else None, (name or obj) if kind == "create" else None, blob)


TREE = [
    op("r", "R", parent=None, status="conflict"), op("a", "A"), op("b", "B", parent="A"), op("n", "N", type_="note", parent="B", name="n.md", blob="h1"),
    op("u1", "N", "update", "note", blob="h2"), op("u2", "N", "update", "note", blob="h3"), op("m", "M", type_="note", name="m.md", blob="k"),
]
NEEDS = [("a", "r"), ("b", "a"), ("n", "b"), ("u1", "n"), ("u2", "u1"), ("m", "r")]


def check(spark, ops, deps, baselines=(), roots=(("r", "R"),)):
    verdicts, members = cl.linear_chain_check(
        spark.createDataFrame(ops, OPS), spark.createDataFrame(deps, DEPS), spark.createDataFrame([*roots], "operation_id string, object_id string"), spark.createDataFrame([(b,) for b in baselines], "object_id string")
    )
    return {r.root_operation: r.problem for r in verdicts.collect()}, members


def test_pending_tree_and_its_new_root(spark):
    verdicts, members = check(spark, TREE, NEEDS)
    assert verdicts == {"r": None}
    got = {r.object_id: (r.path, r.depth, r.final_hash, r.n_updates, r.create_operation) for r in members.collect()}
    assert got == {"A": ("A", 1, None, 0, "a"), "B": ("A/B", 2, None, 0, "b"), "N": ("A/B/n.md", 3, "h3", 2, "n"), "M": ("m.md", 1, "k", 0, "m")}
    roots = spark.createDataFrame([("r", "R2", "inbox", "kept")], "root_operation string, new_object string, parent_id string, name string")
    rows = {r.object_id: r for r in cl.reroot_pending_tree(members, roots).collect()}
    assert {i: (r.parent_id, r.type, r.name, r.blob_hash) for i, r in rows.items()} == {
        "R2": ("inbox", "folder", "kept", None), "A": ("R2", "folder", "A", None), "B": ("A", "folder", "B", None), "N": ("B", "note", "n.md", "h3"), "M": ("R2", "note", "m.md", "k"),
    }
    assert all(rows[i].depends_on == (rows[rows[i].parent_id].operation_id if i != "R2" else None) for i in rows) and len({r.operation_id for r in rows.values()}) == 5


def test_what_makes_a_pending_tree_unfit(spark):
    def with_(*rows, without=(), deps=()):
        return [x for x in TREE if x[0] not in without] + list(rows), [d for d in NEEDS if d[0] not in without] + list(deps)

    cases = {
        "sent": with_(op("b", "B", parent="A", attempted=True), without=("b",), deps=[("b", "a")]),
        "branch": with_(op("u3", "N", "update", "note", blob="h4"), deps=[("u3", "n")]),
        "several_dependencies": with_(deps=[("b", "m")]),
        "parent": with_(op("m", "M", type_="note", parent="A", blob="k"), without=("m",), deps=[("m", "r")]),
        "name": with_(op("m", "M", type_="note", name="a:b", blob="k"), without=("m",), deps=[("m", "r")]),
        "hash": with_(op("m", "M", type_="note", name="m.md"), without=("m",), deps=[("m", "r")]),
        "kind": with_(op("d", "M", "delete", "note"), deps=[("d", "m")]),
        "chain": with_(op("x", "M", "update", "note", blob="z"), deps=[("x", "a")]),
        "repeated_object": with_(op("a2", "A"), deps=[("a2", "r")]),
        "outside_history": with_(op("z", "M", "update", "note", blob="z")),
        "not_nested": ([TREE[0], TREE[6]], [("m", "r")]),
        None: (TREE + [op("other", "O", parent=None)], NEEDS + [("other", "gone"), ("c1", "c2"), ("c2", "c1")]),
    }
    assert {want: check(spark, *case)[0]["r"] for want, case in cases.items()} == {want: want for want in cases}
    assert check(spark, TREE, NEEDS, baselines=["B"])[0] == {"r": "baseline"}


def test_long_chains_and_many_roots(spark):
    ops, deps = [], []
    for k in range(3):
        ops += [op(f"r{k}", f"R{k}", parent=None, status="conflict"), op(f"f{k}", f"F{k}", parent=f"R{k}"), op(f"n{k}", f"N{k}", type_="note", parent=f"F{k}", blob="h0")]
        deps += [(f"f{k}", f"r{k}"), (f"n{k}", f"f{k}")]
        for j in range(700):
            ops.append(op(f"u{k}-{j}", f"N{k}", "update", "note", blob=f"h{j + 1}"))
            deps.append((f"u{k}-{j}", f"u{k}-{j - 1}" if j else f"n{k}"))
    verdicts, members = check(spark, ops, deps, roots=[(f"r{k}", f"R{k}") for k in range(3)])
    assert verdicts == {f"r{k}": None for k in range(3)}
    assert {(r.object_id, r.final_hash, r.n_updates) for r in members.collect() if r.type == "note"} == {(f"N{k}", "h700", 700) for k in range(3)}


def test_split_subtree(spark):
    members = [("R", i, p, t, i.lower(), b) for i, p, t, b in (("A", "R", "folder", None), ("B", "A", "folder", None), ("N", "B", "note", "h"), ("L", "B", "note", "l"))]
    members += [("S", "C", "S", "folder", "c", None), ("T", "D", "T", "folder", "d", None)]
    plan = lambda outbox: cl.split_subtree_plan(
        spark.createDataFrame(members, "root string, object_id string, parent_id string, type string, name string, blob_hash string"),
        spark.createDataFrame([("x", "R", "R2"), ("y", "S", "S2"), ("z", "T", "T2")], "operation_id string, root string, new_root string"),
        spark.createDataFrame([("A",), ("B",), ("N",), ("D",)], "object_id string"), spark.createDataFrame(outbox, "operation_id string, object_id string, status string"),
    )
    verdicts, creates, superseded = plan([("o1", "L", "pending"), ("o2", "N", "accepted"), ("o3", "L", "accepted"), ("o4", "D", "attempted")])
    assert {r.operation_id: r.problem for r in verdicts.collect()} == {"x": None, "y": "nothing_known", "z": "open_intent"}
    rows = {r.source_id: r for r in creates.collect()}
    assert set(rows) == {"A", "B", "N", "L"} and rows["L"].object_id == "L" and all(rows[i].object_id != i for i in "ABN")
    assert rows["A"].parent_id == "R2" and rows["B"].parent_id == rows["A"].object_id and rows["L"].parent_id == rows["N"].parent_id == rows["B"].object_id
    assert rows["B"].depends_on == rows["A"].new_operation and rows["N"].depends_on == rows["B"].new_operation and rows["A"].depends_on not in (None, rows["A"].new_operation)
    assert [tuple(r) for r in superseded.collect()] == [("x", "o1")]


def changed(versions, root, at):
    """The docstring of subtree_changed_since, over sets."""
    last = lambda rows: {o: (p, d) for _, o, p, d in sorted(rows)}

    def below(state):
        out = {root} if root in state and not state[root][1] else set()
        while more := {o for o, (p, d) in state.items() if p in out and not d} - out:
            out |= more
        return out

    then = below(last([v for v in versions if v[0] <= at]))
    put = set()
    while more := {o for c, o, p, _ in versions if c > at and p in then | put} - put:
        put |= more
    every = then | put | below(last(versions))
    return any(c > at and o in every for c, o, *_ in versions)


def test_changes_below_folders_equal_a_model(spark):
    rng, rows, by_tenant, requests = random.Random(3), [], defaultdict(list), []
    for tenant in range(12):
        for cursor in range(1, rng.randint(4, 40)):
            o = f"o{rng.randrange(9)}"
            by_tenant[tenant].append((cursor, o, rng.choice([None, *[f"o{k}" for k in range(9) if f"o{k}" < o]]), rng.random() < 0.15))
        rows += [(tenant, *v) for v in by_tenant[tenant]]
        requests += [(len(requests) + k, tenant, f"o{rng.randrange(9)}", rng.randrange(40)) for k in range(25)]
    got = cl.subtree_changed_since(
        spark.createDataFrame(rows, "tenant long, cursor long, object_id string, parent_id string, deleted boolean"), spark.createDataFrame(requests, "request_id long, tenant long, root string, cursor long")
    )
    want = {i: changed(by_tenant[t], root, at) for i, t, root, at in requests}
    assert {r.request_id: r.changed for r in got.collect()} == want and {*want.values()} == {True, False}


def test_changes_below_deep_folders_and_circles_take_few_rounds(spark, monkeypatch):
    """A chain of 400 folders, the last of which changes; two folders that lie in each other; a move out and one into a folder deleted since."""
    rows = [(1, k + 1, f"o{k}", f"o{k - 1}" if k else None, False) for k in range(400)] + [(1, 1000, "o399", "o398", False)]
    rows += [(2, 1, "a", "b", False), (2, 2, "b", "a", False), (2, 3, "c", "b", False), (2, 9, "c", None, False)]
    rows += [(3, 1, "p", None, False), (3, 2, "q", "p", False), (3, 3, "x", "q", False), (3, 7, "x", "q", True), (3, 8, "q", "p", True)]
    asked = [(1, "o0", 999), (1, "o0", 1000), (1, "o399", 999), (1, "o300", 500), (2, "a", 8), (2, "b", 9), (3, "p", 6), (3, "p", 7), (3, "p", 8), (3, "q", 8), (3, "q", 2), (3, "none", 1)]
    tables, keep = [], cl.persisted
    monkeypatch.setattr(cl, "persisted", lambda df: tables.append(keep(df)) or tables[-1])
    got = cl.subtree_changed_since(
        spark.createDataFrame(rows, "tenant long, cursor long, object_id string, parent_id string, deleted boolean"), spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "request_id long, tenant long, root string, cursor long")
    )
    want = {k: changed([v[1:] for v in rows if v[0] == t], root, at) for k, (t, root, at) in enumerate(asked)}
    assert {r.request_id: r.changed for r in got.collect()} == want and len(tables) < 15


def test_changes_below_folders_in_circles_equal_a_model(spark):
    rng, rows, by_tenant, requests = random.Random(5), [], defaultdict(list), []
    for tenant in range(40):
        for cursor in range(1, rng.randint(4, 30)):
            by_tenant[tenant].append((cursor, f"o{rng.randrange(6)}", rng.choice([None, *[f"o{k}" for k in range(6)]]), rng.random() < 0.2))
        rows += [(tenant, *v) for v in by_tenant[tenant]]
        requests += [(len(requests) + k, tenant, f"o{rng.randrange(6)}", rng.randrange(32)) for k in range(30)]
    got = cl.subtree_changed_since(
        spark.createDataFrame(rows, "tenant long, cursor long, object_id string, parent_id string, deleted boolean"), spark.createDataFrame(requests, "request_id long, tenant long, root string, cursor long")
    )
    assert {r.request_id: r.changed for r in got.collect()} == {i: changed(by_tenant[t], root, at) for i, t, root, at in requests}


def test_what_has_ended_is_not_written_again(spark, monkeypatch):
    """A chain of 40 and 500 rows next to the root: rounds write what still goes on only."""
    pointers = [(f"c{k}", f"c{k - 1}" if k else "r") for k in range(40)] + [(f"x{k}", "r") for k in range(500)]
    tables, keep = [], cl.persisted
    monkeypatch.setattr(cl, "persisted", lambda df: tables.append(keep(df)) or tables[-1])
    got = cl.to_roots(spark.createDataFrame(pointers, "id string, up string"), spark.createDataFrame([("r",)], "id string")).collect()
    assert {(r.id, r.root, r.steps) for r in got} == {("r", "r", 0), *((f"c{k}", "r", k + 1) for k in range(40)), *((f"x{k}", "r", 1) for k in range(500))}
    assert sum(t.count() for t in tables) < 3 * len(pointers)


def by_place(spark, ops, deps, baselines=(), roots=(("r", "R"),), place=None):
    verdicts, members = cl.pending_trees(
        spark.createDataFrame(ops, OPS), spark.createDataFrame(deps, DEPS), spark.createDataFrame([*roots], "operation_id string, object_id string"),
        spark.createDataFrame([(b,) for b in baselines], "object_id string"), place,
    )
    return {r.root_operation: r.problem for r in verdicts.collect()}, sorted(map(tuple, members.drop("root_object").collect()), key=repr)


def random_trees(rng, n):
    """Trees of places 0 to n - 1 with every fault there is, some of which reach into other places."""
    ops, deps, roots, baselines = [], [], [], []
    for k in range(n):
        ops.append(op(f"r-{k}", f"R-{k}", parent=None, status="conflict"))
        roots.append((f"r-{k}", f"R-{k}"))
        made = [(f"r-{k}", f"R-{k}", "folder")]
        for j in range(rng.randint(0, 7)):
            at, parent, kind = rng.choice([m for m in made if m[2] == "folder" or rng.random() < 0.05] or made[:1])
            type_ = rng.choice(["folder", "note"])
            i, o = f"{j}c-{k}", f"{j}O-{k}" if rng.random() > 0.03 else f"0O-{rng.randrange(n)}"
            ops.append(op(i, o, type_=type_, parent=parent if rng.random() > 0.03 else "else", name=rng.choice(["n", "n", "n", "a:b"]) if rng.random() < 0.05 else f"n{j}", blob=None if (type_ == "folder") == (rng.random() > 0.03) else "h", attempted=rng.random() < 0.03))
            deps.append((i, at))
            made.append((i, o, type_))
            last = i
            for u in range(rng.choice([0, 0, 1, 2, 4]) if type_ == "note" else rng.random() < 0.02):
                ops.append(op(f"{j}u{u}-{k}", o if rng.random() > 0.03 else f"1O-{k}", rng.choice(["update"] * 20 + ["delete", None]), "note", blob=f"g{u}"))
                deps.append((f"{j}u{u}-{k}", last if rng.random() > 0.03 else rng.choice([i, f"gone-{k}", f"{j}u{u}-{k}", f"0c-{rng.randrange(n)}"])))
                last = f"{j}u{u}-{k}"
        deps += [(rng.choice(made)[0], rng.choice(made)[0])] * (rng.random() < 0.1) + [deps[-1]] * bool(deps) + [(f"x-{k}", made[-1][0])] * (rng.random() < 0.1)
        baselines += [f"0O-{k}"] * (rng.random() < 0.05)
    return ops, deps, baselines, roots


def test_pending_trees_by_place_equal_those_by_joins(spark, monkeypatch):
    """Trees that stay in their place, that reach into others, that are too large, and places that say nothing: always the results of chain_verdicts."""
    tail, one, own = (lambda c: cl.F.substring_index(c, "-", -1)), (lambda c: cl.F.lit("one")), (lambda c: c)
    rng = random.Random(11)
    ops, deps, baselines, roots = random_trees(rng, 150)
    frames = lambda: (spark.createDataFrame(ops, OPS), spark.createDataFrame(deps, DEPS), spark.createDataFrame(roots, "operation_id string, object_id string"), spark.createDataFrame([(b,) for b in baselines], "object_id string"))
    whole = frames()
    verdicts, below = cl.chain_verdicts(*whole)
    want = {r.root_operation: r.problem for r in verdicts.collect()}
    members = sorted(map(tuple, cl.with_parents(cl.chain_members(whole[0], verdicts, below)).drop("root_object").collect()), key=repr)
    assert len({*want.values()}) > 8 and len(members) > 40
    for place in (tail, one, own):
        got = by_place(spark, ops, deps, baselines, roots, place)
        assert {k: (got[0].get(k), v) for k, v in want.items() if got[0].get(k) != v} == {} and got == (want, members)
    monkeypatch.setattr(cl.places, "MOST_ROWS", 10)
    assert by_place(spark, ops, deps, baselines, roots, tail) == (want, members)


def test_trees_within_their_places_are_dealt_once(spark, monkeypatch):
    """No join and no table of operations: one small table of counts is written, however deep the trees are."""
    tables, keep = [], cl.persisted
    for module in (cl, cl.places):
        monkeypatch.setattr(module, "persisted", lambda df: tables.append(keep(df)) or tables[-1])
    ops, deps = [op("r", "R", parent=None, status="conflict")], [("0c", "r")]
    for j in range(300):
        ops.append(op(f"{j}c", f"{j}O", parent=f"{j - 1}O" if j else "R"))
        deps.append((f"{j}c", f"{j - 1}c" if j else "r"))
    verdicts, members = by_place(spark, ops, deps, place=lambda c: cl.F.lit("here"))
    assert verdicts == {"r": None} and len(members) == 300
    assert len(tables) == 1 and tables[0].count() == 1


def test_new_roots_of_trees_by_place_equal_those_of_joins(spark, monkeypatch):
    """The creates of every tree, and nothing written for them: parents' creates come with the members."""
    ops, deps, baselines, roots = random_trees(random.Random(12), 60)
    args = spark.createDataFrame(ops, OPS), spark.createDataFrame(deps, DEPS), spark.createDataFrame(roots, "operation_id string, object_id string"), spark.createDataFrame([(b,) for b in baselines], "object_id string")
    new = spark.createDataFrame([(o, f"new {i}", "inbox", f"{i} again") for o, i in roots], "root_operation string, new_object string, parent_id string, name string")
    want = sorted(map(tuple, cl.reroot_pending_tree(cl.chain_members(args[0], *cl.chain_verdicts(*args)), new).collect()), key=repr)
    members = cl.pending_trees(*args, lambda c: cl.F.substring_index(c, "-", -1))[1]
    tables, keep = [], cl.persisted
    monkeypatch.setattr(cl, "persisted", lambda df: tables.append(keep(df)) or tables[-1])
    assert sorted(map(tuple, cl.reroot_pending_tree(members, new).collect()), key=repr) == want and len(want) > 60 and not tables


def test_split_by_place_equals_split_by_joins(spark, monkeypatch):
    """Roots with none, one and two requests; members, baselines and open operations in the root's place and in others."""
    rng, members, requests, known, outbox = random.Random(7), [], [], [], []
    for k in range(120):
        requests += [(f"s{j}-{k}", f"R-{k}", f"new{j}-{k}") for j in range(rng.choice([0, 1, 1, 1, 2]))]
        ids = [f"R-{k}"]
        for j in range(rng.randint(0, 9)):
            o = f"{j}O-{k}" if rng.random() > 0.02 else f"x{j}{k}-{rng.randrange(120)}"
            members.append((f"R-{k}", o, rng.choice(ids) if rng.random() > 0.05 else rng.choice(["gone", f"1O-{rng.randrange(120)}", None]), rng.choice(["folder", "note"]), f"n{j}", rng.choice([None, "h"])))
            ids.append(o)
            known += [(o,)] * rng.choice([0, 1, 1, 2])
            outbox += [(f"p{len(outbox)}", o, rng.choice(["pending", "conflict", "accepted"]))] * (rng.random() < (0.5 if (o,) not in known else 0.06))
    outbox += [(f"q{j}", "0O-3", "pending") for j in range(3)]
    args = (
        spark.createDataFrame(members, "root string, object_id string, parent_id string, type string, name string, blob_hash string"), spark.createDataFrame(requests, "operation_id string, root string, new_root string"),
        spark.createDataFrame(known, "object_id string"), spark.createDataFrame(outbox, "operation_id string, object_id string, status string"),
    )
    taken = lambda place: [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in cl.split_subtree_plan(*args, place)]
    want, tail = taken(None), lambda c: cl.F.substring_index(c, "-", -1)
    assert all(len(x) > 30 for x in want) and {p for _, p in want[0]} == {None, "open_intent", "nothing_known"}
    assert taken(tail) == want and taken(lambda c: cl.F.lit("one")) == want and taken(lambda c: c) == want
    monkeypatch.setattr(cl.places, "MOST_ROWS", 8)
    assert taken(tail) == want
