import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from changetree.functions.names import collision_key
from changetree.operators import access, content, history, planning, queues, tree
from changetree.plans import feeds, local, notes, recovery, registry, streams

PARTS = (registry, local, recovery, notes, feeds, streams)
QUERIES, SQL = {n: q for p in PARTS for n, q in p.QUERIES.items()}, {n: q for p in PARTS for n, q in p.SQL.items()}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([r[i] for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, want.fetchall())


def test_ancestor_paths_of_broken_trees(spark):
    edges = [(1, None), (2, 1), (3, 2), (10, 99), (11, 10), (20, 21), (21, 20), (22, 21), (30, 30)] + [(1000 + k, 1000 + k - 1 if k else None) for k in range(259)]
    got = {r.object_id: r for r in tree.ancestor_paths(spark.createDataFrame([(i, p, f"n{i}") for i, p in edges], "object_id long, parent_id long, name string")).collect()}
    assert len(got) == len(edges)
    assert (got[3].path, got[3].depth, got[3].ancestors) == ("n1/n2/n3", 3, [2, 1])
    assert {i: got[i].status for i in (10, 11, 20, 21, 22, 30)} == {10: "orphan", 11: "orphan", 20: "cycle", 21: "cycle", 22: "cycle", 30: "cycle"}
    assert [got[1000 + k].status for k in (0, 255, 256, 258)] == ["ok", "ok", "too_deep", "too_deep"]


def test_length_of_proposed_and_moved_paths(spark):
    objects = [("top", None, "folder", "t" * 200), ("mid", "top", "folder", "m" * 200), ("low", "mid", "note", "n" * 200), ("flat", None, "folder", "f")]
    nodes = spark.createDataFrame([(i, p, n) for i, p, _, n in objects], "object_id string, parent_id string, name string")
    paths = tree.ancestor_paths(nodes)
    state = spark.createDataFrame([(i, p, t, 1, False, n) for i, p, t, n in objects], "object_id string, parent_id string, type string, revision long, deleted boolean, name_key string")
    rows = [("a", "create", "x", "note", 0, "mid", "y" * 366), ("b", "create", "x", "note", 0, "mid", "y" * 367), ("c", "create", "x", "note", 0, None, "y" * 900), ("d", "move", "mid", "folder", 1, None, "z" * 567),
            ("e", "move", "mid", "folder", 1, None, "z" * 568), ("f", "move", "mid", "folder", 1, "low", "z" * 900), ("g", "create", "x", "note", 0, None, "é" * 385)]
    proposals = spark.createDataFrame([(*r, r[-1]) for r in rows], "operation_id string, kind string, object_id string, type string, base_revision long, parent_id string, name string, name_key string")
    got = {r.operation_id: r.code for r in access.classify_proposals(proposals, state, paths).collect()}
    assert got == {"a": "accepted", "b": "invalid", "c": "invalid", "d": "accepted", "e": "invalid", "f": "parent_unavailable", "g": "invalid"}
    moves = spark.createDataFrame([("flat", None, "TRA\u017fH"), ("mid", "flat", "x"), ("low", None, "trash.md")], "object_id string, new_parent string, new_name string")
    got = tree.moved_path_check(paths, moves, reserved=("Trash",))
    assert [(r.object_id, r.problem) for r in got.collect()] == [("flat", "reserved_root")]
    kept = spark.createDataFrame([("bin", None, "Bin"), ("in", "bin", "Kept"), *[(i, p, n) for i, p, _, n in objects]], "object_id string, parent_id string, name string")
    moves = spark.createDataFrame([("mid", "in", "m"), ("flat", "bin", "f")], "object_id string, new_parent string, new_name string")
    got = tree.moved_path_check(tree.ancestor_paths(kept), moves, reserved=("bin",), recovery=("Bin", "Kept"))
    assert sorted((r.moved, r.object_id, r.problem) for r in got.collect()) == [("flat", "flat", "reserved_root"), ("mid", "low", "reserved_root")]


def test_versions_are_compared_as_pairs(spark):
    df = spark.createDataFrame([("k", i, g, r) for i, (g, r) in enumerate([(4, 9), (4, 8), (3, 99), (4, 9), (5, 0)])], "k string, i int, g int, r int")
    got = history.monotonic_version_filter(df, "k", "g", "r", "i").orderBy("i").collect()
    assert [x.accepted for x in got] == [True, False, False, True, True]


def test_portable_names(spark):
    names = {"Note.md": None, "": "empty", "a" * 180: None, "a" * 181: "too_long", "a:b": "forbidden_character", "a\tb": "forbidden_character", "a ": "trailing_space_or_dot", "a.": "trailing_space_or_dot", "con.md": "reserved_device", "LPT¹": "reserved_device", "con .md": "reserved_device", "Cafe\u0301": "not_nfc", "Café": None, "console": None, None: "empty"}
    df = content.portable_name_check(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert {r["name"]: r.problem for r in df.collect()} == names


def test_entry_without_the_training_data_package(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).columns


def test_collision_keys(spark):
    names = {"Straße": "strasse", "STRASSE": "strasse", "Cafe\u0301": "café", "ABC": "abc", "Ä": "ä", None: None}
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("k", collision_key(F.col("name")))
    assert {r["name"]: r.k for r in df.collect()} == names
    pairs = content.sibling_collisions(spark.createDataFrame([("p", "Straße"), ("p", "STRASSE"), ("q", "a"), ("q", "a")], "parent string, name string")).collect()
    assert [(r.parent, r.n_names) for r in pairs] == [("p", 2)]


def test_path_policy(spark):
    paths = {"a/b.md": (None, None), "": ("empty", None), "/a": ("leading_slash", None), "a//b": ("empty_or_dots", 1), "a/../b": ("empty_or_dots", 1), "a/con.md/": ("reserved_device", 1), "TRASH/x": ("reserved_root", 0), "x/trash": (None, None), "a/" + "b" * 900: ("too_long", None)}
    df = content.path_policy_check(spark.createDataFrame([(p,) for p in paths], "path string"), "path", ("Trash",))
    assert {r.path: (r.problem, r.part) for r in df.collect()} == paths


def test_empty_pages_keep_their_cursor(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "tenant string, cursor long, name string")
    rows = history.change_feed_page(log, spark.createDataFrame([("a", 2), ("b", 0)], "tenant string, after long")).collect()
    assert sorted((r.tenant, r.cursor, r.has_more, r.next_cursor) for r in rows) == [("a", None, False, 2), ("b", None, False, 0)]
    with pytest.raises(ValueError):
        history.change_feed_page(log, log, 501)


def test_rate_limit_window_is_anchored(spark):
    """Rejected attempts don't extend the window; time that goes backwards begins a new one."""
    rows = [("k", t, i) for i, t in enumerate([0, 10, 20, 30, 899, 900, 901])]
    got = access.rate_limit_decisions(spark.createDataFrame(rows, "key string, at long, attempt_id long"), 3, 900).orderBy("attempt_id").collect()
    assert [r.outcome for r in got] == [None, None, None, 870, 1, None, None]


def test_quota_equality_fits_and_rejected_bytes_do_not_count(spark):
    rows = [("t", 1, "a", 60), ("t", 2, "b", 50), ("t", 3, "a", 60), ("t", 4, "c", 40), ("t", 5, "d", 1), ("t", 6, "b", 50)]
    got = access.quota_admission(spark.createDataFrame(rows, "tenant string, sequence long, blob_hash string, size long"), 100).orderBy("sequence").collect()
    assert [r.admitted for r in got] == [True, False, True, True, False, False]


def test_doomed_dependents_of_cycles_and_branches(spark):
    outbox = spark.createDataFrame([(i, "pending" if i != 4 else "accepted") for i in range(1, 9)], "operation_id long, status string")
    deps = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (6, 7), (7, 6), (2, 3)], "operation_id long, needs long")
    got = queues.doomed_dependents(outbox, deps, spark.createDataFrame([(1,)], "operation_id long")).collect()
    assert sorted(r.operation_id for r in got) == [2, 3, 5]


def test_manifest_audit(spark):
    objects = spark.createDataFrame([("r", None, "r", "folder"), ("f", "r", "f", "folder"), ("n", "f", "n", "note"), ("m", "r", "m", "note")], "object_id string, parent_id string, name string, type string")
    roots = spark.createDataFrame([("r", "op", 10)], "root string, operation_id string, first_cursor long")
    plan = tree.clone_subtree_plan(objects, tree.ancestor_paths(objects), roots)
    assert [(r.cursor, r.phase, r.object_id) for r in plan.orderBy("cursor").collect()] == [(10, "clone", "r"), (11, "clone", "f"), (12, "move", "m"), (13, "move", "n"), (14, "delete", "f"), (15, "delete", "r")]
    assert tree.manifest_audit(plan).collect() == []
    assert sorted(r.problem for r in tree.manifest_audit(plan.where("cursor <> 11")).collect()) == ["clones", "cursors", "moves"]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("hello")
    (tmp_path / "y.md").write_text("")
    (tmp_path / "z.txt").write_text("no note")
    got = {r.path: (r.size_bytes, r.content_hash) for r in content.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a/x.md": (5, hashlib.sha256(b"hello").hexdigest())}  # the reader leaves empty files out


def test_conflict_names_are_cut_between_characters(spark):
    rows = [("ä" * 100 + ".md", "note", "op"), (".md", "note", "op"), (None, "folder", "op"), ("a.b", "folder", "op")]
    got = [r.copy_name for r in planning.conflict_names(spark.createDataFrame(rows, "name string, type string, operation_id string")).collect()]
    assert got == ["ä" * 80 + " (Konflikt - op).md", "Notiz (Konflikt - op).md", "Ordner (Konflikt - op)", "a.b (Konflikt - op)"]
    assert all(len(x.encode()) <= 180 for x in got)


def test_addresses(spark):
    want = {"  A.b+c@Example.ORG\t": "a.b+c@example.org", "a@b@c": None, ".a@x": None, "a@x.": None, "a@[1]": None, "a@-x": None, "a@ab--c.de": None, "a@xn--bcher-kva.de": "a@xn--bcher-kva.de", "ä@x": None, "@x": None, "a" * 65 + "@x": None, "a@x_y": None, None: None}
    df = planning.email_identity(spark.createDataFrame([(i, e) for i, e in enumerate(want)], "account_id long, email string")).orderBy("account_id")
    assert [r.canonical for r in df.collect()] == list(want.values())


def test_normalize_tags(spark):
    rows = [(1, [" Straße", "STRASSE", "b", "Cafe\u0301"]), (2, []), (3, None), (4, ["a", ""]), (5, ["a", None]), (6, ["a\u0007b"]), (7, ["x" * 40, "é" * 41])]
    got = {r.doc_id: (r.tags, r.valid) for r in planning.normalize_tags(spark.createDataFrame(rows, "doc_id long, tags array<string>")).collect()}
    assert got == {1: (["Straße", "b", "Café"], True), 2: ([], True), 3: ([], True), **{k: (None, False) for k in (4, 5, 6, 7)}}


def test_paths_below_broken_chains_and_longest_moves(spark, monkeypatch):
    """Notes take what their folder has: orphans, cycles, chains too deep by one; only folders are in the rounds. Moves that can't be too long aren't spread over what is below."""
    written = []
    monkeypatch.setattr(tree, "persisted", lambda df, f=tree.persisted: (out := f(df), written.append(out))[0])
    chain = [(f"d{k}", f"d{k - 1}" if k else None, "n") for k in range(256)]
    rows = [*chain, ("deep", "d255", "x"), ("ok", "d254", "x"), ("lost", "gone", "l"), ("under", "lost", "x"), ("a", "b", "a"), ("b", "a", "b"), ("in", "b", "x"), ("self", "self", "s")]
    paths = tree.ancestor_paths(spark.createDataFrame([*rows, *[(f"m{k}", "d0", "m") for k in range(300)]], "object_id string, parent_id string, name string"))
    got = {r.object_id: r for r in paths.collect()}
    assert len(got) == len(rows) + 300
    assert {i: got[i].status for i in ("deep", "ok", "lost", "under", "a", "in", "self")} == {"deep": "too_deep", "ok": "ok", "lost": "orphan", "under": "orphan", "a": "cycle", "in": "cycle", "self": "cycle"}
    assert (got["ok"].depth, got["ok"].ancestors[:2], got["m7"].path, got["d0"].ancestors) == (256, ["d254", "d253"], "n/m", []) and got["deep"].path is None
    assert max(t.count() for t in written[:-1]) <= len(chain) + 4
    flat = [("f", None, "f"), ("g", None, "g"), *[(f"x{k}", "f", "x" * k) for k in range(1, 20)], ("y", "g", "y")]
    moves = spark.createDataFrame([("f", "g", "n" * 18), ("g", None, "h"), ("y", "none", "z" * 99)], "object_id string, new_parent string, new_name string")
    found = tree.moved_path_check(tree.ancestor_paths(spark.createDataFrame(flat, "object_id string, parent_id string, name string")), moves, most_bytes=30)
    assert sorted(r.object_id for r in found.collect()) == sorted(f"x{k}" for k in range(10, 20))
    assert [r.moved for r in written[-1].collect()] == ["f"]
