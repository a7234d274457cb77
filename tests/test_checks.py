"""Limits against a loop, pages, listings and seals against golden rows."""

import random

from changetree.operators import checks, limits


def loop(rows, limit, window):
    """One attempt after the other: (key, attempt_id) -> seconds to wait, None if allowed."""
    state, out = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        start, n = state.get(key, (None, 0))
        if start is None or at - start >= window:
            start, n = at, 0
        out[key, i] = None if n < limit else window - (at - start)
        state[key] = (start, n + (n < limit))
    return out


def test_windows_equal_a_loop(spark):
    rng = random.Random(1)
    for limit, window, n, most in ((3, 10, 300, 200), (1, 7, 200, 60), (5, 60, 300, 20_000), (2, 1, 100, 30)):
        rows = [(rng.choice("abc"), rng.randrange(-5, most), k) for k in range(n)]
        got = limits.limit_by_windows(spark.createDataFrame(rows, "key string, at long, attempt_id long"), limit, window).collect()
        assert {(r.key, r.attempt_id): r.outcome for r in got} == loop(rows, limit, window) and len(got) == n


def test_windows_link_over_blocks_and_gaps(spark, monkeypatch):
    """Rounds grow with blocks of windows and not with windows; blocks that are empty, end early or hold a few seconds of the first window only."""
    rng = random.Random(4)
    rounds = []
    monkeypatch.setattr(limits, "dropped", lambda *tables, f=limits.dropped: (rounds.append(len(tables)), f(*tables)))
    rows = [("a", k, k) for k in range(0, 3000, 2)]
    got = limits.limit_by_windows(spark.createDataFrame(rows, "key string, at long, attempt_id long"), 2, 7).collect()
    assert {(r.key, r.attempt_id): r.outcome for r in got} == loop(rows, 2, 7) and len(rounds) < 4  # 375 windows took 9 rounds
    monkeypatch.setattr(limits, "BLOCK", 20)
    for n, most in ((80, 100), (60, 2000), (400, 300)):
        rows = [(rng.choice("ab"), rng.randrange(-50, most), k) for k in range(n)]
        rows += [("c", at, n + k) for k, at in enumerate((0, 13, 14, 19, 20, 21, 22, 40, 41, 60, 90, 91, 140))]
        for limit in (0, 2):
            got = limits.limit_by_windows(spark.createDataFrame(rows, "key string, at long, attempt_id long"), limit, 7).collect()
            want = loop(rows, limit, 7) if limit else None
            assert len(got) == len(rows) and (all(r.outcome for r in got) if not limit else {(r.key, r.attempt_id): r.outcome for r in got} == want)


def test_shared_limit_comes_first(spark):
    rng = random.Random(2)
    rows = [(s, k, a, i) for i, (s, k, a) in enumerate((rng.choice("xy"), rng.choice("pqr"), rng.randrange(120)) for _ in range(150))]
    got = {(r.scope, r.attempt_id): (r.stage, r.outcome) for r in limits.rate_limit_stages(spark.createDataFrame(rows, "scope string, key string, at long, attempt_id long"), 6, 2, 15).collect()}
    first = loop([(s, a, i) for s, _, a, i in rows], 6, 15)
    second = loop([((s, k), a, i) for s, k, a, i in rows if first[s, i] is None], 2, 15)
    want = {(s, i): ("all", first[s, i]) if first[s, i] is not None else ("key", second[(s, k), i]) if second[(s, k), i] is not None else (None, None) for s, k, _, i in rows}
    assert got == want and {x[0] for x in want.values()} == {"all", "key", None}


def test_page_conflicts(spark):
    columns = "tenant string, cursor long, object_id string, type string, mutation string, revision long, parent_id string, name string, blob_hash string"
    rows = [
        ("F", "folder", "create", 1, None, "f", None, None), ("N", "note", "create", 1, "F", "n.md", "h1", None), ("N", "note", "update", 2, "F", "n.md", "h2", None), ("N", "note", "move", 3, None, "m.md", "h2", None),
        ("N", "note", "delete", 4, None, "m.md", "h2", None), ("N", "note", "update", 5, None, "m.md", "h1", "after_delete"), ("L", "note", "update", 2, None, "l.md", "h3", "local_intent"),
        ("A", "note", "create", 2, None, "a.md", "h4", "shape"), ("A2", "folder", "update", 2, None, "a", None, "shape"), ("B", "note", "create", 1, None, "b.txt", "h4", "extension"),
        ("C", "note", "create", 1, "later", "c.MD", "h4", "parent_missing"), ("later", "folder", "create", 1, None, "x", None, None), ("D", "note", "create", 1, None, "d.md", "none", "missing_blob"),
        ("E", "note", "create", 1, None, "e.md", "bad", "hash_mismatch"), ("G", "note", "create", 1, None, "g.md", "h1", "identity_mismatch"), ("H", "note", "update", 2, None, "h.md", "hH", "unknown_object"),
        ("S", "note", "create", 1, None, "s.md", "hS", None), ("S2", "note", "create", 1, None, "moved.md", "hS2", "repeated_create"), ("S3", "note", "update", 2, None, "moved.md", "hS3", "path_changed"),
        ("S4", "note", "move", 2, None, "t.md", "hS4", "bytes_changed"), ("S5", "note", "delete", 2, None, "other.md", "hS5", "delete_differs"), ("P", "note", "create", 1, "old", "p.md", "hP", None),
    ]
    page = spark.createDataFrame([("t", k, *r[:-1]) for k, r in enumerate(rows)], columns)
    objects = spark.createDataFrame([("t", i, "note", None, f"{n}.md", b) for i, n, b in (("S", "s", "hS"), ("S2", "s2", "hS2"), ("S3", "s3", "h0"), ("S4", "s4", "h0"), ("S5", "s5", "hS5"))] + [("t", "old", "folder", None, "old", None)],
                                    "tenant string, object_id string, type string, parent_id string, name string, blob_hash string")
    owners = {"h1": "N", "h2": "N", "h3": "L", "h4": "A", "hH": "H"} | {f"h{i}": i for i in ("S", "S2", "S3", "S4", "S5", "P")}
    blobs = spark.createDataFrame([(h, h, i) for h, i in owners.items()] + [("bad", "other", "E")], "blob_hash string, content_hash string, note_id string")
    got = {r.cursor: r.reason for r in checks.page_conflict_check(page, objects, spark.createDataFrame([("t", "L"), ("u", "N")], "tenant string, object_id string"), blobs).collect()}
    assert got == {k: r[-1] for k, r in enumerate(rows)}


def test_inventory_issues(spark):
    rows = [("a.md", "note", "1", None, True), ("A.md", "note", "2", None, True), ("d/a.md", "note", "1", None, True), ("d/b?.md", "note", None, None, True), ("d/c.md", "note", None, "invalid_yaml", True), ("d", "folder", None, None, True), ("x.md", "note", None, None, False)]
    got = checks.inventory_issues(spark.createDataFrame(rows, "path string, type string, note_id string, problem string, readable boolean"))
    assert sorted((r.path, r.code) for r in got.collect()) == [
        ("A.md", "name_collision"), ("a.md", "duplicate_note_id"), ("a.md", "name_collision"), ("d/a.md", "duplicate_note_id"), ("d/b?.md", "invalid_name"), ("d/c.md", "invalid_front_matter"), ("x.md", "unreadable"),
    ]


def test_tag_tree(spark):
    docs = spark.createDataFrame([("b/x10/n.md", ["t"]), ("b/x9/n.md", []), ("b/m.md", ["t", "u"]), ("top.md", ["t"]), ("A/q.md", ["u"])], "path string, tag_keys array<string>")
    folders = spark.createDataFrame([("empty/deep",), ("b",)], "path string")
    rows = lambda tag: [(r.folder, r.depth, r.n_notes, r.n_direct) for r in checks.tag_tree_rollup(docs, folders, tag).orderBy("sort_key").collect()]
    assert rows(None) == [("A", 1, 1, 1), ("b", 1, 3, 1), ("b/x9", 2, 1, 1), ("b/x10", 2, 1, 1), ("empty", 1, 0, 0), ("empty/deep", 2, 0, 0)]
    assert rows("t") == [("b", 1, 2, 1), ("b/x10", 2, 1, 1)] and rows("none") == []


def test_seals(spark):
    columns = "seal_id string, depth int, ancestor_id string, parent_id string, path string, device int, inode int, revision int"
    chain = lambda s, **kw: [(s, 1, "a", "b", kw.get("path", "b/a"), 1, kw.get("inode", 2), 3), (s, 2, "b", kw.get("top"), "b", 1, 5, kw.get("rev", 1))]
    sealed = chain("ok") + chain("moved") + chain("longer") + chain("gone") + chain("zero", inode=0) + chain("open", top="c")
    now = chain("ok") + chain("moved", path="c/a") + chain("longer") + [("longer", 3, "c", None, "c", 1, 9, 1)] + chain("zero", inode=0) + chain("open", top="c") + chain("unsealed")
    got = {r.seal_id: (r.valid, r.n_sealed, r.n_current, r.n_equal) for r in checks.ancestry_seal_check(spark.createDataFrame(sealed, columns), spark.createDataFrame(now, columns)).collect()}
    assert got == {"ok": (True, 2, 2, 2), "moved": (False, 2, 2, 1), "longer": (False, 2, 3, 2), "gone": (False, 2, 0, 0), "zero": (False, 2, 2, 1), "open": (False, 2, 2, 2)}
