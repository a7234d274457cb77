"""Reconciliation against golden scenes and a plain model."""

import random
from collections import defaultdict

import pytest

from changetree.operators import reconcile as rc

LISTING = "tree string, path string, type string, object_id string, device int, inode int, state string"


def listing(spark, rows):
    return spark.createDataFrame([(t, p, kind, i, 1 if kind == "folder" else None, n, s) for t, p, kind, i, n, s in rows], LISTING)


def folders(spark, rows, unique):
    all_ = listing(spark, rows)
    return all_.where("type = 'folder'").join(rc.folder_signatures(all_, unique), ["tree", "path"])


def signatures(rows, unique):
    times = defaultdict(int)
    for t, _, kind, i, *_ in rows:
        times[t, i] += kind == "note"
    out = {}
    for t, f, kind, *_ in rows:
        if kind == "folder":
            below = [(p[len(f) + 1 :], k, i) for u, p, k, i, *_ in rows if u == t and p.startswith(f + "/")]
            out[t, f] = "\0".join(sorted(("D:" + p) if k == "folder" else f"N:{p}:{i}" for p, k, i in below if k == "folder" or not unique or (i is not None and times[t, i] == 1)))
    return out


def hinted(prev, cur, hints):
    """One hint after the other, as the docstring says."""
    old, now, out = signatures(prev, False), signatures(cur, True), {}
    for tree in {t for t, _ in hints}:
        fresh = {p for t, p in now if t == tree and (t, p) not in old}
        tops = sorted(p for p in fresh if not any(p.startswith(q + "/") for q in fresh))
        used = set()
        for h in sorted({p for t, p in hints if t == tree}, key=lambda p: (p.count("/"), p)):
            if (tree, h) not in old:
                continue
            fit = [r for r in tops if r not in used and old[tree, h] in ("", now[tree, r])]
            if len(fit) == 1:
                used.add(fit[0])
                for t, p in old:
                    if t == tree and (p == h or p.startswith(h + "/")) and (t, fit[0] + p[len(h) :]) in now:
                        out[t, p] = fit[0] + p[len(h) :]
    return out


def matched(prev, cur, forced):
    old_s, now_s, out = signatures(prev, False), signatures(cur, True), set()
    olds, nows = ([r for r in rows if r[2] == "folder"] for rows in (prev, cur))
    targets = {(t, p) for (t, _), p in forced.items()}
    edges = set()
    for t, p, _, _, inode, state in olds:
        if (t, p) in forced:
            edges.add((t, p, forced[t, p]))
            continue
        for u, q, _, _, other, _ in nows:
            if u == t and (u, q) not in targets and inode == other and ((p == q and state != "pending") or (old_s[t, p] and old_s[t, p] == now_s[u, q])):
                edges.add((t, p, q))
    by_old, by_now = defaultdict(set), defaultdict(set)
    for t, p, q in edges:
        by_old[t, p].add(q)
        by_now[t, q].add(p)
    pairs = {(t, p): q for t, p, q in edges if len(by_old[t, p]) == 1 and len(by_now[t, q]) == 1}
    taken = {(t, q) for (t, _), q in pairs.items()}
    for t, p, _, i, _, _ in olds:
        if (t, p) in pairs:
            out.add((t, pairs[t, p], p, i, "known"))
        elif any(r[0] == t and (t, r[1]) not in taken for r in nows):
            out.add((t, p, p, i, "pending"))
    for t, q, *_ in nows:
        if (t, q) not in taken:
            out.add((t, q, None, None, "ambiguous" if any(r[0] == t and (t, r[1]) not in pairs for r in olds) else "new"))
    return out


def scene(seed):
    """Two listings of some trees, with moves, new and lost folders, repeated inodes and ids, and hints."""
    rng, prev, cur, hints = random.Random(seed), [], [], []
    for tree in "abcdefgh":
        names, k = ["x", "y", "z"], 0
        paths = []
        for depth in range(3):
            for above in [p for p in paths if p.count("/") == depth - 1] if depth else [""]:
                for name in rng.sample(names, rng.randint(0, 2)):
                    paths.append(f"{above}/{name}" if above else name)
        notes = [(f"{rng.choice(paths)}/{rng.choice('mn')}.md", f"{tree}{j}") for j in range(rng.randint(0, 5)) if paths]
        notes = [*{p: (p, i) for p, i in notes}.values()]
        for k, p in enumerate(paths):
            prev.append((tree, p, "folder", f"{tree}-f{k}", rng.choice([k + 1, k + 1, k + 1, 1]), rng.choice(["known", "known", "new", "pending"])))
        prev += [(tree, p, "note", i, None, "known") for p, i in notes]
        moved = {p: p for p in paths}
        for p in rng.sample(paths, min(len(paths), rng.randint(0, 2))):
            to = rng.choice(["new", "other", f"{paths[0]}/new"])
            hints.append((tree, p))
            for q in paths:
                if q == p or q.startswith(p + "/"):
                    moved[q] = to + q[len(p) :]
        seen = set()
        for t, p, kind, i, inode, _ in [r for r in prev if r[0] == tree]:
            above = p.rsplit("/", 1)[0] if "/" in p else ""
            to = moved[p] if kind == "folder" else f"{moved[above]}/{p.rsplit('/', 1)[1]}"
            if rng.random() < 0.9 and to not in seen:
                seen.add(to)
                cur.append((t, to, kind, i if kind == "note" and rng.random() < 0.9 else None, inode if rng.random() < 0.9 else 77, "known"))
        cur += [(tree, "extra", "folder", None, 50, "known")] * (rng.random() < 0.3)
    return prev, cur, hints


@pytest.fixture(scope="module")
def scenes():
    """Scenes put side by side, each under its own trees."""
    out = ([], [], [])
    for seed in range(40):
        for all_, rows in zip(out, scene(seed)):
            all_ += [(f"{seed}{r[0]}", *r[1:]) for r in rows]
    return out


def test_hints_equal_the_loop(spark, scenes):
    prev, cur, hints = scenes
    want = hinted(prev, cur, hints)
    got = rc.infer_moves_from_hints(folders(spark, prev, False), folders(spark, cur, True), spark.createDataFrame(hints, "tree string, path string")).collect()
    assert {(r.tree, r.old_path): r.new_path for r in got} == want and len(want) > 40 and len(got) == len(want)


def test_matches_equal_a_model(spark, scenes):
    prev, cur, hints = scenes
    moves = hinted(prev, cur, hints)
    for forced in ({}, moves):
        table = spark.createDataFrame([(t, p, q) for (t, p), q in forced.items()], "tree string, old_path string, new_path string")
        got = [tuple(r) for r in rc.match_moved_folders(folders(spark, prev, False), folders(spark, cur, True), table).collect()]
        want = matched(prev, cur, forced)
        assert len(got) == len(set(got)) and set(got) == want
        assert {s for *_, s in want} == {"known", "new", "ambiguous", "pending"}


def test_empty_hint_takes_the_last_target(spark):
    """An empty folder moves when all targets but one are taken by then, and not before."""
    for order, want in ((("a", "b/c"), {"a": "t1", "b/c": "t2"}), (("b", "a/c"), {"b": "t2"})):
        full, empty = order if order[0] == "a" else order[::-1]
        prev = [("t", p, "folder", p, k, "known") for k, p in enumerate(sorted({full, empty, *(x.split("/")[0] for x in order)}))] + [("t", f"{full}/n.md", "note", "id", None, "known")]
        cur = [("t", "t1", "folder", None, 8, "known"), ("t", "t2", "folder", None, 9, "known"), ("t", "t1/n.md", "note", "id", None, "known")]
        hints = [("t", full), ("t", empty)]
        got = rc.infer_moves_from_hints(folders(spark, prev, False), folders(spark, cur, True), spark.createDataFrame(hints, "tree string, path string")).collect()
        assert {r.old_path: r.new_path for r in got} == {p: q for (_, p), q in hinted(prev, cur, hints).items()}


def test_golden_scenes(spark):
    """A moved folder with notes keeps its id; two equal empty ones are ambiguous; a plain deletion stays one; recovery trusts none."""
    one = [("m", "old", "folder", "F", 5, "known"), ("m", "old/n.md", "note", "N", None, "known")]
    moved = [("m", "new", "folder", None, 5, "known"), ("m", "new/n.md", "note", "N", None, "known")]
    empty = [("e", "a", "folder", "A", 1, "known"), ("e", "b", "folder", "B", 2, "known")]
    swapped = [("e", "c", "folder", None, 1, "known"), ("e", "d", "folder", None, 2, "known")]
    gone = [("g", "x", "folder", "X", 3, "known"), ("g", "y", "folder", "Y", 4, "known")]
    prev, cur = one + empty + gone, moved + swapped + gone[:1] + [("n", "first", "folder", None, 1, "known")]
    args = folders(spark, prev, False), folders(spark, cur, True)
    got = {tuple(r) for r in rc.match_moved_folders(*args).collect()}
    assert got == {
        ("m", "new", "old", "F", "known"), ("e", "c", None, None, "ambiguous"), ("e", "d", None, None, "ambiguous"), ("e", "a", "a", "A", "pending"),
        ("e", "b", "b", "B", "pending"), ("g", "x", "x", "X", "known"), ("n", "first", None, None, "new"),
    }
    trusted = spark.createDataFrame([("e", "c")], "tree string, path string")
    states = {(r.tree, r.path): r.state for r in rc.match_moved_folders(*args, trusted_new=trusted, recovery=True).collect()}
    assert states["e", "c"] == "new" and states["e", "d"] == states["n", "first"] == "ambiguous"


def test_snapshot_changes(spark):
    listed = "object_id string, parent string, name string, content_hash string, state string"
    prev = [("same", "p", "n", "h", "known"), ("moved", "p", "n", "h", "known"), ("both", "p", "n", "h", "known"), ("gone", "p", "n", "h", "known"), ("never", "p", "n", "h", "new"),
            ("again", "p", "n", "h", "new"), ("quiet", "p", "n", "h", "new"), ("wait", "p", "n", "h", "known"), ("was_wait", "p", "n", "h", "pending"), ("was_wait2", "p", "n", "h", "pending")]
    cur = [("same", "p", "n", "h", "known"), ("moved", "q", "n", "h", "known"), ("both", "p", "m", "g", "known"), ("again", "p", "n", "g", "known"), ("quiet", "p", "n", "h", "known"),
           ("wait", "p", "n", "h", "pending"), ("was_wait", "p", "n", "h", "known"), ("was_wait2", "p", "n2", "h", "known"), ("fresh", "p", "n", "h", "new"), ("back", "p", "n", "g", "new")]
    durable = [(i, "p", "n", "h") for i in ("same", "moved", "both", "gone", "wait", "back")]
    got = rc.snapshot_changes(spark.createDataFrame(prev, listed), spark.createDataFrame(cur, listed), spark.createDataFrame(durable, "object_id string, parent string, name string, content_hash string"))
    assert sorted(map(tuple, got.collect())) == [
        ("again", "create"), ("back", "update"), ("both", "move"), ("both", "update"), ("fresh", "create"), ("gone", "delete"), ("moved", "move"), ("never", "cancel"), ("was_wait2", "create"),
    ]
