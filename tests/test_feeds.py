"""Pages taken in order, frontiers and gaps over small buckets, orders numbered over many tasks, routes and recovery names, against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from changetree.operators import content, history, planning, queues


def model(pages, stored):
    """Verdicts of pages taken one after the other: pages of (tenant, page, from, next, rows), stored as {tenant: {cursor: payload}}."""
    out = {}
    for tenant, page, start, end, rows in sorted(pages):
        had = stored.setdefault(tenant, {})
        top = max(had, default=0)
        if sorted(c for c, _ in rows) != list(range(start + 1, end + 1)):
            out[tenant, page] = "reject"
        elif start == top:
            had |= dict(rows)
            out[tenant, page] = "append"
        else:
            out[tenant, page] = "replay" if all(c in had and had[c] == p for c, p in rows) else "reject"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pages_in_order(spark, seed):
    r = random.Random(seed)
    stored = {t: {c: r.choice("ab") for c in range(1, r.randint(1, 6))} for t in "xyz"}
    pages = []
    for t in "wxyz":
        at = max(stored.get(t, {}), default=0)
        for page in range(40):
            start = r.choice([at, at, at, max(at - 2, 0), at + 1, r.randint(0, at)])
            end = start + r.randint(1, 3)
            rows = [(c, stored.get(t, {}).get(c, "a") if r.random() < 0.9 else None) for c in range(start + 1, end + 1)]
            if r.random() < 0.1:
                rows = rows[1:] or [(start, "a")]
            at = end if start == at and r.random() < 0.8 else at
            pages.append((t, page, start, end, rows))
    before = [(t, c, p) for t, had in stored.items() for c, p in had.items()]
    want = model(pages, stored)
    df = spark.createDataFrame([(t, p, a, b, c, x) for t, p, a, b, rows in pages for c, x in rows], "tenant string, page long, from_cursor long, next_cursor long, cursor long, payload string")
    verdicts = queues.ingest_changes(df, spark.createDataFrame(before, "tenant string, cursor long, payload string")).cache()
    assert {(v.tenant, v.page): v.verdict for v in verdicts.collect()} == want and set(want.values()) == {"append", "replay", "reject"}
    added = {(x.tenant, x.cursor, x.payload) for x in queues.append_changes(df, verdicts).collect()}
    assert added == {(t, c, p) for t, had in stored.items() for c, p in had.items()} - set(before)


def test_two_adjoining_pages_and_a_late_replay(spark):
    rows = [("t", 1, 0, 2, 1, "a"), ("t", 1, 0, 2, 2, "b"), ("t", 2, 2, 3, 3, "c"), ("t", 3, 0, 2, 1, "a"), ("t", 3, 0, 2, 2, "b"), ("t", 4, 2, 4, 3, "c"), ("t", 4, 2, 4, 4, "d"), ("t", 5, 3, 4, 4, None), ("t", 6, 3, 4, 4, None), ("t", 7, 9, 10, None, "x")]
    df = spark.createDataFrame(rows, "tenant string, page long, from_cursor long, next_cursor long, cursor long, payload string")
    got = queues.ingest_changes(df, spark.createDataFrame([], "tenant string, cursor long, payload string"))
    assert [x.verdict for x in got.orderBy("page").collect()] == ["append", "append", "replay", "reject", "append", "replay", "reject"]


@pytest.mark.parametrize("bucket", [1, 3, 8, 1000])
def test_frontiers_and_gaps_over_buckets(spark, bucket):
    r = random.Random(bucket)
    rows, confirmed = [], []
    for t in range(12):
        start, hole = r.choice([0, 0, 5, 17]), r.choice([0, 1, 7, 8, 9, 24, 200])
        confirmed.append((t, start))
        rows += [(t, c, r.choice([True, True, None])) for c in range(1, 40) if c != start + hole for _ in range(r.choice([1, 2]))] if t else []
        rows += [(t, c, True) for c in range(1, 40) if t % 3 and c != start + hole]
    applied = {}
    for t, c, a in rows:
        applied[t, c] = applied.get((t, c), False) or bool(a)
    want = {}
    for t, start in confirmed:
        at = start
        while applied.get((t, at + 1)):
            at += 1
        want[t] = at
    inbox = spark.createDataFrame(rows, "tenant long, cursor long, applied boolean")
    got = history.contiguous_frontier(inbox, spark.createDataFrame(confirmed, "tenant long, confirmed long"), bucket)
    assert {x.tenant: x.frontier for x in got.collect()} == want
    log = spark.createDataFrame([(t, c) for t in range(4) for c in r.sample(range(1, 60), 25)] + [(9, 1), (9, 1), (9, None)], "tenant long, cursor long")
    gaps = sorted(tuple(x) for x in history.cursor_gap_report(log, bucket).collect())
    held = {}
    for t, c in log.where("cursor IS NOT NULL").collect():
        held.setdefault(t, {0}).add(c)
    want = sorted((t, a + 1, b - 1) for t, cs in held.items() for a, b in zip(sorted(cs), sorted(cs)[1:]) if b > a + 1)
    assert gaps == want


def test_duplicate_operations(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "z", 4), ("b", "z", 9), ("b", None, 5), ("b", None, 6)], "tenant string, operation_id string, cursor long")
    got = sorted(tuple(x) for x in history.duplicate_operations(log).collect())
    assert got == [("a", "x", 2, 1, 1, 1), ("b", "z", 2, 2, 4, 9)]


def test_numbers_over_many_tasks(spark):
    """A key that most rows share, and many small ones, sorted in more tasks than keys."""
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.randint(0, 50), r.random() < 0.3, i) for i in range(3000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = planning.numbered(spark.createDataFrame(rows, "k string, v long, m boolean, i long"), "k", ["v", "i"], "place", F.col("m")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for k in ("hot", "a", None):
        mine = sorted((v, i, m) for x, v, m, i in rows if x == k)
        assert sorted((x.place, x.v, x.i) for x in got if x.k == k) == [(n, v, i) for n, (v, i, _) in enumerate(mine, 1)]
        assert {(x.n_all, x.n_marked) for x in got if x.k == k} == {(len(mine), sum(m for *_, m in mine))}


def test_known_routes_and_percentiles(spark):
    routes = ("/healthz", "/v1/blobs/{hash}", "/v1/a.b/{id}/c")
    paths = {"/healthz": 0, "/healthz/": None, "/v1/blobs/x": 1, "/v1/blobs/": None, "/v1/blobs/x/y": None, "/v1/blobs/x\n": 1, "/v1/a.b/7/c": 2, "/v1/axb/7/c": None, "": None, None: None, "/V1/blobs/x": None}
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("route", content.known_route(F.col("path"), routes))
    assert {x.path: x.route for x in df.collect()} == {p: "unknown" if k is None else routes[k] for p, k in paths.items()}
    rows = [(f"2024-01-01 00:00:{i % 60:02d}", f"/v1/blobs/{i}", i, 500 if i % 10 == 0 else 499) for i in range(101)] + [("2024-01-01 00:01:00", "/x", None, None)]
    log = spark.createDataFrame(rows, "ts string, path string, ms long, status int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((x.route, x.n_requests, x.n_failed, x.error_rate, x.p50, x.p95, x.p99) for x in content.route_report(log, routes, "ts", "path", "ms", "status").collect())
    assert got == [("/v1/blobs/{hash}", 101, 11, round(11 / 101, 6), 50.0, 95.0, 99.0), ("unknown", 1, 0, 0.0, None, None, None)]


def test_recovery_names(spark):
    rows = [("o1", "p", "Plan"), ("o2", "p", "ä" * 120), ("o3", None, ""), ("o4", "q", "Plan"), ("o5", "p", "a/b"), ("o6", "p", "x"), ("o7", "p", "Straße (neu)")]
    end = " (Wiederhergestellt - {})"
    taken = [("p", "plan" + end.format("o1")), ("p", "PLAN" + end.format("o1") + "-1"), ("p", "Plan" + end.format("o1") + "-3"), ("q", "Plan" + end.format("o1") + "-2")]
    taken += [("p", "ä" * 77 + end.format("o2")), (None, end.format("o3")), ("p", "Plan" + end.format("o4")), ("p", "STRASSE (NEU)" + end.format("o7")), ("p", None)]
    taken += [("p", "x" + end.format("o6") + (f"-{k}" if k else "")) for k in range(5)]
    names = spark.createDataFrame(rows, "operation_id string, parent_id string, stem string")
    got = {x.operation_id: (x.name, x.number) for x in planning.recovery_names(names, spark.createDataFrame(taken, "parent_id string, name string"), most=4).collect()}
    room = lambda op, k: (180 - len((end.format(op) + k).encode())) // 2
    assert room("o2", "") == 77
    assert got == {
        "o1": ("Plan" + end.format("o1") + "-2", 2), "o2": ("ä" * room("o2", "-1") + end.format("o2") + "-1", 1), "o3": (end.format("o3") + "-1", 1), "o4": ("Plan" + end.format("o4"), 0),
        "o5": (None, None), "o6": (None, None), "o7": ("Straße (neu)" + end.format("o7") + "-1", 1),
    }


def test_logical_bytes(spark):
    docs = spark.createDataFrame([("a", "xx"), ("a", "xx"), ("a", "é"), ("b", ""), ("b", None), ("c", None), (None, "x")], "t string, text string")
    assert {tuple(x) for x in content.logical_bytes(docs, "t", "text").collect()} == {("a", 6, 4, 3, 2), ("b", 0, 0, 1, 1), (None, 1, 1, 1, 1)}
