"""Admission against golden rows and a plain model."""

import hashlib
import json
import random

from changetree.operators import admission as ad

COLUMNS = "tenant string, sequence long, operation_id string, kind string, object_id string, type string, base_revision long, parent_id string, name string, blob_hash string"


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame(rows, columns)


def golden():
    create = lambda o, name, parent=None, kind="folder", op=None: ("create", o, kind, 0, parent, name, "b1" if kind == "note" else None)
    steps = [
        create("A", "A"), create("B", "B", "A"), create("N", "One.md", "A", "note"), create("O", "Other.md", "A", "note"),
        create("A", "Again"),
        ("update", "missing", "note", 1, None, None, "b2"),
        ("update", "N", "note", 99, None, None, "b2"),
        create("C", "Child", "nowhere"),
        create("P", "One.md", "A", "note"),
        ("delete", "A", "folder", 1, None, None, None),
        ("move", "A", "folder", 1, "B", "A", None),
        ("update", "B", "note", 1, None, None, "b2"),
        ("delete", "N", "note", 1, None, None, None),
        ("update", "N", "note", 2, None, None, "b2"),
    ]
    return [("t", k, f"op{k:02}", *s) for k, s in enumerate(steps)]


def test_every_conflict_once(spark):
    rows = golden() + [("t", 90, "op11", "update", "B", "note", 1, None, None, "b2"), ("t", 91, "op11", "update", "B", "note", 2, None, None, "b2")]
    out = ad.admit_mutations(table(spark, rows)).collect()
    got = {r.sequence: r for r in out if r.sequence is not None}
    codes = ["object_exists", "object_missing", "base_revision_mismatch", "parent_unavailable", "path_collision", "folder_not_empty", "folder_cycle", "type_mismatch"]
    assert [got[k].code for k in range(4, 12)] == codes and got[13].code == "object_deleted"
    assert sum(r.result == "conflict" and not r.replayed for r in out) == 9
    log = ad.admitted_log(ad.admit_mutations(table(spark, rows))).collect()
    assert len(log) == 7 and sorted(r.cursor for r in log) == list(range(1, 8))
    assert {r.object_id: r.cursor for r in log if r.object_id.startswith("conflict")} == {"conflict-root": 5, "conflict-recovered": 6}
    met = got[11]
    assert (met.type, met.revision, met.name, met.parent_id, met.deleted) == ("folder", 1, "B", "A", False)
    again = got[90]
    assert (again.result, again.code, again.replayed, again.name) == ("conflict", "type_mismatch", True, "B") and got[91].result == "replay_mismatch"
    assert got[4].parent_id is None and got[5].type is None


def test_paths_blobs_and_reserved_roots(spark):
    long = "x" * 200
    rows = [("t", 0, "a0", "create", "d0", "folder", 0, None, long, None)]
    rows += [("t", k, f"a{k}", "create", f"d{k}", "folder", 0, f"d{k - 1}", long, None) for k in range(1, 4)]  # the fourth has 803 bytes
    rows += [
        ("t", 10, "b0", "create", "e0", "folder", 0, None, "y", None), ("t", 11, "b1", "create", "e1", "folder", 0, "e0", long, None),
        ("t", 12, "b2", "create", "e2", "note", 0, "e1", long, "h1"),
        ("t", 13, "b3", "move", "e0", "folder", 1, "d2", "y", None),  # itself fits, what lies below doesn't
        ("t", 14, "b4", "create", "r", "folder", 0, None, "_CONFLICTS", None), ("t", 15, "b5", "update", "e2", "note", 1, None, None, "h9"),
        ("t", 16, "b6", "create", "conflict-root", "folder", 0, None, "z", None), ("t", 17, "b7", "create", "e0", "folder", 0, None, "z", None),
        ("t", 18, "b8", "create", "in", "note", 0, "conflict-recovered", "kept.md", "h1"), ("t", 19, "b9", "create", "no", "note", 0, "conflict-root", "kept.md", "h1"),
        ("t", 20, "c0", "create", "É", "note", 0, None, "É.md", "h1"), ("t", 21, "c1", "create", "é", "note", 0, None, "e\u0301.MD", "h1"),
        ("u", 1, "b8", "create", "in", "note", 0, None, "kept.md", "h1"), (None, 1, "q", "create", "in", "note", 0, None, "kept.md", "h1"),
    ]
    out = ad.admit_mutations(table(spark, rows), blobs=table(spark, [("t", "h1"), ("t", "h1")], "tenant string, blob_hash string")).collect()
    got = {r.operation_id: r.code or r.result for r in out if r.tenant == "t"}
    assert got == {
        "a0": "accepted", "a1": "accepted", "a2": "accepted", "a3": "invalid", "b0": "accepted", "b1": "accepted", "b2": "accepted", "b3": "invalid", "b4": "invalid",
        "b5": "blob_unavailable", "b6": "invalid", "b7": "object_exists", "b8": "accepted", "b9": "invalid", "c0": "accepted", "c1": "path_collision",
        "provide-conflict-root": "accepted", "provide-conflict-recovered": "accepted",
    }
    assert [r.result for r in out if r.tenant == "u"] == ["blob_unavailable"] and len(out) == len(rows) + 1


class Model:
    """A tenant as one list of objects, searched anew for every question."""

    def __init__(self):
        self.objects, self.log, self.seen = [], 0, {}

    def find(self, i):
        return next((o for o in self.objects if o["id"] == i), None)

    def alive(self, **kw):
        return [o for o in self.objects if not o["deleted"] and all(o[k] == v for k, v in kw.items())]

    def above(self, i):
        out = []
        while i is not None and self.find(i) is not None:
            out.append(i)
            i = self.find(i)["parent"]
        return out

    def verdict(self, kind, i, type_, base, parent, name):
        o = self.find(i)
        if kind == "create" and o:
            return "object_exists"
        if kind != "create":
            for bad, code in ((o is None, "object_missing"), (o and o["deleted"], "object_deleted"), (o and o["type"] != type_, "type_mismatch"), (o and o["revision"] != base, "base_revision_mismatch")):
                if bad:
                    return code
        if kind in ("create", "move"):
            if parent is not None and not any(p["id"] == parent and p["type"] == "folder" for p in self.alive()):
                return "parent_unavailable"
            if kind == "move" and o["type"] == "folder" and i in self.above(parent):
                return "folder_cycle"
            if any(s["id"] != i and s["name"].lower() == name.lower() for s in self.alive(parent=parent)):
                return "path_collision"
        if kind == "delete" and type_ == "folder" and self.alive(parent=i):
            return "folder_not_empty"
        return None

    def submit(self, op, kind, i, type_, base, parent, name, blob):
        request = (kind, i, type_, base, parent, name, blob)
        if op in self.seen:
            return [(op, *self.seen[op][1])] if self.seen[op][0] == request else [(op, "replay_mismatch", None, None, None)]
        code, out = self.verdict(kind, i, type_, base, parent, name), []
        if code:
            for r, p, n in (("conflict-root", None, "_conflicts"), ("conflict-recovered", "conflict-root", "recovered")):
                if not self.find(r):
                    self.objects.append({"id": r, "type": "folder", "revision": 1, "parent": p, "name": n, "deleted": False})
                    self.log += 1
                    out.append((f"provide-{r}", "accepted", None, self.log, 1))
            met = self.find(i)
            own = ("conflict", code, None, met and met["revision"])
        else:
            o = self.find(i)
            if o is None:
                o = {"id": i, "type": type_, "revision": 0, "parent": parent, "name": name, "deleted": False}
                self.objects.append(o)
            o["revision"] += 1
            if kind == "move":
                o |= {"parent": parent, "name": name}
            o["deleted"] = kind == "delete"
            self.log += 1
            own = ("accepted", None, self.log, o["revision"])
        self.seen[op] = (request, own)
        return [*out, (op, *own)]


def random_rows(seed, n=400, tenants=3):
    rng, rows = random.Random(seed), []
    for k in range(n):
        kind = rng.choices(["create", "update", "move", "delete"], [5, 3, 4, 2])[0]
        type_ = "note" if kind == "update" or rng.random() < 0.4 else "folder"
        placed = kind in ("create", "move")
        parent = rng.choice([None, *[f"o{x}" for x in range(14)]]) if placed else None
        blob = f"b{rng.randrange(9)}" if kind == "update" or (kind == "create" and type_ == "note") else None
        base = 0 if kind == "create" else rng.choice([1, 1, 1, 2, 2, 3])
        rows.append((f"t{rng.randrange(tenants)}", k, f"op{rng.randrange(n * 9 // 10)}", kind, f"o{rng.randrange(14)}", type_, base, parent, rng.choice(["a", "A", "b", "c", "d", "e"]) if placed else None, blob))
    return rows


def model_of(rows):
    models, out = {}, []
    for tenant, _, op, *rest in sorted(rows, key=lambda r: (r[1], r[2])):
        out += [(tenant, *x) for x in models.setdefault(tenant, Model()).submit(op, *rest)]
    return out


def key(x):
    return tuple((v is not None, v) for v in x)


def test_random_mutations_equal_a_model(spark):
    rows = [r for seed in range(4) for r in ((f"{seed}{t}", *rest) for t, *rest in random_rows(seed))]
    got = [(r.tenant, r.operation_id, r.result, r.code, r.cursor, r.revision) for r in ad.admit_mutations(table(spark, rows)).collect()]
    want = model_of(rows)
    assert {x[3] for x in want} >= {"object_exists", "object_missing", "object_deleted", "type_mismatch", "base_revision_mismatch", "parent_unavailable", "folder_cycle", "path_collision", "folder_not_empty"}
    assert sorted(got, key=key) == sorted(want, key=key)


def test_goes_on_from_a_state(spark):
    """The second half, decided from the state that the first half left, equals the whole; replays need the operations, so none repeat."""
    rows = [(*r[:2], f"op{k}", *r[3:]) for k, r in enumerate(random_rows(7))]
    first = ad.admit_mutations(table(spark, rows[:200]))
    later = ad.admit_mutations(table(spark, rows[200:]), objects=ad.admitted_state(first)).collect()
    whole = ad.admit_mutations(table(spark, rows)).collect()
    tail = [r for r in whole if r.sequence is not None and r.sequence >= 200]
    plain = lambda rs: sorted((tuple(r) for r in rs if r.sequence is not None), key=key)
    assert plain(later) == plain(tail)
    state = {(r.tenant, r.object_id): r.revision for r in ad.admitted_state(ad.admit_mutations(table(spark, rows))).collect()}
    versions = ad.admitted_versions(ad.admit_mutations(table(spark, rows))).collect()
    assert state == {(t, o): max(r.revision for r in versions if (r.tenant, r.object_id) == (t, o)) for t, o in {(r.tenant, r.object_id) for r in versions}}


def test_request_digest(spark):
    rows = [("t", 1, "op", "create", "o", "note", 0, None, 'Tom & "Ä"\u2028.md', "ab"), ("t", 2, "op", "delete", "o", "note", 3, None, None, None)]
    got = [r.d for r in table(spark, rows).orderBy("sequence").select(ad.request_digest("p1").alias("d")).collect()]
    for (_, _, op, kind, o, type_, base, parent, name, blob), d in zip(rows, got):
        body = {"Policy": "p1", "Operation": op, "Kind": kind, "Object": o, "Type": type_, "Base": base, "Parent": parent or "", "Name": name or "", "Blob": blob or ""}
        text = json.dumps(body, ensure_ascii=False, separators=(",", ":")).replace("&", "\\u0026").replace("\u2028", "\\u2028")
        assert d == hashlib.sha256(text.encode()).hexdigest()


class Map(dict):
    """A map state of the stream, as a dictionary."""

    getValue, containsKey, removeKey, updateValue = dict.get, dict.__contains__, dict.pop, dict.__setitem__


class Handle:
    """A tenant's state in memory."""

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Cursor()


class Cursor:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value


def test_stream_holds_neither_batch_nor_state(spark, monkeypatch):
    """One batch of a tenant comes back in small frames, equal to the batch, with rows sorted in small runs and few values kept; children are fetched."""
    import pandas as pd

    from changetree.streaming import admission as stream

    rows = [r for r in random_rows(5, n=1500, tenants=1)] + [("t0", None, "last", "create", "unordered", "folder", 0, None, "u", None)]
    rows = [("t", *r[1:]) for r in rows]
    want = ad.admit_mutations(table(spark, rows)).collect()
    pdf = ad.prepared(table(spark, rows), None, "intent-v1").toPandas().sample(frac=1, random_state=3)
    for name, value in (("MOST_KEPT", 3), ("GIVEN", 50)):
        monkeypatch.setattr(stream, name, value)
    monkeypatch.setattr(stream.in_order, "__defaults__", (70, 9))
    work = stream.Admission(ad.Reserved(), None)
    work.init(Handle())
    frames = list(work.handleInputRows(("t",), iter([pdf[k : k + 100] for k in range(0, len(pdf), 100)]), None))
    assert max(map(len, frames)) < 60 and len(frames) > 20
    got = [tuple(None if pd.isna(x) else x for x in r) for f in frames for r in f.itertuples(index=False, name=None)]
    assert sorted(got, key=key) == sorted(map(tuple, want), key=key)
    kept = stream.Kept(work.objects, work.holders, work.below, work.counts, work.operations, work.cursor)
    active = {i: o for (i,), o in work.objects.items() if not o[6]}
    for folder in {i for (i,) in work.objects}:
        assert sorted(kept.children(folder)) == sorted(i for i, o in active.items() if o[2] == folder)
    assert any(len(kept.children(i)) > 1 for i in active)
