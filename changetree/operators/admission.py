"""Sequential admission: mutations decided one after the other against the state that the ones before them left.

admit() is one step; what it needs of a tenant's state is behind the methods of Memory, so that batch and stream decide
alike. A tenant's mutations are decided in order by one task, which reads them as a stream and holds the tenant's objects, not its
mutations: dense cursors and replays make a tenant serial by nature. Tenants are dealt out over all tasks."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import collision_key
from .content import PATH_BYTES

#: Folders above a target at most.
MOST_DEPTH = 10_000


class Reserved(NamedTuple):
    """A folder that a tenant's first conflict provides, and roots that no path may begin with, as collision keys."""

    root_id: str = "conflict-root"
    root_name: str = "_conflicts"
    inner_id: str = "conflict-recovered"
    inner_name: str = "recovered"
    barred: tuple[str, ...] = ("_conflicts",)
    provide: bool = True


class Object(NamedTuple):
    type: str
    revision: int
    parent_id: str | None
    name: str
    name_key: str
    blob_hash: str | None
    deleted: bool


class Outcome(NamedTuple):
    """result: accepted, conflict, or one that leaves no trace (replay_mismatch, blob_unavailable, invalid). code is a conflict's
    ground; the state is the new version of an accepted mutation, or the standing one that a conflict met."""

    operation_id: str
    sequence: int | None
    result: str
    code: str | None
    replayed: bool
    cursor: int | None
    object_id: str
    mutation: str
    state: Object | None


class Memory:
    """A tenant's state in dictionaries: objects, active children and names below each parent, operations, the last cursor."""

    def __init__(self):
        self.objects: dict[str, Object] = {}
        self.below: dict[str | None, dict[str, str]] = {}  # parent -> object -> key of the active ones
        self.holders: dict[tuple[str | None, str], str] = {}
        self.operations: dict[str, tuple[str, Outcome]] = {}
        self.cursor = 0

    def get(self, object_id: str) -> Object | None:
        return self.objects.get(object_id)

    def put(self, object_id: str, now: Object) -> None:
        was = self.objects.get(object_id)
        if was and not was.deleted:
            self.below[was.parent_id].pop(object_id, None)
            if self.holders.get((was.parent_id, was.name_key)) == object_id:
                del self.holders[was.parent_id, was.name_key]
        self.objects[object_id] = now
        if not now.deleted:
            self.below.setdefault(now.parent_id, {})[object_id] = now.name_key
            self.holders[now.parent_id, now.name_key] = object_id

    def holder(self, parent_id: str | None, name_key: str) -> str | None:
        return self.holders.get((parent_id, name_key))

    def children(self, object_id: str):
        return self.below.get(object_id, ())

    def operation(self, operation_id: str) -> tuple[str, Outcome] | None:
        return self.operations.get(operation_id)

    def remember(self, digest: str, outcome: Outcome) -> None:
        self.operations[outcome.operation_id] = (digest, outcome)

    def next_cursor(self) -> int:
        self.cursor += 1
        return self.cursor


def _path(store, parent_id: str | None, name: str) -> list[str] | None:
    """The names from the root to the target; None if an ancestor isn't an active folder or there are too many."""
    parts = [name]
    while parent_id is not None:
        parent = store.get(parent_id)
        if parent is None or parent.deleted or parent.type != "folder" or len(parts) > MOST_DEPTH:
            return None
        parts.append(parent.name)
        parent_id = parent.parent_id
    return parts[::-1]


def _fits(store, row, current: Object | None, reserved: Reserved, key_of) -> bool:
    """Whether the target's path, and after a folder's move all paths below it, are short enough and begin with no reserved root."""
    parts = _path(store, row.parent_id, row.name)
    if parts is None:
        return False
    inside = len(parts) >= 3 and parts[:2] == [reserved.root_name, reserved.inner_name]
    length = len("/".join(parts).encode())
    if length > PATH_BYTES or (not inside and key_of(parts[0]) in reserved.barred):
        return False
    if row.kind == "move" and current.type == "folder":
        waiting = [(iter(store.children(row.object_id)), length)]  # one open list of children for each level
        while waiting:
            children, above = waiting[-1]
            child = next(children, None)
            if child is None:
                waiting.pop()
                continue
            length = above + 1 + len(store.get(child).name.encode())
            if length > PATH_BYTES or (inside and key_of(parts[0]) in reserved.barred):  # paths below are held to the plain rule
                return False
            waiting.append((iter(store.children(child)), length))
    return True


def _conflict(store, row, current: Object | None, reserved: Reserved, key_of) -> str | None:
    """The first ground for a conflict, 'invalid', or None. The order of the rules is their meaning."""
    if row.kind == "create":
        if current:
            return "object_exists"
    elif not current:
        return "object_missing"
    elif current.deleted:
        return "object_deleted"
    elif current.type != row.type:
        return "type_mismatch"
    elif current.revision != row.base_revision:
        return "base_revision_mismatch"
    if row.kind in ("create", "move"):
        if row.parent_id is not None:
            parent = store.get(row.parent_id)
            if not parent or parent.deleted or parent.type != "folder":
                return "parent_unavailable"
        if row.kind == "move" and current.type == "folder":
            above, steps = row.parent_id, 0
            while above is not None and steps < MOST_DEPTH:
                if above == row.object_id:
                    return "folder_cycle"
                folder = store.get(above)
                above, steps = folder.parent_id if folder else None, steps + 1
        if not _fits(store, row, current, reserved, key_of):
            return "invalid"
        if store.holder(row.parent_id, row.name_key) not in (None, row.object_id):
            return "path_collision"
    if row.kind == "delete" and current.type == "folder" and len(store.children(row.object_id)):
        return "folder_not_empty"
    return None


def _provided(store, reserved: Reserved, key_of) -> list[Outcome]:
    """The reserved folders that the tenant doesn't have yet, as accepted creates."""
    out = []
    for object_id, parent_id, name in ((reserved.root_id, None, reserved.root_name), (reserved.inner_id, reserved.root_id, reserved.inner_name)):
        if reserved.provide and store.get(object_id) is None:
            now = Object("folder", 1, parent_id, name, key_of(name), None, False)
            store.put(object_id, now)
            out.append(Outcome(f"provide-{object_id}", None, "accepted", None, False, store.next_cursor(), object_id, "create", now))
    return out


def admit(store, row, reserved: Reserved, key_of) -> list[Outcome]:
    """What one mutation leads to: the folders it provides, then its own outcome."""
    known = store.operation(row.operation_id)
    if known:
        if known[0] == row.digest:
            return [known[1]._replace(replayed=True, sequence=row.sequence)]
        return [Outcome(row.operation_id, row.sequence, "replay_mismatch", None, False, None, row.object_id, row.kind, None)]
    if row.object_id in (reserved.root_id, reserved.inner_id):
        return [Outcome(row.operation_id, row.sequence, "invalid", None, False, None, row.object_id, row.kind, None)]
    if row.kind in ("create", "update") and row.type == "note" and not row.blob_available:
        return [Outcome(row.operation_id, row.sequence, "blob_unavailable", None, False, None, row.object_id, row.kind, None)]
    current = store.get(row.object_id)
    code = _conflict(store, row, current, reserved, key_of)
    if code == "invalid":
        return [Outcome(row.operation_id, row.sequence, "invalid", None, False, None, row.object_id, row.kind, None)]
    if code:
        out = _provided(store, reserved, key_of)
        own = Outcome(row.operation_id, row.sequence, "conflict", code, False, None, row.object_id, row.kind, current)
    else:
        if row.kind == "create":
            now = Object(row.type, 1, row.parent_id, row.name, row.name_key, row.blob_hash, False)
        elif row.kind == "update":
            now = current._replace(revision=current.revision + 1, blob_hash=row.blob_hash)
        elif row.kind == "move":
            now = current._replace(revision=current.revision + 1, parent_id=row.parent_id, name=row.name, name_key=row.name_key)
        else:
            now = current._replace(revision=current.revision + 1, deleted=True)
        store.put(row.object_id, now)
        out, own = [], Outcome(row.operation_id, row.sequence, "accepted", None, False, store.next_cursor(), row.object_id, row.kind, now)
    store.remember(row.digest, own)
    return [*out, own]


RECORDS = (
    "tenant string, operation_id string, sequence long, result string, code string, replayed boolean, cursor long, object_id string, mutation string, "
    "type string, revision long, parent_id string, name string, name_key string, blob_hash string, deleted boolean"
)
NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def records(tenant: str, outcomes: list[Outcome]) -> list[tuple]:
    """Outcomes as rows of RECORDS."""
    return [(tenant, *o[:8], *(o.state or (None,) * len(Object._fields))) for o in outcomes]


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of RECORDS, with nulls in whole numbers kept whole."""
    return pd.DataFrame(rows, columns=NAMES).astype({c: "Int64" for c in ("sequence", "cursor", "revision")} | {c: "boolean" for c in ("replayed", "deleted")})


def request_digest(policy: str) -> Column:
    """SHA-256 of a mutation's canonical JSON: fixed fields in fixed order, absent ones empty, with the characters that are
    unsafe in HTML escaped."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.struct(
        F.lit(policy).alias("Policy"), text("operation_id").alias("Operation"), text("kind").alias("Kind"), text("object_id").alias("Object"), text("type").alias("Type"),
        F.coalesce(F.col("base_revision"), F.lit(0)).cast("long").alias("Base"), text("parent_id").alias("Parent"), text("name").alias("Name"), text("blob_hash").alias("Blob"),
    )
    json = F.to_json(body)
    for sign in "&<>\u2028\u2029":
        json = F.replace(json, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.sha2(json.cast("binary"), 256)


def prepared(muts: DataFrame, blobs: DataFrame | None, policy: str) -> DataFrame:
    """muts with name_key, digest and blob_available, ready for admit()."""
    rows = muts.select(
        F.col("tenant").cast("string").alias("tenant"), F.col("sequence").cast("long").alias("sequence"), *("operation_id kind object_id type".split()),
        F.coalesce("base_revision", F.lit(0)).cast("long").alias("base_revision"), "parent_id", "name", "blob_hash",
    )
    rows = rows.withColumn("name_key", collision_key(F.col("name"))).withColumn("digest", request_digest(policy))
    if blobs is None:
        return rows.withColumn("blob_available", F.lit(True))
    held = blobs.select(F.col("tenant").cast("string").alias("tenant"), "blob_hash", F.lit(True).alias("held")).distinct()
    return rows.join(held, ["tenant", "blob_hash"], "left").withColumn("blob_available", F.coalesce("held", F.lit(False))).drop("held")


def _key_of(name: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())


def admit_mutations(muts: DataFrame, blobs: DataFrame | None = None, objects: DataFrame | None = None, reserved: Reserved = Reserved(), policy: str = "intent-v1") -> DataFrame:
    """Rows of RECORDS: one for each of muts (tenant, sequence, operation_id, kind, object_id, type, base_revision, parent_id, name,
    blob_hash) and one for each reserved folder that a tenant's first conflict provides.

    muts have passed mutation_shape_check; of one tenant they are decided by sequence, then by operation_id. blobs (tenant, blob_hash) are those
    available, all if not given. objects (tenant, object_id, type, revision, parent_id, name, blob_hash, deleted, cursor) is the
    state at the start, with its largest cursor. An operation seen before gives what it gave (replayed) if its digest
    is the same, else replay_mismatch. Accepted mutations and provided folders take the tenant's next cursor; conflicts take
    none and carry the state they met. A path that is too long or reserved is invalid, not a conflict."""
    rows = prepared(muts, blobs, policy).withColumn("at_start", F.lit(False)).withColumn("cursor", F.lit(None).cast("long")).withColumn("deleted", F.lit(False))
    if objects is not None:
        null = lambda c: F.lit(None).cast("string").alias(c)
        rows = rows.unionByName(
            objects.select(
                F.col("tenant").cast("string").alias("tenant"), F.lit(0).cast("long").alias("sequence"), null("operation_id"), null("kind"), "object_id", "type",
                F.col("revision").cast("long").alias("base_revision"), "parent_id", "name", "blob_hash", collision_key(F.col("name")).alias("name_key"), null("digest"),
                F.lit(True).alias("blob_available"), F.lit(True).alias("at_start"), F.col("cursor").cast("long").alias("cursor"), "deleted",
            )
        )
    rows = rows.withColumn("cursor", F.coalesce("cursor", F.lit(0)))

    def run(batches):
        tenant, store = object(), Memory()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.tenant != tenant:
                    tenant, store = row.tenant, Memory()
                if row.at_start:
                    store.put(row.object_id, Object(row.type, row.base_revision, row.parent_id, row.name, row.name_key, row.blob_hash, row.deleted))
                    store.cursor = max(store.cursor, row.cursor)
                else:
                    out += records(tenant, admit(store, row, reserved, _key_of))
            yield frame(out)

    order = ["tenant", F.desc("at_start"), "sequence", "operation_id"]
    return rows.where("tenant IS NOT NULL").repartition("tenant").sortWithinPartitions(*order).mapInPandas(run, RECORDS)


def admitted_log(admitted: DataFrame) -> DataFrame:
    """The change log that admission wrote: one row for each cursor."""
    return admitted.where("result = 'accepted' AND NOT replayed").select("tenant", "cursor", "object_id", "revision", "operation_id", "mutation")


def admitted_versions(admitted: DataFrame) -> DataFrame:
    """The object versions that admission wrote."""
    return admitted.where("result = 'accepted' AND NOT replayed").select("tenant", *NAMES[7:8], *NAMES[9:], "operation_id")


def admitted_state(admitted: DataFrame) -> DataFrame:
    """The newest version of each object, with the cursor that wrote it."""
    last = W.partitionBy("tenant", "object_id").orderBy(F.desc("cursor"))
    rows = admitted.where("result = 'accepted' AND NOT replayed").withColumn("k", F.row_number().over(last)).where("k = 1")
    return rows.select("tenant", "object_id", *NAMES[9:], "cursor")
