"""Admission of a stream of mutations: the state that admit() needs lives in Spark's state store."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections import namedtuple
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.admission import RECORDS, Object, Outcome, Reserved, _key_of, admit, frame, prepared, records

OBJECT = "type string, revision long, parent_id string, name string, name_key string, blob_hash string, deleted boolean"
ANSWER = f"digest string, sequence long, result string, code string, cursor long, object_id string, mutation string, {', '.join(f'state_{c.strip()}' for c in OBJECT.split(','))}"


#: Values of a tenant's state that a task holds, rows that it sorts in memory and reads at once of each sorted run, and rows that it gives on at once.
MOST_KEPT, RUN, CHUNK, GIVEN = 50_000, 20_000, 100, 2_000


def in_order(frames: Iterable[pd.DataFrame], run: int = RUN, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of frames by sequence, then by operation_id, nulls first as in a batch. A stream can't be sorted by Spark, so a tenant's
    rows are: more than `run` of them lie as sorted runs in a temporary file of the task, which are merged a few rows at a time."""
    Row, rows, runs = None, [], []

    def order(row):
        a, b = row.sequence, row.operation_id
        return a is not None, a or 0, b is not None, b or ""

    def read(at: int, n: int):
        for _ in range(n):
            file.seek(at)
            some, at = pickle.load(file), file.tell()
            yield from map(Row._make, some)

    with tempfile.TemporaryFile() as file:
        for frame_ in frames:
            Row = Row or namedtuple("Row", frame_.columns)
            for row in frame_.astype(object).where(frame_.notna(), None).itertuples(index=False, name=None):
                rows.append(Row._make(row))
                if len(rows) == run:
                    rows.sort(key=order)
                    runs.append((file.tell(), -(-run // chunk)))
                    for k in range(0, run, chunk):
                        pickle.dump([tuple(r) for r in rows[k : k + chunk]], file)
                    rows = []
        rows.sort(key=order)
        yield from heapq.merge(*(read(*r) for r in runs), rows, key=order)


class Children:
    """The active children of a folder, numbered from 0; a fetch for each that is asked for."""

    def __init__(self, below, object_id: str, n: int):
        self._below, self._id, self._n = below, object_id, n

    def __len__(self) -> int:
        return self._n

    def __iter__(self) -> Iterator[str]:
        return (self._below.getValue((self._id, k))[0] for k in range(self._n))


class Kept:
    """The same as admission.Memory over state handles, which hold all of it: a bounded number of values is kept for a batch, so that most are fetched
    once. A folder's children are numbered, the last takes the place of one that leaves."""

    def __init__(self, objects, holders, below, counts, operations, cursor):
        self._objects, self._holders, self._below, self._counts, self._operations, self._cursor = objects, holders, below, counts, operations, cursor
        self._known: dict[str, tuple[Object, int | None] | None] = {}
        self._held: dict[tuple, str | None] = {}

    @staticmethod
    def _keep(kept: dict, key, value):
        if len(kept) >= MOST_KEPT:
            kept.clear()
        kept[key] = value
        return value

    @staticmethod
    def _slot(parent_id: str | None, name_key: str) -> tuple[str]:
        return ("" if parent_id is None else f"/{parent_id}/") + "\0" + name_key,

    def _placed(self, object_id: str) -> tuple[Object | None, int | None]:
        """An object and its number among its parent's children; none at a root or if deleted."""
        if object_id not in self._known:
            value = self._objects.getValue((object_id,)) if self._objects.containsKey((object_id,)) else None
            self._keep(self._known, object_id, (Object(*value[:-1]), value[-1]) if value else None)
        return self._known[object_id] or (None, None)

    def _write(self, object_id: str, now: Object, place: int | None) -> None:
        self._objects.updateValue((object_id,), (*now, place))
        self._keep(self._known, object_id, (now, place))

    def _count(self, parent_id: str) -> int:
        return self._counts.getValue((parent_id,))[0] if self._counts.containsKey((parent_id,)) else 0

    def get(self, object_id: str) -> Object | None:
        return self._placed(object_id)[0]

    def put(self, object_id: str, now: Object) -> None:
        was, place = self._placed(object_id)
        old, new = (None if x is None or x.deleted else x for x in (was, now))
        slots = [self._slot(x.parent_id, x.name_key) if x else None for x in (old, new)]
        if old and slots[0] != slots[1] and self.holder(old.parent_id, old.name_key) == object_id:
            self._holders.removeKey(slots[0])
            self._keep(self._held, slots[0], None)
        if place is not None and not (new and new.parent_id == old.parent_id):
            n = self._count(old.parent_id) - 1
            if place < n:
                last = self._below.getValue((old.parent_id, n))[0]
                self._below.updateValue((old.parent_id, place), (last,))
                self._write(last, self.get(last), place)
            self._below.removeKey((old.parent_id, n))
            self._counts.updateValue((old.parent_id,), (n,))
            place = None
        if new and new.parent_id is not None and place is None:
            place = self._count(new.parent_id)
            self._below.updateValue((new.parent_id, place), (object_id,))
            self._counts.updateValue((new.parent_id,), (place + 1,))
        self._write(object_id, now, place)
        if new and self.holder(new.parent_id, new.name_key) != object_id:
            self._holders.updateValue(slots[1], (object_id,))
            self._keep(self._held, slots[1], object_id)

    def holder(self, parent_id: str | None, name_key: str) -> str | None:
        slot = self._slot(parent_id, name_key)
        if slot not in self._held:
            self._keep(self._held, slot, self._holders.getValue(slot)[0] if self._holders.containsKey(slot) else None)
        return self._held[slot]

    def children(self, object_id: str) -> Children:
        return Children(self._below, object_id, self._count(object_id))

    def operation(self, operation_id: str) -> tuple[str, Outcome] | None:
        if not self._operations.containsKey((operation_id,)):
            return None
        digest, sequence, result, code, cursor, object_id, mutation, *state = self._operations.getValue((operation_id,))
        return digest, Outcome(operation_id, sequence, result, code, False, cursor, object_id, mutation, Object(*state) if state[0] is not None else None)

    def remember(self, digest: str, o: Outcome) -> None:
        self._operations.updateValue((o.operation_id,), (digest, o.sequence, o.result, o.code, o.cursor, o.object_id, o.mutation, *(o.state or (None,) * len(Object._fields))))

    def next_cursor(self) -> int:
        n = (self._cursor.get()[0] if self._cursor.exists() else 0) + 1
        self._cursor.update((n,))
        return n


class Admission(StatefulProcessor):
    """One tenant's admission; operations are remembered for remember_ms if given, else for good."""

    def __init__(self, reserved: Reserved, remember_ms: int | None):
        self.reserved, self.remember_ms = reserved, remember_ms

    def init(self, handle) -> None:
        self.objects = handle.getMapState("objects", "object_id string", f"{OBJECT}, place long")
        self.holders = handle.getMapState("holders", "slot string", "object_id string")
        self.below = handle.getMapState("below", "parent_id string, place long", "object_id string")
        self.counts = handle.getMapState("counts", "parent_id string", "n long")
        self.operations = handle.getMapState("operations", "operation_id string", ANSWER, self.remember_ms)
        self.cursor = handle.getValueState("cursor", "cursor long")

    def handleInputRows(self, key, rows, timerValues):
        store = Kept(self.objects, self.holders, self.below, self.counts, self.operations, self.cursor)
        out = []
        for row in in_order(rows):
            out += records(key[0], admit(store, row, self.reserved, _key_of))
            if len(out) >= GIVEN:
                yield frame(out)
                out = []
        yield frame(out)

    def close(self) -> None:
        pass


def stream_admission(muts: DataFrame, blobs: DataFrame | None = None, reserved: Reserved = Reserved(), policy: str = "intent-v1", remember_ms: int | None = None) -> DataFrame:
    """admit_mutations of a stream: rows of RECORDS as they are decided. blobs is a static table. Of a tenant the mutations of one batch are
    decided by sequence, and batches as they come, so an order over batches is the source's. A task holds a bounded number of rows and of
    state values; a larger batch of one tenant lies in a temporary file meanwhile. The session's state store provider must be RocksDB (see jobs.to_table)."""
    rows = prepared(muts, blobs, policy).where("tenant IS NOT NULL")
    mode = "None" if remember_ms is None else "ProcessingTime"
    return rows.groupBy("tenant").transformWithStateInPandas(Admission(reserved, remember_ms), RECORDS, "Append", mode)
