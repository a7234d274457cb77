"""Operator 8, best-fit packing: linear grouping scheme.

Documents are tokenised and cut once; what planning needs of them is how many pieces each length has,
a table of at most `budget` rows whatever the input. On it, large lengths are rounded up within groups
of equal cardinality, the few sizes that result are packed by an optimal fractional choice of
configurations (column generation), actual lengths take the places of the rounded ones, and small
lengths go best-fit into what is left. A plan is a list of runs: so many pieces of one length, from this
rank on, fill sequences from this number on. Spark ranks the pieces within their length, by counts per
partition so that no length is gathered anywhere, and looks each rank up in the runs."""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, persisted, small_batches, table
from .token_counts import Counter, Remembered, default_tokenizer

#: Choices of (groups of equal cardinality, share of a sequence beyond which a length is large). A plan is
#: made of each, on the histogram, and the one with the fewest sequences is used.
CHOICES = [(16, 1 / 4), (48, 1 / 4), (48, 1 / 8), (128, 1 / 4)]

#: Words whose ids an idle worker keeps from one task to the next.
BETWEEN = 1 << 15


class Ids:
    """Token ids of texts as bytes, by the library: a text's ids are those of its words as the tokenizer splits them and of the
    added tokens' strings between them. Words are looked up, many texts at a time; only new ones are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.counter, self.known = Tokenizer.from_file(path), Counter(path), Remembered()
        self.added = regex.compile(f"({self.counter.added.pattern})")

    def words(self, text: str) -> list[str]:
        if "<" not in text:
            return self.counter.pieces(text)
        out = []
        for k, part in enumerate(self.added.split(text)):
            out += [part] if k % 2 else self.counter.pieces(part)
        return out

    def of_all(self, texts: list[str]) -> list[bytes]:
        parts = [self.words(t) for t in texts]
        found = iter(self.known.all([*chain.from_iterable(parts)], self.encode))
        return [b"".join(islice(found, len(x))) for x in parts]

    def encode(self, words: list[str]):
        """The ids of each word, many in one call. The library tells each id's word, or, where an added token's string is
        among them, where it begins."""
        for k in range(0, len(words), 1024):
            part = words[k : k + 1024]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            data, owners = np.array(got.ids, "<u4").tobytes(), got.word_ids
            if None in owners or owners[-1] != len(part) - 1:
                starts = np.fromiter((x for x, _ in got.offsets), np.int64, len(got.ids))
                cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in part)])) * 4
            else:
                cuts = np.searchsorted(np.array(owners), np.arange(len(part) + 1)) * 4
            yield from (data[a:b] for a, b in pairwise(cuts.tolist()))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def slabs(column, rows: int = 256):
    """The texts of an Arrow column (null: empty), few at a time."""
    for k in range(0, len(column), rows):
        yield [t or "" for t in column.slice(k, rows).to_pylist()]


def _cut(path: str, budget: int, end_id: int):
    """Arrow batches of (id, text) to pieces, each with its partition and its rank there within its length."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, ranks, ids = TaskContext.get().partitionId(), {}, ids_of(path)
        for batch in batches:
            at, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, data in enumerate(chain.from_iterable(map(ids.of_all, slabs(batch.column(1))))):
                data += tail
                for k in range(0, len(data), 4 * budget):
                    cut = data[k : k + 4 * budget]
                    n = len(cut) // 4
                    at.append(i), piece.append(k // (4 * budget)), start.append(k // 4), length.append(n), crc.append(zlib.crc32(cut)), rank.append(ranks.get(n, 0))
                    ranks[n] = rank[-1] + 1
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, [part] * len(at), rank))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        ids.known.trim(BETWEEN)
        give_back()

    return run


def best_configurations(sizes: list[int], demand: list[int], budget: int) -> list[tuple[int, list[int]]]:
    """(copies, items per size) of configurations that cover most of the demand: the basic optimal
    solution of the fractional problem, rounded down. Columns are priced by a knapsack."""
    n, want = len(sizes), np.array(demand, float)
    basis = np.diag([float(budget // s) for s in sizes])
    x = want / np.diag(basis)
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        value, took = np.zeros(budget + 1), []
        for _ in range(budget // min(sizes)):
            best, item = value.copy(), np.full(budget + 1, -1)
            for i, s in enumerate(sizes):
                new = value[:-s] + price[i]
                better = new > best[s:] + 1e-12
                best[s:][better], item[s:][better] = new[better], i
            took.append(item)
            value = best
        if value[budget] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), budget
        for item in reversed(took):
            if item[room] >= 0:
                column[item[room]] += 1
                room -= sizes[item[room]]
        turn = np.linalg.solve(basis, column)
        ratio = np.where(turn > 1e-9, x / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * turn, 0)
        x[out], basis[:, out] = ratio[out], column
    return [(int(c + 1e-7), [int(round(v)) for v in basis[:, k]]) for k, c in enumerate(x) if int(c + 1e-7)]


class Plan:
    """Runs (length, first rank, count, first sequence, items a sequence, offset); the items of a run go in
    rank order, so many to each sequence."""

    def __init__(self, counts: dict[int, int], budget: int, groups: int, large: float):
        self.budget, self.runs, self.sequences = budget, [], 0
        self.left, self.rank = dict(counts), dict.fromkeys(counts, 0)
        self.open: list[tuple[int, int, int, int]] = []  # (room, first sequence, copies, filled), by room
        if whole := self.left.pop(budget, 0):
            self.put(budget, whole, self.new(whole), 1, 0)
        self.configure(sorted((s for s in self.left if s > large * budget), reverse=True), groups)
        for s in sorted(self.left, reverse=True):
            self.best_fit(s)

    def new(self, copies: int) -> int:
        self.sequences += copies
        return self.sequences - copies

    def put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, sequence, each, offset))
        self.rank[length] += count

    def configure(self, lengths: list[int], groups: int) -> None:
        total = sum(self.left[s] for s in lengths)
        if not total:
            return
        bound, queues, held = -(-total // groups), [[]], 0
        for s in lengths:
            more = self.left[s]
            while more:
                take = min(more, bound - held)
                queues[-1].append([s, take])
                more, held = more - take, held + take
                if held == bound:
                    queues.append([])
                    held = 0
        queues = [q for q in queues if q]
        merged: dict[int, list] = {}  # groups of the same largest length are one size
        for q in queues:
            merged.setdefault(q[0][0], []).extend(q)
        sizes = [*merged]
        for copies, items in best_configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], self.budget):
            slots = [self.take(merged[s], copies) for s, k in zip(sizes, items) for _ in range(k)]
            copies = min([copies, *(sum(c for _, c in x) for x in slots)]) if slots else 0
            ends = sorted({e for x in slots for e in np.cumsum([c for _, c in x]).tolist() if e <= copies})
            first, done, at = self.new(copies), 0, [0] * len(slots)
            used = [0] * len(slots)
            for e in ends:
                m, filled = e - done, 0
                for i, x in enumerate(slots):
                    s = x[at[i]][0]
                    self.put(s, m, first + done, 1, filled)
                    self.left[s] -= m
                    filled += s
                    used[i] += m
                    if used[i] == x[at[i]][1]:
                        at[i], used[i] = at[i] + 1, 0
                self.keep(self.budget - filled, first + done, m, filled)
                done = e

    @staticmethod
    def take(queue: list, count: int) -> list[tuple[int, int]]:
        out = []
        while queue and count:
            s, c = queue[0]
            out.append((s, min(c, count)))
            count -= min(c, count)
            if c > out[-1][1]:
                queue[0][1] -= out[-1][1]
            else:
                queue.pop(0)
        return out

    def keep(self, room: int, first: int, copies: int, filled: int) -> None:
        if room and copies:
            bisect.insort(self.open, (room, first, copies, filled))

    def best_fit(self, s: int) -> None:
        """All that is left of one length, each time into the fullest sequences that can take it."""
        while self.left[s]:
            at = bisect.bisect_left(self.open, (s,))
            if at == len(self.open):
                each = self.budget // s
                copies = max(1, self.left[s] // each)
                room, first, filled = self.budget, self.new(copies), 0
            else:
                room, first, copies, filled = self.open.pop(at)
                each = room // s
            some = min(self.left[s], copies * each)
            each = min(each, some)
            full, rest = divmod(some, each)
            self.put(s, full * each, first, each, filled)
            self.keep(room - each * s, first, full, filled + each * s)
            if full < copies:
                if rest:
                    self.put(s, rest, first + full, rest, filled)
                    self.keep(room - rest * s, first + full, 1, filled + rest * s)
                self.keep(room, first + full + bool(rest), copies - full - bool(rest), filled)
            self.left[s] -= some


def best_plan(counts: dict[int, int], budget: int) -> Plan:
    return min((Plan(counts, budget, *choice) for choice in CHOICES), key=lambda p: p.sequences)


def pack(docs: DataFrame, tokenizer_path: str, budget: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the id column, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's, then end_id; only longer ones than budget are cut. A null or empty
    text is a document of end_id alone; a null id is carried as null; repeated rows are packed each by itself.
    An empty table gives an empty result. Sequences have no gaps and no overlaps."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = persisted(
        docs.select(id_col, text_col).mapInArrow(
            _cut(tokenizer_path, budget, end_id), f"id {id_type}, piece int, start long, length long, ids_crc32 long, part long, rank long"
        )
    )
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = persisted(counts.select("length", "part", "n", before.alias("before")))
    histogram = {r[0]: r[1] for r in offsets.groupBy("length").agg(F.sum("n")).collect()}  # at most `budget` rows
    runs = sorted(best_plan(histogram, budget).runs)
    firsts = np.array([(s << 44) + r for s, r, *_ in runs], np.int64)
    columns = np.array(runs, np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast((firsts, columns))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        firsts, runs = shared.value
        s, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(firsts, (s << 44) + r, side="right") - 1]
        k = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + k // run[:, 4], "offset": run[:, 5] + k % run[:, 4] * s})

    ranked = pieces.join(offsets.drop("n"), ["length", "part"]).withColumn("at", place("length", F.col("rank") + F.col("before")))
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
