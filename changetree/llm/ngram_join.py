"""Operator 1, n-gram Jaccard join: T-occurrence search with DivideSkip.

Two sets of sizes n and m link only if they share T = ceil(t (n + m) / (1 + t)) shingles. Shingles are
put in one order in which frequent ones come last, so that the T - 1 longest inverted lists of a set
are those of its last shingles: the lists of the first ones, the short lists, are merged, and every
pair that can link meets in one of them. In Spark the short lists are one shuffle by shingle; pairs that meet too
rarely to reach T are dropped, and the others are settled in tasks by DivideSkip over the whole sets: a heap
merges the short lists and the long ones are probed by binary search.

Texts with equal sets are one class from the start. In a list each class is first compared with
the list's most central one only; what links to it is connected, so a group of many near copies costs in proportion to its
size. Then every two texts of a list that are still in different components are counted, in cells of bounded size.
No links are lost: a link is left unchecked only between texts that other links connect already."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build_filter, held_in
from .common import dropped, free_name, give_back, persisted, small_batches, table
from .components import components
from .words import column_texts, mix, shingle_set, texts_words

U = np.uint64
#: Similarity in percent.
SIMILAR = 80
#: Shingles that go last in the order, at most; they are broadcast (12 MB). Any order gives the same links.
MOST_FREQUENT = 1 << 20
#: A shingle is counted as frequent where so many different sets of one batch hold it.
FREQUENT_IN_BATCH = 2
#: Shingles in such a batch, about.
FREQUENT_BATCH = 1 << 21
#: Lists of more rows are paired in cells, by blocks of about so many rows.
CELL = 512
#: The list of a shingle counted more often is dealt out in parts of about so many rows before it is first gathered.
PART = 1 << 16
#: Pairs that a task holds to add up their counts.
PAIRS_HELD = 1 << 19
#: Bits at most (8 MB) of the filters of the ids whose texts or sketches are read again, and of the copies.
FILTER_BITS = 1 << 26


def required(n: int, m: int, percent: int = SIMILAR) -> int:
    """The least overlap at which sets of n and m shingles reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = SIMILAR) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _frequent(width: int):
    def run(batches):
        for batch in batches:
            sets, held = {}, 0
            for k, words in enumerate(texts_words(column_texts(batch.column(0))), 1):
                s = shingle_set(words, width)
                held += len(s)
                sets.setdefault(_set_digest(s), s)
                if held > FREQUENT_BATCH or k == len(batch):
                    token, n = np.unique(np.concatenate([*sets.values()]), return_counts=True)
                    often = n >= FREQUENT_IN_BATCH
                    yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often])], ["token", "n"])
                    sets, held = {}, 0
        give_back()

    return run


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles in order, their ranks by count, their counts) of the most frequent ones, MOST_FREQUENT at most. The
    cut is a power of two of the count, found on a histogram of 64 rows."""
    counts = persisted(texts.mapInArrow(_frequent(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()
    cut, held = 64, 0
    for level, n in sorted(map(tuple, levels), reverse=True):
        if held + n > MOST_FREQUENT:
            break
        cut, held = level, held + n
    rows = counts.where(F.floor(F.log2("n")) >= cut).toArrow()
    token, n = rows["token"].to_numpy().view(U), rows["n"].to_numpy()
    order = np.argsort(token)
    ranks = np.empty(len(token), np.int32)
    ranks[np.lexsort((token, n))] = np.arange(len(token))
    dropped(counts)
    return token[order], ranks[order], n[order]


def parity_sketch(s: np.ndarray) -> bytes:
    """A bit for each of about 2 n hash cells: whether an odd number of elements fall into it. Two sketches
    differ in at most as many bits as their sets differ in elements."""
    bits = 1 << max(6, (2 * len(s)).bit_length())
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements that are in one of two sets only; the longer sketch is folded."""
    a, b = (np.frombuffer(z, np.uint8) for z in ((x, y) if len(x) >= len(y) else (y, x)))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(batches):
    for pdf in batches:
        rows = zip(pdf["x"], pdf["y"], pdf["na"].tolist(), pdf["nb"].tolist())
        yield pdf[["a", "b"]][np.array([least_difference(x, y) <= na + nb - 2 * required(na, nb) for x, y, na, nb in rows], bool)]


def _keys(width: int, shared):
    """Arrow batches of (id, text) to (id, n, a, b, prefix, sketch): set size, digest, first shingles in the
    order, parity sketch."""

    def run(batches):
        frequent, ranks = shared.value
        for batch in batches:
            n, a, b, prefix, sketch = [], [], [], [], []
            for words in texts_words(column_texts(batch.column(1))):
                s = shingle_set(words, width)
                p = prefix_length(len(s))
                if len(frequent) and p:
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    first = s[~late][:p]
                    if len(first) < p:
                        first = np.concatenate((first, s[late][np.argsort(ranks[at[late]])][: p - len(first)]))
                else:
                    first = s[:p]
                d = _set_digest(s)
                n.append(len(s)), a.append(d[0]), b.append(d[1]), prefix.append(first.tobytes()), sketch.append(parity_sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())], ["id", "n", "a", "b", "prefix", "sketch"])
        give_back()

    return run


def _postings(shared):
    """Arrow batches of (id, n, prefix) to (token, part, id, n, place); place is the shingle's in its set, from 0. The list of a very frequent shingle is dealt out in
    parts, numbered from 1; others have part 0."""

    def run(batches):
        often, parts = shared.value
        for batch in batches:
            tokens = [np.frombuffer(x, U) for x in batch.column(2).to_pylist()]
            lengths = [len(x) for x in tokens]
            ids, n = (np.repeat(batch.column(k).to_numpy(), lengths) for k in (0, 1))
            flat = np.concatenate([np.empty(0, U), *tokens])
            place = np.concatenate([np.empty(0, np.int32), *(np.arange(k, dtype=np.int32) for k in lengths)])
            part = np.zeros(len(flat), np.int32)
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                hit = often[at] == flat
                part[hit] = 1 + mix(ids[hit].view(U)) % parts[at[hit]].astype(U)
            for k in range(0, len(flat), 1 << 16):
                cut = slice(k, k + (1 << 16))
                columns = [pa.array(flat[cut].view(np.int64)), pa.array(part[cut]), pa.array(ids[cut]), pa.array(n[cut]), pa.array(place[cut])]
                yield pa.RecordBatch.from_arrays(columns, ["token", "part", "id", "n", "place"])

    return run


def _shared_lists(batches):
    """Rows sorted by (token, part, id): those of lists with two rows or more, and all that have a part. Only the last
    row is kept from one batch to the next."""
    names, last, told = ["token", "part", "id", "n", "place"], None, True
    for pdf in batches:
        rows = pdf[names].to_numpy(np.int64)
        if not len(rows):
            continue
        if last is not None:
            rows = np.concatenate((last[None], rows))
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (rows[:, 1] > 0)
        fresh = shared.copy()
        if last is not None and told:
            fresh[0] = False
        yield pd.DataFrame(rows[fresh], columns=names)
        told = bool(shared[-1])
        last = rows[-1]


def _stars(batches):
    """Rows (token, part, bucket, id, n) sorted so that the most central comes first: each other one with it."""
    key = head = size = None
    for pdf in batches:
        t, p, s, i, n = (pdf[c].to_numpy(np.int64) for c in ("token", "part", "bucket", "id", "n"))
        if not len(t):
            continue
        new = np.concatenate(([key != (t[0], p[0], s[0])], (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
        heads, sizes = np.where(first < 0, head or 0, i[first]), np.where(first < 0, size or 0, n[first])
        out = heads != i
        yield pd.DataFrame({"a": heads[out], "b": i[out], "na": sizes[out], "nb": n[out]})
        key, head, size = (t[-1], p[-1], s[-1]), heads[-1], sizes[-1]


def _met_pairs(batches):
    """Arrow batches of (token, cell, block, once, id, n, place, component), sorted by token and cell, to pairs (a, b): those of a
    cell that lie in different components and can link if this shingle is the first they share, which leaves
    each of them as many shingles from this place on as the pair has to share. A cell has a bounded number of rows; rows
    of the last one are carried on from batch to batch."""
    names = ["token", "cell", "block", "once", "id", "n", "place", "component"]
    held = {c: np.empty(0, np.int64) for c in names}
    found, size = [], 0

    def met(cut: int):
        """Pairs of the first cut rows, which are whole cells: each row with the next, the one after it, and so on."""
        t, cell, block, once, i, n, place, comp = (held[c][:cut] for c in names)
        left, step = np.arange(cut), 0
        while len(left):
            step += 1
            left = left[left + step < cut]
            right = left + step
            same = (t[left] == t[right]) & (cell[left] == cell[right])
            left, right = left[same], right[same]
            need = required(n[left], n[right])
            fits = (n[left] - place[left] >= need) & (n[right] - place[right] >= need)
            fits &= (comp[left] != comp[right]) & ((once[left] == 1) | (block[left] != block[right]))
            x, y = i[left[fits]], i[right[fits]]
            if len(x):
                yield np.stack((np.minimum(x, y), np.maximum(x, y)))

    def told():
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
        for k in range(0, rows.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in rows], ["a", "b"])

    def taken(cut: int):
        nonlocal found, size
        for rows in met(cut):
            found.append(rows)
            size += rows.shape[1]
            if size > PAIRS_HELD:
                yield from told()
                found, size = [], 0

    for batch in batches:
        held = {c: np.concatenate((held[c], batch.column(k).to_numpy().astype(np.int64))) for k, c in enumerate(names)}
        new = np.flatnonzero((held["token"][1:] != held["token"][:-1]) | (held["cell"][1:] != held["cell"][:-1]))
        if len(new):
            cut = int(new[-1]) + 1
            yield from taken(cut)
            held = {c: x[cut:] for c, x in held.items()}
    yield from taken(len(held["id"]))
    if found:
        yield from told()
    give_back()


def in_cells(rows: DataFrame) -> DataFrame:
    """Lists (token, id, n, place, component) cut into cells of about 2 CELL rows at most, such that any two rows of a list that are in different
    components share exactly one cell. Lists of one component have none. A longer list is cut into blocks,
    those of its largest component apart from the others; that component's blocks meet the others only, so
    a list costs in proportion to its length times the number of rows outside of its largest component."""
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "k")
    lists = persisted(lists)
    rows = rows.join(lists, "token")
    short = rows.where(F.col("k") <= CELL).select("token", F.lit(0).alias("cell"), F.lit(0).alias("block"), F.lit(1).alias("once"), "id", "n", "place", "component")
    long = rows.where(F.col("k") > CELL)
    by_component = long.groupBy("token", "k", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = by_component.groupBy("token").agg(F.max(F.struct("m", "component")).alias("x"), F.max("k").alias("k"))
    largest = largest.select("token", F.col("x.component").alias("main"), F.ceil((F.col("k") - F.col("x.m")) / CELL).cast("int").alias("others"), F.ceil(F.col("x.m") / CELL).cast("int").alias("mains"))
    cut = long.join(persisted(largest), "token").withColumn("is_main", F.col("component") == F.col("main"))
    own = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("id"), "mains")).otherwise(F.pmod(F.xxhash64("id"), "others")).cast("int")
    partner = F.explode(F.when(F.col("is_main"), F.expr("sequence(0, others - 1)")).otherwise(F.expr("sequence(0, others + mains - 1)")))
    cut = cut.withColumn("block", own).withColumn("partner", partner)
    cut = cut.select(
        "token", (F.least("block", "partner") * (F.col("others") + F.col("mains")) + F.greatest("block", "partner")).alias("cell"), "block",
        (F.col("block") == F.col("partner")).cast("int").alias("once"), "id", "n", "place", "component",
    )
    return short.unionByName(cut)


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], need: list[int], mu: float = 0.05) -> list[int]:
    """For each candidate set its overlap with the query, or -1 below what it needs. The inverted lists of
    the query's elements hold candidates' numbers in order; the longest ones are only probed."""
    sizes = [len(c) for c in candidates]
    flat, owner = np.concatenate(candidates), np.repeat(np.arange(len(candidates)), sizes)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    lists = sorted((x.tolist() for x in np.split(owner[order], cuts) if len(x)), key=len)
    least = max(1, min(need))
    n_long = min(least - 1, int(least / (mu * math.log2(1 + len(candidates)) + 1)), len(lists))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = [-1] * len(candidates)
    for c, run in groupby(heapq.merge(*short)):
        count, left = sum(1 for _ in run), len(long)
        for x in long:
            if count + left < need[c]:
                break
            k = bisect_left(x, c)
            count += k < len(x) and x[k] == c
            left -= 1
        if count >= need[c]:
            out[c] = count
    return out


def _verify(batches):
    """Arrow batches of (a, b, set_a, set_b), each run of equal a as one query, to the pairs that link; sets are read in place."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in range(2))
        set_of = lambda k, i: np.frombuffer(batch.column(k)[int(i)].as_buffer(), U)
        order, out = np.argsort(a, kind="stable"), []
        for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else []:
            query = set_of(2, run[0])
            for k in range(0, len(run), 256):
                part = run[k : k + 256]
                sets = [set_of(3, i) for i in part]
                found = divide_skip(query, sets, [max(1, required(len(query), len(s))) for s in sets])
                out += [i for i, n in zip(part, found) if n > 0]
        yield pa.RecordBatch.from_arrays([pa.array(x[np.array(out, np.int64)], pa.int64()) for x in (a, b)], ["a", "b"])
    give_back()


def _sets(width: int, shared):
    """Arrow batches of (id, text, h) to (id, set) of the rows whose h the filter may hold and whose set isn't empty."""

    def run(batches):
        for batch in batches:
            wanted = batch.filter(pa.array(held_in(shared.value, batch.column(2).to_numpy())))
            for k in range(0, len(wanted), 256):
                part = wanted.slice(k, 256)
                sets = [shingle_set(w, width).tobytes() for w in texts_words(part.column(1).to_pylist())]
                solid = pa.array([bool(x) for x in sets], pa.bool_())  # an id may have an empty text beside another
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"]).filter(solid)
        give_back()

    return run


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A filter of the column h with some ten bits for each row, FILTER_BITS at most."""
    return build_filter(hashes, min(FILTER_BITS, max(1 << 16, 1 << (10 * hashes.count()).bit_length())))


def probed(rows: DataFrame, shared, held: bool) -> DataFrame:
    """Rows whose h the filter may hold, or those whose h it surely lacks, without h."""
    kept = [c for c in rows.columns if c != "h"]

    def run(batches):
        for batch in batches:
            found = held_in(shared.value, batch.column("h").to_numpy())
            yield batch.filter(pa.array(found == held)).select(kept)

    return rows.select(*kept, "h").mapInArrow(run, rows.select(*kept).schema)


class Verifier:
    """Settles candidate pairs (a, b): those that link. Parity sketches, a thirtieth of the sets' size, rule out pairs
    that differ too much; the others are settled over the whole sets. Texts are read again for the ids in
    question only: a Bloom filter of fixed size keeps most others from the join."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, width: int):
        self.texts, self.sketches, self.width = texts, sketches, width

    def __call__(self, pairs: DataFrame) -> DataFrame:
        asked = persisted(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        needed = asked.sparkSession.sparkContext.broadcast(filter_of(asked.select(F.xxhash64("id").alias("h"))))
        sketches = persisted(probed(self.sketches.withColumn("h", F.xxhash64("id")), needed, True).join(asked, "id", "left_semi"))
        x, y = (sketches.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(c)) for k, c in (("a", "x"), ("b", "y")))
        possible = persisted(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInPandas(_possible, "a long, b long"))
        ids = persisted(possible.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        known = ids.sparkSession.sparkContext.broadcast(build_filter(ids.select(F.xxhash64("id").alias("h")), FILTER_BITS))
        wanted = self.texts.withColumn("h", F.xxhash64("id"))
        if ids.count() > FILTER_BITS // 16:  # a full filter lets too many through
            wanted = wanted.join(ids, "id", "left_semi")
        sets = persisted(wanted.mapInArrow(_sets(self.width, known), "id long, set binary"))
        joined = possible.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        found = persisted(joined.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long").distinct())
        dropped(pairs, asked, sketches, possible, ids, sets)
        return found


def _enough(c: str, na: str, nb: str) -> str:
    """SQL: c common short-list shingles can still lead to the required overlap. What is common and not in both
    short parts lies behind one of them."""
    t = lambda n: f"ceil({SIMILAR} * {n} / 100)"
    return f"(100 * least({na}, {nb}) >= {SIMILAR} * greatest({na}, {nb}) AND {c} + greatest({t(na)}, {t(nb)}) - 1 >= ceil({SIMILAR} * ({na} + {nb}) / {100 + SIMILAR}))"


def links(texts: DataFrame, postings: DataFrame, sketches: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) between class representatives that connect exactly what links connect.

    postings has token, part, id, n, place of the representatives' short lists; texts has id, text; sketches id, n,
    sketch."""
    verify = Verifier(texts, sketches, width)
    dealt = postings.repartition("token", "part").sortWithinPartitions("token", "part", "id")
    lists = persisted(dealt.mapInPandas(_shared_lists, "token long, part int, id long, n long, place int"))
    # 1: members of a list against the most central one of about their size: the one most of whose short part is shared
    central = lists.groupBy("id").agg((F.count(F.lit(1)) / F.max("n")).alias("central"))
    ranked = lists.withColumn("bucket", F.floor(F.log("n") / math.log(100 / SIMILAR))).join(central, "id")
    in_order = ranked.repartition("token", "part").sortWithinPartitions("token", "part", "bucket", F.desc("central"), "id")
    met = in_order.mapInPandas(_stars, "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    met = persisted(met)
    # where a member's lists have different heads no count may suffice, so it is also compared with the one it meets most
    alike = f"c > 1 AND 100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)"
    most = met.where(alike).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    first = met.where(_enough("c", "na", "nb")).select("a", "b").unionByName(most.select("a", "b"))
    # parts of one long list: their heads against the most central head
    heads = ranked.where("part > 0").groupBy("token", "bucket", "part").agg(F.max(F.struct("central", "id")).alias("head"))
    top = heads.groupBy("token", "bucket").agg(F.max("head").alias("top"))
    first = first.unionByName(heads.join(top, ["token", "bucket"]).select(F.col("top.id").alias("a"), F.col("head.id").alias("b")).where("a <> b"))
    stars = verify(persisted(first.distinct()))
    dropped(met)
    # 2: whatever else meets early enough in a list and is still apart
    apart = persisted(components(stars.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    rows = persisted(lists.join(apart, "id", "left").select("token", "id", "n", "place", F.coalesce("component", "id").alias("component")))
    dropped(lists, apart)
    cells = in_cells(rows).repartition("token", "cell").sortWithinPartitions("token", "cell")
    near = persisted(cells.mapInArrow(_met_pairs, "a long, b long").distinct())
    dropped(rows)
    last = verify(near)
    return persisted(stars.unionByName(last).select(F.col("a").alias("u"), F.col("b").alias("v")))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """docs' ids and set sizes with their component: id_col, n_shingles, class_id, component_id; one row
    for each row of docs.

    Words are runs of other characters than ASCII white space with A-Z lower-cased; a set holds the distinct
    sequences of `width` words, or the whole sequence of fewer. Sets of Jaccard similarity 0.8 or more link.
    class_id is the smallest id with an equal set, component_id the smallest id that links reach. A null or empty text has an empty
    set and links with nothing, so both are its own id. A row with a null id has null for both and links with nothing. Rows that
    share an id are one document: they get one component. An empty table gives an empty result. Ids are integers."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent, ranks, often = frequent_shingles(texts.select("text"), width)
    shared = spark.sparkContext.broadcast((frequent, ranks))
    in_parts = spark.sparkContext.broadcast((frequent[often > PART], -(-often[often > PART] // PART)))
    keys = persisted(texts.mapInArrow(_keys(width, shared), "id long, n long, a long, b long, prefix binary, sketch binary"))
    solid = keys.where("id IS NOT NULL AND n > 0")
    classes = persisted(solid.groupBy("a", "b").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")))
    repeated = persisted(classes.where("size > 1").drop("size"))
    copies = persisted(solid.select("id", "a", "b").join(repeated, ["a", "b"]).where("id <> class_id").select("id", "a", "b"))
    # only rows that may be copies are shuffled to tell; most prefixes stay where they are
    row_hash = F.xxhash64("id", "a", "b").alias("h")
    known = spark.sparkContext.broadcast(filter_of(copies.select(row_hash)))
    prefixes = solid.select("id", "n", "a", "b", "prefix", row_hash)
    heads = probed(prefixes, known, True).join(copies, ["id", "a", "b"], "left_anti").unionByName(probed(prefixes, known, False)).select("id", "n", "prefix")
    postings = heads.mapInArrow(_postings(in_parts), "token long, part int, id long, n long, place int")
    edges = links(texts.where("id IS NOT NULL"), postings, solid.select("id", "n", "sketch"), width)
    # one id with different texts joins its classes
    twice = persisted(keys.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id"))
    several = solid.select("id", "a", "b").join(twice, "id").join(classes, ["a", "b"]).select(F.col("id").alias("u"), F.col("class_id").alias("v"))
    found = persisted(components(edges.unionByName(several)))
    reached = classes.join(found, classes["class_id"] == found["id"], "left").select("a", "b", "class_id", F.coalesce("component", "class_id").alias("component_id"), "size")
    moved = persisted(reached.where("size > 1 OR component_id <> class_id").drop("size"))
    by_id = persisted(found.join(twice, "id").select("id", F.col("component").alias("of_id")))
    dropped(found, twice)
    out = keys.select("id", "n", "a", "b").join(moved, ["a", "b"], "left").join(by_id, "id", "left")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    own = {c: F.when(linked, F.coalesce(c, "id")).otherwise(F.col("id")) for c in ("class_id", "component_id")}
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own["class_id"].alias("class_id"), F.coalesce("of_id", own["component_id"]).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the smallest id stays. Rows with a null id stay; of
    rows that repeat an id all stay if it stays."""
    name = free_name(docs, "gone")
    found = ngram_join(docs, id_col, text_col)
    gone = persisted(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct())
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
