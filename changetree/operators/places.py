"""Work on rows whose ids lie together.

Ids that were made together often begin alike, and what they name seldom refers to anything elsewhere. A place is a function of an id, so every row that
names an id can be dealt by its place, and all that refers to the id comes to one task by one exchange, whatever the function is. It only decides how
much that saves: what refers from one place to another, and places too large for a task's memory, are told apart here and left to joins on the ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import persisted

#: Places are told apart by so many hashes, of which a small table tells the rows and whether anything crosses.
BUCKETS = 1 << 16
#: A hash with more rows than this and four times the mean is left to joins, so a place of a task has no more either.
MOST_ROWS = 10_000
#: Rows of the largest tables of a task, so that it sorts in memory.
ROWS_A_TASK = 1_000_000


def place_of(of: Callable[[Column], Column], *ids: str) -> Column:
    """The place of the first of these ids that has one, as a number."""
    return F.hash(F.coalesce(*(of(F.col(c)) for c in ids), F.lit(""))).alias("place")


def bucket(place: Column) -> Column:
    return F.pmod(place, F.lit(BUCKETS))


def open_buckets(*links: DataFrame) -> tuple[DataFrame | None, int]:
    """Of rows (a, b: the places that a row names) the buckets of places that something crosses or that are too large, None if there are none, and the
    number of tasks that have about ROWS_A_TASK rows each."""
    rows = reduce(DataFrame.unionByName, links)
    pairs = rows.groupBy(bucket(F.col("a")).alias("x"), F.when(F.col("a") != F.col("b"), bucket(F.col("b"))).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    ends = pairs.select(F.explode(F.when(F.col("y").isNull(), F.array("x")).otherwise(F.array("x", "y"))).alias("bucket"), "n", F.col("y").isNotNull().alias("crosses"))
    sizes = persisted(ends.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("crosses").alias("crosses")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    found = sizes.where(F.col("crosses") | (F.col("n") > MOST_ROWS + 4 * total // BUCKETS)).select("bucket")
    return None if found.isEmpty() else found, -(-total // ROWS_A_TASK)


def split(rows: DataFrame, place: Column, buckets: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """rows whose places are in none of the buckets, and the others."""
    if buckets is None:
        return rows, None
    marked = rows.withColumn("bucket", bucket(place))
    return marked.join(buckets, "bucket", "left_anti").drop("bucket"), marked.join(buckets, "bucket", "left_semi").drop("bucket")


def dealt(rows: DataFrame, key: str, n_tasks: int) -> DataFrame:
    """rows dealt by key to n_tasks tasks, or to as many as the session deals to if that is more."""
    return rows.repartition(n_tasks, key) if n_tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def by_place(rows: DataFrame, n_tasks: int, of: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `of` makes of tables with all rows of one or more places (place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            cut = pc.index(held["place"], held["place"][-1]).as_py() if held.num_rows else 0
            if cut:  # the last place may go on in the next batch
                yield from of(held.slice(0, cut).combine_chunks()).combine_chunks().to_batches(10_000)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from of(held.combine_chunks()).combine_chunks().to_batches(10_000)

    return dealt(rows, "place", n_tasks).sortWithinPartitions("place").mapInArrow(run, schema)


def codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """The values of columns of one type as numbers from 0, the same for the same value and -1 for null, and the values."""
    whole = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    numbers = pc.fill_null(whole.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), whole.dictionary


def taken(values: pa.Array | pa.ChunkedArray, at: np.ndarray) -> pa.Array | pa.ChunkedArray:
    """values at these positions, null where a position is negative."""
    return values.take(pa.array(at, mask=at < 0))
