"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space as the contracts define it.
SPACE_RUN = r"[\t-\r][ \t-\r]*| [ \t-\r]+"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Only where none is named and everything runs in
    one process, as in tests, take a new temporary one; executors of a cluster couldn't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="changetree-checkpoint-"))


def persisted(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared checkpoint folder. Lineage ends there, so a lost
    executor costs a re-read and not a recomputation; unlike with checkpoint(), later plans see the table's size and read
    only the columns they need, and no constraints pile up from one round of an iteration to the next."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by persisted() that nothing reads any more: what came of them is itself written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 4 MB, so that batches of long texts or large sets stay small in the JVM and in Python
    workers. A size that the session sets itself is left as it is."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def collapse_space(text: Column) -> Column:
    """text (null: empty) with each run of ASCII white space replaced by one space.

    The pattern leaves single spaces alone, so that the expression matches rarely and stays cheap."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, such that df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
