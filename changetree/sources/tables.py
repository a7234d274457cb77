"""Tables of a folder, and intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def persisted(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder; lineage ends there."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by persisted() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path not used before in the folder the cluster names in spark.checkpoint.dir. Only where none is named and
    everything runs in one process, as in tests, it lies in a temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="changetree-checkpoint-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
