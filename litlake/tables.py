"""Tables that cut lineage: written once in the folder that driver and executors share, then read again."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests), where everything is one machine, gets a temporary folder if the setting is missing.
    """
    conf = spark.sparkContext.getConf()
    if place := conf.get("spark.checkpoint.dir", None):
        return place
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="litlake-"))


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later stages don't depend on executors that made it.

    Shuffle files stay on the executors until the driver collects the plans that made them; ``release`` asks for that, where
    they are as large as the corpus."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if release:
        del df
        for _ in range(2):  # the end of a job is told a little later
            time.sleep(0.3)
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, for what reads it more than once; itself if it is one already."""
    return df if hasattr(df, "cut_path") else cut(df, name)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once in the shared folder, dealt by ``key`` into as many buckets as shuffles have partitions: joins by ``key``
    then move only their other side."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written under another name, then renamed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    to, hidden = hadoop.Path(path), hadoop.Path(f"{path.rpartition('/')[0]}/_{path.rpartition('/')[2]}")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(hidden, to)
