"""Tables in the folder that all executors share, and broadcasts of measured size."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times bytes a row are at most this.
BROADCAST_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where it is unset and the master is this machine."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


_ENDS: set[str] = set()
_LOCAL = threading.local()


def _open() -> list[list[str]]:
    """The with blocks of Scratch that this thread is in: the tables of each."""
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


def run_dir(spark: SparkSession) -> str:
    """The folder of this session's tables; what is left in it is deleted when the driver program ends."""
    path = f"{shared_dir(spark)}/textloom/run-{spark.sparkContext.applicationId}"
    if path not in _ENDS:
        _ENDS.add(path)
        atexit.register(lambda: spark.sparkContext._jsc is not None and delete(spark, path))
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared file system; those that are gone already don't matter."""
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as a Parquet table into the shared folder and read back: lineage ends there, and executors may be lost."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _open():
        _open()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are materialised inside a with block are deleted at its end, but for those whose frames were kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        _open().append(self.paths)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, made by materialize in this block, outlives it; an enclosing block then owns it."""
        self.kept.add(self.paths[-1])
        return df

    def __exit__(self, *_) -> None:
        _open().pop()
        if _open():
            _open()[-1].extend(p for p in self.paths if p in self.kept)
        delete(self.spark, *[p for p in self.paths if p not in self.kept])


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else as it is, for a shuffle join. df should be materialised: it is counted."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the session has cores: few splits mean little data, which is cheap to move and else read by one core."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
