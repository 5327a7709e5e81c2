"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORKER_STATE: dict = {}
"""Per-process caches of Python workers, keyed by operator; workers are reused between tasks."""


#: Keys of what a worker keeps between tasks that takes more than a few MB.
LARGE_STATES = ("packing", "codec")


def drop_states(but: tuple = ()) -> None:
    """Frees the large states that other operators left in this worker, which may be reused for any operator."""
    old = [k for k in WORKER_STATE if k != but and isinstance(k, tuple) and k[0] in LARGE_STATES]
    for k in old:
        del WORKER_STATE[k]
    if old:
        gc.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan, dealt to all cores where its files give fewer partitions than there are: a small table's rows move
    so that a slow operator does not run on one core; a large table's never move."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is missing, a folder of our own is set, but only in local mode, as in tests: on a cluster
    executors could not read what the driver's machine holds, and a RuntimeError says so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = WORKER_STATE.get("own_checkpoint_dir")
        if not base:
            base = WORKER_STATE["own_checkpoint_dir"] = tempfile.mkdtemp(prefix="grainmill-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The frame, written to the shared folder and read back: lineage ends here, lost executors cost nothing,
    and the planner knows its size. The files go at the driver's end, or with discard() of the list `scratch`, to
    which their path is added."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _files(spark, path, lambda fs, at: fs.deleteOnExit(at))
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes what stored() wrote for frames that nothing reads any more."""
    while scratch:
        _files(spark, scratch.pop(), lambda fs, at: fs.delete(at, True))


def _files(spark: SparkSession, path: str, use) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    use(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def beside(kind: T.DataType, rest: str, name: str = "row") -> T.StructType:
    """Schema of a column of that type, whatever its fields are called, and further columns."""
    return T.StructType([T.StructField(name, kind), *T.StructType.fromDDL(rest).fields])


def small(df: DataFrame, limit: int) -> bool:
    """Whether the frame's values take at most `limit` bytes, which is counted: eight for a number, a string's length."""
    each = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.octet_length(F.to_json(f"`{f.name}`")) for f in df.schema]
    total = sum(each, F.lit(0)).cast("long")
    return (df.agg(F.sum(total).alias("n")).first()["n"] or 0) <= limit
