"""What the operators of this subpackage share: scratch tables and text helpers."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, SparkSession] = {}
_open: list[list[str]] = []
_swept = [0.0]
#: The driver collects its garbage between jobs, no more often than this.
SWEEP_SECONDS = 1.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    spark.checkpoint.dir names it.  Where it is unset, a local master gets a folder below /tmp; a cluster gets an
    error, as a machine's own folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def scratch_path(spark: SparkSession) -> str:
    top = f"{shared_dir(spark)}/riskweave-{spark.sparkContext.applicationId}"
    if top not in _made:
        _made[top] = spark
        atexit.register(_remove, top)
    return f"{top}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove(top: str) -> None:
    spark = _made.pop(top, None)
    try:
        _delete(spark, top)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def cut(df: DataFrame, keep: bool = False, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    Inside scratch() the table goes when the block ends, unless `keep` hands it to the block around.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.options(**options).parquet(path)
    if time.monotonic() - _swept[0] >= SWEEP_SECONDS:
        sweep(spark)
    blocks = _open[:-1] if keep else _open
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _swept[0] = time.monotonic()


def release(spark: SparkSession) -> None:
    """Every executor collects its garbage: it gives back heap that earlier steps have filled, which else stays taken beside the Python workers."""
    tasks = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes in this block is deleted at its end; only what it keeps may be used after it."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)
        sweep(spark)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
