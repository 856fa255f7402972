"""Written intermediate tables in the folder that the cluster shares.

`stash` cuts lineage by writing a table below `spark.checkpoint.dir`, so a lost
executor costs a re-read, never a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])
_WRITTEN: dict[str, object] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/parcelspark"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Bytes of one Arrow batch (and a last row beyond it), so that very long texts stay in bounds.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded by their bytes, and this package on the workers' path."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Puts this package on the path of Python workers that start from now on."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)


def stash(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: object) -> DataFrame:
    """Writes df as zstd Parquet in the shared folder and returns the table read back.

    The shuffle files of the write are removed when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _WRITTEN[path] = spark
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._stash_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stashed tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_stash_path", None)
        if path:
            _delete(t.sparkSession, path)
            _WRITTEN.pop(path, None)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own retention applies
            break
