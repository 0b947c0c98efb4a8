"""Tables and folders that operators write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from functools import cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where it is unset and Spark runs in this one machine, as in tests, a
    temporary folder is made; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _temporary()
    return base.rstrip("/")


@cache
def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="tessel-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


#: Application and path of what has been written, whichever of its sessions wrote it.
_made: list[tuple[str, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def kept_on_disk(df: DataFrame) -> DataFrame:
    """df, persisted by the executors' disks until release(); what a lost executor had is computed again."""
    df = df.persist(StorageLevel.DISK_ONLY)
    _persisted.append((df.sparkSession.sparkContext.applicationId, df))
    return df


_persisted: list[tuple[str, DataFrame]] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables written and lets go of the frames kept so far in this application; results that still read them must have been taken."""
    own = spark.sparkContext.applicationId
    for i in range(len(_persisted) - 1, -1, -1):
        if _persisted[i][0] == own:
            _persisted.pop(i)[1].unpersist()
    for i in range(len(_named) - 1, -1, -1):
        if _named[i][0] == own:
            spark.sql(f"drop table if exists {_named.pop(i)[1]}")
    for i in range(len(_made) - 1, -1, -1):
        if _made[i][0] == own:
            _delete(spark, _made.pop(i)[1])


@atexit.register
def _clean() -> None:
    spark = SparkSession._instantiatedSession
    if spark is not None and spark.sparkContext._jsc is not None:  # a session that was stopped before leaves its folders to sweep()
        try:
            release(spark)
        except Exception:
            return


def new_folder(spark: SparkSession, tag: str) -> str:
    """Path of a folder in the shared one that is removed by release(), or when the driver's process ends."""
    path = f"{shared_dir(spark)}/tessel-{tag}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, path))
    return path


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts lineage and survives lost executors.

    The tables are removed by release(), or when the driver's process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, tag: str, key: str, n: int) -> DataFrame:
    """The same in n buckets of a key, so that a group by this key needs no shuffle; a name in the session's catalog leads to it until release()."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    _named.append((spark.sparkContext.applicationId, name))
    df.write.option("compression", "none").option("path", path).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


#: Application and name of tables in its catalog.
_named: list[tuple[str, str]] = []


def sweep(spark: SparkSession, older_than_s: float) -> int:
    """Deletes tables that drivers which have died left in the shared folder, if older than that (longer than any job takes); returns how many."""
    base = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = {path.rsplit("/", 1)[-1] for _, path in _made}
    old = [f.getPath() for f in fs.listStatus(base) if f.getPath().getName().startswith("tessel-") and f.getPath().getName() not in own and f.getModificationTime() <= (time.time() - older_than_s) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)
