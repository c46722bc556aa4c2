"""Session helpers: shared storage for stage tables and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: the session's ``spark.checkpoint.dir``.

    Only a single-machine session (``local``, ``local[n]``) without that setting gets a temporary folder of its own. A cluster session
    without it is an error, because a folder on one machine does not outlive that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="duoscreen-")
    return _local_dir


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return a scan of it.

    For frames that several later passes read: the passes prune columns and push filters into the written
    table, its size is known to the planner, and a lost executor costs a re-read and not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/duoscreen/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stage_by(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """``stage`` as a table bucketed by ``keys``, in as many buckets as the session has shuffle partitions.

    Joins on exactly these keys, and aggregates and windows whose keys include them, read it without an exchange. All rows of
    one key land in one bucket, so the keys must part large groups.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"duoscreen_{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/duoscreen/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    _paths[out], _tables[out] = path, name
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that was staged and nothing will read again; any other frame is left alone."""
    path, table = _paths.pop(df, None), _tables.pop(df, None)
    if table is not None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path is not None:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
