"""Where lineage is cut: the folder that the session names, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` and go on from the written rows.

    A reliable checkpoint: an executor that is lost later costs no recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder that the session names. Only a local session (tests) that names none gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        context.setCheckpointDir(folder)


def _new_path(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table: later readers take only the columns that they need."""
    path = _new_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    _PATHS[out] = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like ``written``, with the rows dealt to buckets by ``key``: joins on it read the table in place, without a shuffle."""
    name = f"bucketed_{uuid.uuid4().hex}"
    path = _new_path(df.sparkSession, name)
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet")
    out = df.sparkSession.table(name)
    _PATHS[out] = path
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to: with it go the shuffle files of finished jobs."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` or ``bucketed`` made and nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, _PATHS.pop(table)
        if (name := path.rsplit("/", 1)[1]).startswith("bucketed_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        release(tables[0].sparkSession)
