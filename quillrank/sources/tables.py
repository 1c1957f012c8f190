"""Reading tables, picking the current row of an id, and writing intermediate tables to the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, columns: list[str] | None = None, at: str = "ingested_at") -> DataFrame:
    """The row with the latest ``at`` of every ``key``; a NULL ``at`` counts as the oldest. Rows whose key is NULL have no identity and are left out.

    The row-number filter is planned with a group limit before the shuffle, so that an id with very many
    deliveries sends one row per map task.
    """
    columns = columns or [c for c in df.columns if c != at]
    if at not in df.columns:
        return df.where(F.col(key).isNotNull()).select(*columns)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last()))
    kept = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, at, *columns]))
    return kept.withColumn("__rank", rank).where("__rank = 1").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (tests on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillrank-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_table(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the plan starts anew there, and a lost executor costs nothing.

    The files are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillrank-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already
        pass
