"""Documents that arrive as a stream: appended by batch, the last delivery of an id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def start(stream: DataFrame, folder: str, checkpoint: str, *, id: str = "id", tokens: str | None = "tokens", once: bool = True):
    """Write a stream of documents to ``folder``: ``rows`` by batch, in the order of arrival, and the length of their token lists in ``_length``.

    A batch replaces what an earlier attempt at it has left, so that a restart counts nothing twice. With ``once`` the query ends when what is there is
    read, else it goes on.
    """

    def keep(batch: DataFrame, number: int) -> None:
        length = F.when(F.col(tokens).isNotNull(), F.size(tokens)) if tokens else F.lit(None).cast("int")
        kept = batch.withColumn("_batch", F.lit(number)).withColumn("_place", F.monotonically_increasing_id()).withColumn("_length", length)
        kept.write.mode("overwrite").parquet(f"{folder}/rows/_part={number}")

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rows(spark: SparkSession, folder: str, id: str = "id") -> DataFrame:
    """The last delivered row of each id; of several in one batch, the one that came last."""
    return _last(spark.read.parquet(f"{folder}/rows"), id).drop("_batch", "_place", "_length", "_part")


def _last(df: DataFrame, id: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(id).orderBy(F.desc("_batch"), F.desc("_place")))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def statistics(spark: SparkSession, folder: str, id: str = "id") -> DataFrame:
    """One row: ``n`` and ``avgdl`` of the rows that count, so that an update doesn't count twice. Only ids and lengths are read."""
    held = _last(spark.read.parquet(f"{folder}/rows").select(id, "_batch", "_place", "_length"), id)
    return held.agg(F.count("_length").alias("n"), (F.sum("_length") / F.count("_length")).alias("avgdl"))


def arrivals(stream: DataFrame, at: str, late_by: str = "7 days", span: str = "1 day") -> DataFrame:
    """Documents by window of their arrival, rows later than ``late_by`` left out."""
    return stream.withWatermark(at, late_by).groupBy(F.window(at, span)).agg(F.count("*").alias("documents")).select(F.col("window.start").alias("start"), "documents")
