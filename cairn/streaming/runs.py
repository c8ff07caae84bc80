"""Bounded runs of streams: all that is there is read in batches, and every batch is a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import fresh_path


def run_to_end(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """All rows that the stream gives until its source is used up, with batch (from 0).

    A batch is written to its own folder, so one that is repeated after a failure takes the place of its first try.
    """
    spark = stream.sparkSession
    out, written = fresh_path(spark, name), []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        written.append(batch)

    started = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", fresh_path(spark, f"{name}-progress")).trigger(availableNow=True).start()
    started.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int"))


def latest_batch(rows: DataFrame) -> DataFrame:
    """Of rows of a stream in complete mode, the last batch, which holds all."""
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")
