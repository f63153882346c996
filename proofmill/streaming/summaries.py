"""Incremental evaluation summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eval_summary_stream(runs: DataFrame) -> DataFrame:
    """Running per-variant totals over arriving run results (complete mode)."""
    return runs.groupBy("variant").agg(
        F.count("*").alias("runs"), F.count_if(F.col("verification_exit_code") == 0).alias("verified"),
        F.round(F.avg("duration_ms"), 3).alias("avg_duration_ms"), F.round(F.avg("changed_files"), 6).alias("avg_changed_files"))


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Drain what is available into `folder` and read it back (append: all rows, complete: last result)."""
    spark = stream.sparkSession
    rows = f"{folder}/rows"

    def save(batch: DataFrame, number: int) -> None:
        # A batch that is retried after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}" if mode == "append" else rows)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return spark.read.parquet(rows).drop("batch")
