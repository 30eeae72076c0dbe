"""Incremental runs over streams of events and discoveries, with the same results as one batch over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rollcall.operators import ledger as ledger_ops
from rollcall.operators.reporting import priced


def monthly_costs(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Costs by month and provider of a stream of events, each batch added to the folder as (batch, month, provider, cost).

    A batch that is run again after a failure replaces its own part, so nothing counts twice.
    """

    def add(batch: DataFrame, n: int) -> None:
        sums = priced(batch).groupBy("month", "provider").agg(F.sum("cost").alias("cost"), F.sum("units").alias("units"))
        sums.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_monthly_costs(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).groupBy("month", "provider").agg(F.sum("cost").alias("cost"), F.sum("units").alias("units"))


def new_companies(found: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Discoveries whose key the ledger doesn't hold yet, appended to it batch by batch; of a batch's equal keys the first."""

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(ledger_path).where(F.coalesce("batch", F.lit(-1)) != n)  # a repeated batch isn't its own predecessor
        ledger_ops.insert_only(known, batch, "seq").select("key", "name", "seq").write.mode("overwrite").parquet(f"{ledger_path}/batch={n}")

    return found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_per_window(failures: DataFrame, minutes: int = 15, lateness: str = "1 hour") -> DataFrame:
    """user_id, window, n of a stream (or a batch) of failed logins (user_id, ts): sliding windows, late rows up to `lateness`."""
    return failures.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", f"{minutes} minutes", "5 minutes")).agg(F.count("*").alias("n"))
