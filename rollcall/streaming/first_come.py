"""First come, first served over a stream: a row stays unless a row that stayed before it has its key or its domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from rollcall.operators.greedy import greedy_distinct
from rollcall.session import materialise, release


def first_come(
    arriving: DataFrame,
    sink: str,
    checkpoint: str,
    seen: DataFrame | None = None,
    order: str = "seq",
    keys: tuple[str, ...] = ("key", "domain"),
) -> StreamingQuery:
    """The rows of a stream that a sequential pass would keep, written to the folder batch by batch.

    A batch loses the rows that hold a value which a row of an earlier batch (or of `seen`) stayed with; the
    rest is settled among itself in the order of `order` (unique within a batch, not null). Both keys' seen
    values and the rows are one table, so they are committed at once; a batch that runs again reads only its
    predecessors and replaces its own part. The result is that of one batch over everything, however the
    rows are split, as long as later batches hold later rows. Null values are shared with nobody.
    """
    spark = arriving.sparkSession
    names = [order, *keys, *(c for c in arriving.columns if c not in (order, *keys))]
    start = spark.createDataFrame([], arriving.schema) if seen is None else seen
    none = {c: F.lit(None).cast(arriving.schema[c].dataType) for c in names}
    start.select(*(F.col(c) if c in start.columns else none[c].alias(c) for c in names)).write.mode("ignore").parquet(f"{sink}/batch=-1")
    schema = spark.read.parquet(f"{sink}/batch=-1").schema.add("batch", T.IntegerType())

    def add(batch: DataFrame, n: int) -> None:
        known = batch.sparkSession.read.schema(schema).parquet(sink).where(F.col("batch") < n)
        rest = batch.select(*names)
        for k in keys:
            rest = rest.join(known.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        rest = materialise(rest.select(*names), "arrived")
        greedy_distinct(rest, order, keys).select(*names).write.mode("overwrite").parquet(f"{sink}/batch={n}")
        release(rest)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_first_come(spark: SparkSession, sink: str) -> DataFrame:
    """The rows that stayed, with their batch; what was seen before the stream is left out."""
    return spark.read.parquet(sink).where("batch >= 0")
