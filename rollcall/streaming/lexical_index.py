"""The index of names as a stream: every arriving row is compared with the rows of its block that came before it, and then
joins them.

A block (country, first letters of the name) is a key of the stream's state. The state holds the block's rows
up to the cap, so it and the work of a row are bounded; rows beyond the cap are compared with none and need
not be held. The ledger that the index starts from is the state's initial content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from rollcall.functions.scores import set_ratio_tenths
from rollcall.operators.matching import MAX_BLOCK, MEDIUM, STRONG, name_blocks

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PAIRS = "key_a string, key_b string, name_score int"


class BlockIndex(StatefulProcessor):
    """A block's rows in the order in which they came: (key, words), at most `most` of them."""

    def __init__(self, most: int, least_score: int):
        self.most, self.least_score = most, least_score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "key string, words string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = sum(1 for _ in self.rows.get())
        new = [(r.key, r.words) for r in initialState.itertuples(index=False)][: self.most - held]
        if new:
            self.rows.appendList(new)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peers = [(k, w, frozenset(w.split(" "))) for k, w in self.rows.get()]
        room = self.most - len(peers)
        first = None  # the batch's first rows of the block, as many as there is room for
        for chunk in rows:
            first = chunk if first is None else pd.concat([first, chunk])
            first = first.sort_values("at", kind="stable").head(max(room, 0))
        found, new = [], []
        for row in [] if first is None else first.itertuples(index=False):
            mine = frozenset(row.words.split(" "))
            for other, _, words in peers:
                if other != row.key:
                    score = set_ratio_tenths(mine, words)
                    if score >= self.least_score:
                        found.append((min(row.key, other), max(row.key, other), score))
            peers.append((row.key, row.words, mine))
            new.append((row.key, row.words))
        if new:
            self.rows.appendList(new)
        yield pd.DataFrame(found, columns=["key_a", "key_b", "name_score"]).astype({"name_score": "int32"})

    def close(self) -> None:
        pass


def _indexed(rows: DataFrame, *more: str) -> DataFrame:
    named = name_blocks(rows, *more)
    return named.select("country", "prefix", "key", F.array_join("tokens", " ").alias("words"), *more)


def lexical_candidates(
    arriving: DataFrame, sink: str, checkpoint: str, ledger: DataFrame | None = None, order: str = "seq", max_block: int = MAX_BLOCK
) -> StreamingQuery:
    """Pairs of an arriving row (key, name, country and a unique `order`) with rows of its block before it, written to the
    folder batch by batch.

    Only rows known by name (`name:` keys) with words take part. Rows of one micro-batch come in their order; those of a
    later one come after them. A row that finds max_block rows in its block is compared with none. The ledger's rows are
    there from the start (of more than max_block of them no row is compared, so any of them may be held). State and
    offsets are committed together, and a batch that runs again replaces its own part, so nothing counts twice.
    """
    spark = arriving.sparkSession
    begin = None if ledger is None else _indexed(ledger).groupBy("country", "prefix")
    keyed = _indexed(arriving.withColumn("at", F.col(order)), "at").groupBy("country", "prefix")
    pairs = keyed.transformWithStateInPandas(BlockIndex(max_block, MEDIUM), _PAIRS, "Append", "None", begin)

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # lists in the state need it; a query keeps the setting that it starts with
    try:
        return pairs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_lexical_candidates(spark: SparkSession, sink: str) -> DataFrame:
    """key_a, key_b, name_score (tenths), tier: each pair once."""
    one = spark.read.schema(_PAIRS).parquet(sink).groupBy("key_a", "key_b").agg(F.max("name_score").alias("name_score"))
    return one.withColumn("tier", F.when(F.col("name_score") >= STRONG, "lexical").otherwise("shortlist"))
