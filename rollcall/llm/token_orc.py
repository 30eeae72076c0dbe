"""Token ids of documents in ORC files that can be read stripe by stripe.

Documents are dealt to files by ranges of doc_id and sorted within them, so the order of the files and of
the rows in them is the order of the documents. A row is a piece of a document of at most PIECE ids, so
neither a writer's nor a reader's batch grows with the longest text:

    part int, at long, doc_id, piece int, ids array<int>

`part` numbers the file and `at` is the document's first place in it. ORC stores integers run-length
encoded (runs and deltas for part, at, doc_id and piece; bit-packed ids), splits a file into stripes that
tasks read apart, and keeps minima and maxima of each stripe and row group, and a Bloom filter of doc_id in
each row group, by which `find_documents` skips what it need not read. A second ORC table, the manifest,
has one row for each file: its documents' range, their number, and the place of its first id among all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.batches import small_batches
from rollcall.llm.packing import encode_text
from rollcall.session import materialise

#: Ids of a row; rows of a group that has its own minimum, maximum and Bloom filter; bytes of a stripe.
PIECE, GROUP_ROWS, STRIPE_BYTES = 4096, 1000, 16 << 20
#: Share of row groups without a document that its Bloom filter lets pass.
FALSE_POSITIVES = 0.01


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    files: int | None = None,
) -> None:
    """Encode whole texts, append end_id to each, and write path/data and path/manifest, in ascending doc_id order.

    A null or empty text is end_id alone. A null doc_id comes first. Every row is a document of its own:
    rows of one doc_id follow one another, ordered by their texts' hashes, and may lie in several files.
    Other columns, of whatever names, are not kept. An empty table writes tables without rows. Without
    `files`, adaptive execution chooses their number from the size of the texts.
    """
    spark = documents.sparkSession
    order = ["doc_id", "_tie", "_row"]
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_row")
    )
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    kind = documents.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            row, begin, piece, ids, held = [], [], [], [], 0
            for n, value in enumerate(batch.column(1)):
                found = np.array([*encode_text(tokenizer, value.as_py() or ""), end_id], np.int32)
                for k, lo in enumerate(range(0, len(found), PIECE)):
                    row.append(n)
                    begin.append(at)
                    piece.append(k)
                    ids.append(found[lo : lo + PIECE])
                    held += len(ids[-1])
                    if held >= 1 << 20:
                        yield _pieces(batch.column(0), part, row, begin, piece, ids)
                        row, begin, piece, ids, held = [], [], [], [], 0
                at += len(found)
            if row:
                yield _pieces(batch.column(0), part, row, begin, piece, ids)

    with small_batches(spark):
        pieces = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, f"part int, at long, doc_id {kind}, piece int, ids array<int>")
        writer = pieces.write.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
        writer = writer.option("orc.bloom.filter.fpp", str(FALSE_POSITIVES)).option("orc.row.index.stride", str(GROUP_ROWS))
        writer.option("orc.stripe.size", str(STRIPE_BYTES)).orc(f"{path}/data")
    counted = spark.read.schema(pieces.schema).orc(f"{path}/data")
    counted = counted.groupBy("part").agg(
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("n_docs"),
        F.sum(F.size("ids")).cast("long").alias("n_tokens"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    counted.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def _pieces(keys: pa.Array, part: int, row: list, begin: list, piece: list, ids: list) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(row), part, np.int32)),
            pa.array(begin, pa.int64()),
            keys.take(pa.array(row, pa.int32())),
            pa.array(piece, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
        ],
        ["part", "at", "doc_id", "piece", "ids"],
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: part, first_doc, last_doc, n_docs, n_tokens, start."""
    return spark.read.orc(f"{path}/manifest")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (of the document among all ids), piece, ids, and the file's part and the place in it, at."""
    starts = manifest(spark, path).select("part", F.col("start").alias("_from"))
    rows = spark.read.orc(f"{path}/data").join(starts, "part")
    return rows.select("doc_id", (F.col("_from") + F.col("at")).alias("start"), "piece", "ids", "part", "at")


def find_documents(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The pieces of some documents: the manifest names their files' rows, the scan reads the row groups that minima,
    maxima and Bloom filters leave."""
    return read_pieces(spark, path).where(F.col("doc_id").isin(doc_ids))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, one row for each document: doc_id, start, n_tokens, ids_crc32.

    A task reads its stripes in order and digests each document's pieces as they come; what it has of a
    document is one row. Only the first and the last document of a task may lie in others too: the checksums of their
    stretches are combined by their lengths. No ids are moved.
    """
    data = spark.read.orc(f"{path}/data")
    kind = data.schema["doc_id"].dataType.simpleString() if "doc_id" in data.columns else "long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, doc, first, length, crc, edge = None, None, 0, 0, 0, True
        for batch in batches:
            schema, done = batch.schema, []
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            parts, ats, docs, pieces = (batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "piece"))
            for n in range(batch.num_rows):
                if (parts[n], ats[n]) != key:
                    if key is not None:
                        done.append((*key, doc, first, length, crc, edge))
                        edge = False
                    key, doc, first, length, crc = (parts[n], ats[n]), docs[n], pieces[n], 0, 0
                ids = flat[ends[n] : ends[n + 1]]
                length += len(ids)
                crc = zlib.crc32(ids.tobytes(), crc)
            yield _stretches(done, schema)
        if key is not None:
            yield _stretches([(*key, doc, first, length, crc, True)], schema)

    schema = f"part int, at long, doc_id {kind}, first int, length long, crc long, edge boolean"
    with small_batches(spark):
        found = data.select("part", "at", "doc_id", "piece", "ids").mapInArrow(digest, schema)
        found = materialise(found, "token-digests")
    several = F.array_sort(F.collect_list(F.struct("first", "length", "crc"))).alias("s")
    joined = F.udf(lambda s: _crc_of_all([(r["length"], r["crc"]) for r in s]), "long")
    edges = found.where("edge").groupBy("part", "at", "doc_id").agg(F.sum("length").alias("n_tokens"), several)  # at most two documents of a task
    whole = found.where("not edge").select("part", "at", "doc_id", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    whole = whole.unionByName(edges.withColumn("ids_crc32", joined("s")).drop("s"))
    starts = manifest(spark, path).select("part", F.col("start").alias("_from"))
    return whole.join(starts, "part").select("doc_id", (F.col("_from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _stretches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    part, at, doc, first, length, crc, edge = zip(*rows, strict=True) if rows else ((),) * 7
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part, pa.int32()),
            pa.array(at, pa.int64()),
            pa.array(doc, schema.field("doc_id").type),
            pa.array(first, pa.int32()),
            pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array(edge, pa.bool_()),
        ],
        ["part", "at", "doc_id", "first", "length", "crc", "edge"],
    )


def _crc_of_all(stretches: list[tuple[int, int]]) -> int:
    """The checksum of stretches of ids that follow one another, from (number of ids, checksum) of each."""
    crc = 0
    for length, own in stretches:
        crc = _times(crc, _power_of_x(32 * length)) ^ own
    return crc


#: CRC-32's polynomial without its x^32 and the polynomial 1, bits reversed as in the checksum (fixed values).
_POLYNOMIAL, _ONE = 0xEDB88320, 1 << 31


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's."""
    product = 0
    while b:
        if b & _ONE:
            product ^= a
        a = a >> 1 ^ (_POLYNOMIAL if a & 1 else 0)
        b = b << 1 & 0xFFFFFFFF
    return product


def _power_of_x(n: int) -> int:
    """x to the n, modulo CRC-32's polynomial."""
    out, square = _ONE, _ONE >> 1
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out
