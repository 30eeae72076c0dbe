"""Token files: the library's ids, order, repeats, stripes with indexes and Bloom filters, pruned look-ups."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import token_orc
from rollcall.session import new_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text) in the order of doc_id, by the library."""
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def digests(spark, path):
    return sorted((tuple(r) for r in token_orc.document_digests(spark, path).collect()), key=lambda r: r[1])


def test_checksums_of_stretches_combine():
    rng = random.Random(5)
    for _ in range(20):
        parts = [rng.randbytes(4 * rng.randint(1, 300)) for _ in range(rng.randint(1, 6))]
        assert token_orc._crc_of_all([(len(p) // 4, zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_files_give_back_every_document(spark, monkeypatch):
    monkeypatch.setattr(token_orc, "PIECE", 50)
    rng = random.Random(3)
    words = ["alpha", "Straße", "數據", "x<|endoftext|>y", "don't", "\n\n", "  ", "1234", "🙂"]
    rows = [(i * 7 - 50, None if i % 17 == 3 else "" if i % 19 == 4 else " ".join(rng.choices(words, k=rng.randint(1, 400)))) for i in range(120)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1))
    path = new_folder(spark, "test-tokens")
    token_orc.write_tokens(docs, path, PATH, files=4)
    assert digests(spark, path) == expected(sorted(rows))
    files = token_orc.manifest(spark, path).orderBy("part").collect()
    assert sum(r["n_docs"] for r in files) == 120 and all(a["last_doc"] <= b["first_doc"] for a, b in zip(files, files[1:], strict=False))
    assert [r["start"] for r in files] == [sum(x["n_tokens"] for x in files[:k]) for k in range(len(files))]
    wanted = [rows[5][0], rows[60][0], 10**12]
    found = token_orc.find_documents(spark, path, wanted).orderBy("doc_id", "piece").collect()
    assert {r["doc_id"] for r in found} == set(wanted[:2])
    for doc, start, n, crc in expected(sorted(rows)):
        if doc in wanted:
            ids = [i for r in found if r["doc_id"] == doc for i in r["ids"]]
            assert len(ids) == n and zlib.crc32(np.array(ids, "<u4").tobytes()) == crc
            assert {r["start"] for r in found if r["doc_id"] == doc} == {start}


def test_documents_across_tasks_are_joined(spark, monkeypatch):
    """Small splits cut files between stripes, and a long document lies in several of them."""
    monkeypatch.setattr(token_orc, "PIECE", 16)  # a writer looks at its stripe every 5,000 rows
    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 64 << 10)
    rng = random.Random(11)
    long = " ".join(f"{rng.getrandbits(40):x}" for _ in range(60_000))
    rows = [(1, "first"), (2, long), (3, "last")]
    path = new_folder(spark, "test-tokens")
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, files=1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        data = spark.read.orc(f"{path}/data")
        assert data.select(F.spark_partition_id().alias("p")).distinct().count() > 2
        assert digests(spark, path) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "no id"), (None, None), (4, "twice"), (4, "twice"), (4, "other"), (-1, " " * 200_000 + "x")]
    path = new_folder(spark, "test-tokens")
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, files=2)
    got = digests(spark, path)
    assert [r[0] for r in got] == [None, None, -1, 4, 4, 4]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in expected(rows))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    path = new_folder(spark, "test-tokens")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert digests(spark, path) == [] and token_orc.find_documents(spark, path, [1]).count() == 0


def test_stripes_have_indexes_blooms_and_run_lengths(spark, monkeypatch):
    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 32 << 10)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(30):x}" for _ in range(40))) for i in range(6000)], "doc_id long, text string")
    path = new_folder(spark, "test-tokens")
    token_orc.write_tokens(docs, path, PATH, files=1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    [name] = {f for f in spark.read.orc(f"{path}/data").inputFiles()}
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == token_orc.GROUP_ROWS
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {str(s.getKind()) for s in footer.getStreamsList()}
    assert "ROW_INDEX" in kinds and "BLOOM_FILTER_UTF8" in kinds
    assert {str(c.getKind()) for c in footer.getColumnsList()} == {"DIRECT", "DIRECT_V2"}  # V2: integer runs, deltas, packed bits


def test_filters_reach_the_files(spark):
    path = new_folder(spark, "test-tokens")
    token_orc.write_tokens(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")), path, PATH, files=2)
    plan = token_orc.find_documents(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
