"""Streams give what one batch gives, whatever the split, after a restart and with a batch run twice."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollcall.operators import greedy, matching
from rollcall.session import new_folder
from rollcall.streaming import first_come, lexical_index

SHAPE = "seq long, key string, name string, country string"


def _names(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    heads = ["alpha steel", "alphax steel", "betacorp", "beta corp", "gamma", "삼성 물산"]
    tails = ["works", "work", "trading", "tradings", "Inc.", "of seoul", ""]
    rows = []
    for k in range(n):
        name = f"{rng.choice(heads)} {rng.choice(tails)} {rng.choice(tails)}"
        key = ("dom:" if rng.random() < 0.1 else "name:") + f"k{k if rng.random() < 0.9 else k // 2}"
        rows.append((k, key, rng.choice([name, name, name.upper(), None, "inc"]), rng.choice(["KR", "kr ", None])))
    return rows


def _folder(spark, rows, shape, cuts) -> str:
    """The rows in one file for each stretch between the cuts, oldest first."""
    path = Path(new_folder(spark, "arrivals").removeprefix("file://"))
    for n, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        _add(spark, path, n, rows[lo:hi], shape)
    return str(path)


def _add(spark, path: Path, n: int, rows, shape) -> None:
    part = f"{path}-part"
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(part)
    [made] = Path(part).glob("*.parquet")
    path.mkdir(exist_ok=True)
    shutil.move(made, path / f"{n:03}.parquet")


def _stream(spark, path, shape):
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def _ran(query) -> None:
    assert query.awaitTermination(240)
    assert query.exception() is None


def _again(checkpoint: str) -> None:
    """As if the driver had died before it could note that the last batch was done."""
    commits = sorted((Path(checkpoint) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (Path(checkpoint) / "commits").glob(f".{commits[-1].name}.crc"):
        p.unlink()
    commits[-1].unlink()


@pytest.mark.parametrize("most", [1000, 7])
def test_lexical_index_equals_a_batch(spark, tmp_path, most):
    old, rows = [(r[0], r[1].replace("k", "old"), *r[2:]) for r in _names(1, 12)], _names(2, 150)
    ledger = spark.createDataFrame(old, SHAPE)
    want = matching.inline_lexical(spark.createDataFrame(rows, SHAPE), ledger, "seq", most)
    want = sorted(tuple(r) for r in want.select("key_a", "key_b", "name_score", "tier").collect())
    assert len(want) > 10
    path, sink, cp = _folder(spark, rows[:110], SHAPE, [40]), str(tmp_path / "out"), str(tmp_path / "cp")
    _ran(lexical_index.lexical_candidates(_stream(spark, path, SHAPE), sink, cp, ledger, max_block=most))
    _again(cp)  # its second batch runs once more, then the third
    _add(spark, Path(path), 2, rows[110:], SHAPE)
    _ran(lexical_index.lexical_candidates(_stream(spark, path, SHAPE), sink, cp, ledger, max_block=most))
    assert sorted(tuple(r) for r in lexical_index.read_lexical_candidates(spark, sink).collect()) == want
    assert len(list(Path(sink).glob("batch=*"))) >= 3


def test_first_come_equals_a_batch_for_any_split(spark, tmp_path):
    shape = "seq long, key string, domain string, extra string"
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(n, rng.choice([None, *"abcdefghij"]), rng.choice([None, *"pqrstuvwxyz"]), f"e{n}") for n in range(60)]
        frame = spark.createDataFrame(rows, shape)
        want = sorted(tuple(r) for r in greedy.greedy_distinct(frame, "seq").collect())
        cuts = sorted(rng.sample(range(1, 50), 2))
        path, sink, cp = _folder(spark, rows[:50], shape, cuts), str(tmp_path / f"out{seed}"), str(tmp_path / f"cp{seed}")
        _ran(first_come.first_come(_stream(spark, path, shape), sink, cp))
        _again(cp)
        _add(spark, Path(path), 9, rows[50:], shape)
        _ran(first_come.first_come(_stream(spark, path, shape), sink, cp))
        got = first_come.read_first_come(spark, sink)
        assert sorted(tuple(r) for r in got.select("seq", "key", "domain", "extra").collect()) == want


def test_first_come_starts_from_what_was_seen(spark, tmp_path):
    shape = "seq long, key string, domain string"
    rows = [(1, "a", "x"), (2, "b", "y"), (3, "c", None), (4, None, "z"), (5, "d", "z")]
    seen = spark.createDataFrame([("a", None), ("q", "y")], "key string, domain string")
    path = _folder(spark, rows, shape, [2])
    _ran(first_come.first_come(_stream(spark, path, shape), str(tmp_path / "out"), str(tmp_path / "cp"), seen))
    got = first_come.read_first_come(spark, str(tmp_path / "out")).select("seq")
    assert sorted(r.seq for r in got.collect()) == [3, 4]
    assert got.where(F.col("seq") < 3).count() == 0
