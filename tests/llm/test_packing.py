"""Packing: exact tokens, the reduction against an exhaustive search, and whole packings against the lower bound."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rollcall.llm.packing import best_fit, lower_bound, pack_documents, packed_sequences, plan_packing, reduce_by_dominance, token_pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _optimum(items: list[int], capacity: int) -> int:
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        rooms.append(capacity - items[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    random.seed(1)
    for _ in range(400):
        capacity = random.choice([7, 10, 13, 20])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        fixed, rest = reduce_by_dominance(Counter(items), capacity)
        left = list(Counter(rest).elements())
        assert sum(t for _, t in fixed) + (_optimum(left, capacity) if left else 0) == _optimum(items, capacity)


def test_plans_cover_the_histogram():
    random.seed(2)
    for _ in range(100):
        capacity = random.choice([10, 50, 2048])
        counts = Counter(random.randint(1, capacity) for _ in range(random.randint(0, 300)))
        plan = plan_packing(counts, capacity)
        got: Counter = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= capacity and times > 0
            got.update({s: n * times for s, n in Counter(lengths).items()})
        assert got == counts
        n = sum(t for _, t in plan)
        assert lower_bound(counts, capacity) <= n <= sum(t for _, t in best_fit(counts, capacity)) + 1


def _documents(spark):
    random.seed(3)
    words = ["alpha", "beta", "gamma", "<|endoftext|>", "naïve", "日本", "x1y2", "\n\n"]
    rows = [(k, " ".join(random.choice(words) for _ in range(random.randint(0, 900)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "z " * 9000), (103, rows[5][1]), (103, rows[5][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_tokens_equal_the_library(spark):
    df, rows = _documents(spark)
    library = Tokenizer.from_file(BPE)
    expected = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 512 or 512
        at, piece = 0, 0
        while at < len(ids):
            end = at + (first if piece == 0 else 512)
            expected.append((doc_id, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, piece = end, piece + 1
    got = token_pieces(df, BPE, 512).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_sequences_are_gapless_and_few(spark):
    df, _ = _documents(spark)
    packed = pack_documents(df, BPE, 512, with_ids=True)
    rows = packed.collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    counts = Counter(r.length for r in rows)
    assert len(by_sequence) <= lower_bound(counts, 512) + 1
    whole = packed_sequences(packed).collect()
    assert sum(len(s.ids) for s in whole) == sum(r.length for r in rows)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, sequence_id int, offset int")
    assert pack_documents(df.where("false"), BPE).collect() == []
    assert [(r.sequence_id, r.offset) for r in pack_documents(df, BPE).collect()] == [(0, 0)]
