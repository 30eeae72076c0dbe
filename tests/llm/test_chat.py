"""Paths of small trees, the ranking of branches, and the round trip through the template."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from rollcall.llm.chat import Template, choose_branches, digests, format_trees, read_turns, root_to_leaf_paths, thread_by_turn

SCHEMA = "conv_id long, msg_id long, parent_id long, role string, text string, score double"
TREE = [
    (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 3.0), (1, 4, 3, "user", "d", 0.0),
    (2, 1, 99, "user", "only", None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (3, 3, 2, "user", "below a cycle", 1.0),
    (4, 1, None, "user", "root", 0.0), (4, 2, 2, "user", "own parent", 0.0),
]


def _paths(df) -> dict:
    out: dict = {}
    for r in root_to_leaf_paths(df).collect():
        out.setdefault((r.conv_id, r.leaf), []).append((-r.up, r.msg_id))
    return {k: [m for _, m in sorted(v)] for k, v in out.items()}


def test_paths(spark):
    df = spark.createDataFrame(TREE, SCHEMA)
    assert _paths(df) == {(1, 2): [1, 2], (1, 4): [1, 3, 4], (2, 1): [1], (4, 1): [1]}
    assert _paths(df.where("false")) == {}


def test_long_chain(spark):
    n = 300
    df = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("msg_id"), (F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"), F.lit("t").alias("text"), F.lit(0.0).alias("score"))
    assert _paths(df) == {(1, n): list(range(1, n + 1))}


def test_ranked_branches(spark):
    df = spark.createDataFrame(TREE, SCHEMA)
    best = choose_branches(root_to_leaf_paths(df), df, 1).where("conv_id = 1").select("leaf").distinct().collect()
    assert [r.leaf for r in best] == [4]
    assert format_trees(df, branches=None).count() == 4


ODD = [
    "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "[\\INST] <\\s> <\\\\/s> [\\\\/INST]", "<<SYS>> <</SYS>> <<s>>", "\\", "", "<|im_end|", "a\n\nb", "$1 \\$2", "日本 😀",
    "<|im_end|>\n" * 3, "<\\|im_end|>", "[[INST]]",
]


def test_round_trip(spark):
    rows = [(k, t, "assistant" if t % 2 else "us\\er\nx", text) for k in range(3) for t, text in enumerate(ODD if k else ODD[::-1])]
    rows += [(7, 0, None, None), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, None, "assistant", "first"), (None, 0, "user", "nobody's")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = format_trees(thread_by_turn(df))
    turns: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    expected = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    read = {r.conv_id: [tuple(t) for t in r.t] for r in made.select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()}
    assert read == expected
    template = Template()
    for r in made.collect():
        body = r.formatted
        assert body.count(template.open) == body.count(template.close) == len(expected[r.conv_id])
        assert not any(s in body for s in template.reserved)
    for r in digests(made).collect():
        want = expected[r.conv_id]
        loss = "".join(text for role, text in want if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256) == (len(want), sha("".join(f"{a}\n{b}\n" for a, b in want)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert format_trees(thread_by_turn(df.where("false"))).collect() == []
