"""Reply trees to training conversations: root-to-leaf paths, ranked branches, a reversible template.

Messages name their parent. Doubling self-joins give each message its ancestors 1, 2, 4, ... steps up;
from the leaves, the same tables taken in descending order then enumerate every ancestor of every leaf,
in a number of joins that grows with the logarithm of the depth and with rows in proportion to the
output. Each conversation's branches are ranked by score; the chosen ones are formatted, each as one
conversation. All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import materialise


@dataclass(frozen=True)
class Template:
    """A turn is open + role + newline + text + close + newline. reserved: further control strings that texts must not show."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def _pattern(self, marks: str, dropped: str = "") -> str:
        """A control string with backslashes after its first character, as groups 1 to 3; `dropped` is in none."""
        controls = sorted({self.open, self.close, *self.reserved}, key=len, reverse=True)
        by_first: dict[str, list[str]] = {}
        for c in controls:
            by_first.setdefault(c[0], []).append(_quote(c[1:]))
        heads = "|".join(f"{_quote(h)}(?=\\\\*(?:{'|'.join(tails)}))" for h, tails in by_first.items())
        tails = "|".join(t for ts in by_first.values() for t in ts)
        return f"({heads}){dropped}({marks})({tails})"

    def escape(self, text: Column) -> Column:
        """Every control string gets one backslash more after its first character, so none is left as it was."""
        return F.regexp_replace(text, self._pattern(r"\\*"), r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        """The inverse of escape."""
        return F.regexp_replace(text, self._pattern(r"\\*", r"\\"), "$1$2$3")

    def escape_role(self, role: Column) -> Column:
        """As escape, and a line break, which would end the role, becomes backslash n."""
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def unescape_role(self, role: Column) -> Column:
        plain = F.regexp_replace(self.unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_<>\s])", r"\\\1", text)


def thread_by_turn(conversations: DataFrame) -> DataFrame:
    """conv_id, msg_id, parent_id, role, text, score of a table of rows by turn: each replies to the one before.

    Rows of one conversation are ordered by turn (null first), role and text, so ties and repeated rows
    all keep a place. Null roles and texts become empty; rows with a null conv_id are left out.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    return rows.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("msg_id"),
        (F.row_number().over(order) - 1).cast("long").alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    )


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, msg_id, up: every message on the path from each leaf to its root, `up` steps above the leaf.

    messages: conv_id, msg_id (unique in its conversation, not null), parent_id. A parent that isn't in
    the conversation makes a message a root. Messages in a cycle of replies have no root, and neither
    have those below it: they are on no path. An empty table has no paths.
    """
    nodes = messages.select("conv_id", "msg_id", "parent_id")
    known = nodes.select("conv_id", F.col("msg_id").alias("parent_id"))
    jumps = [materialise(nodes.join(known, ["conv_id", "parent_id"], "left_semi").select("conv_id", "msg_id", F.col("parent_id").alias("to")), "jump")]
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while 2 ** (len(jumps) - 1) < most:  # a path is shorter than its conversation has messages
        last = jumps[-1]
        step = materialise(
            last.join(last.select("conv_id", F.col("msg_id").alias("to"), F.col("to").alias("next")), ["conv_id", "to"])
            .select("conv_id", "msg_id", F.col("next").alias("to")),
            "jump",
        )
        if step.isEmpty():
            break
        jumps.append(step)
    parents = jumps[0].select("conv_id", F.col("to").alias("msg_id")).distinct()
    leaves = nodes.select("conv_id", "msg_id").join(parents, ["conv_id", "msg_id"], "left_anti")
    if 2 ** (len(jumps) - 1) >= most > 1:
        # still rising after as many steps as there are messages: in a cycle, or below one
        leaves = leaves.join(jumps.pop().select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_anti")
    paths = leaves.select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up"))
    for k, jump in reversed(list(enumerate(jumps))):
        higher = paths.join(jump, ["conv_id", "msg_id"]).select("conv_id", "leaf", F.col("to").alias("msg_id"), (F.col("up") + 2**k).alias("up"))
        paths = materialise(paths.unionByName(higher), "paths")
    return paths


def choose_branches(paths: DataFrame, messages: DataFrame, branches: int | None = None) -> DataFrame:
    """The paths' messages, with rank: a conversation's branches by mean score (null: 0), then length, then leaf.

    With `branches`, only that many of each conversation, the best; else all.
    """
    rows = paths.join(messages.select("conv_id", "msg_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), ["conv_id", "msg_id"])
    rated = rows.groupBy("conv_id", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("n_turns"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("n_turns"), "leaf")
    ranked = rated.withColumn("rank", F.row_number().over(order)).drop("mean")
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    return rows.join(ranked, ["conv_id", "leaf"])


def format_paths(chosen: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, rank, n_turns, formatted, loss_spans: each path as one conversation, from root to leaf.

    loss_spans: start and end (code points in formatted) of the texts, escaped as they stand, of the
    roles that are learned.
    """
    head = F.concat(F.lit(template.open), template.escape_role(F.col("role")), F.lit("\n"))
    body = template.escape(F.col("text"))
    parts = chosen.select("conv_id", "leaf", "rank", "n_turns", "up", "role", head.alias("_head"), body.alias("_body"))
    parts = parts.select(
        "conv_id", "leaf", "rank", "n_turns", "up",
        F.concat("_head", "_body", F.lit(template.close + "\n")).alias("part"),
        F.length("_head").cast("long").alias("_skip"),
        F.length("_body").cast("long").alias("_long"),
        F.col("role").isin(*template.loss_roles).alias("_learn"),
    )
    before = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.col("_skip"))
    span = F.when(F.col("_learn"), F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("_long")).alias("end")))
    turn = F.struct((-F.col("up")).alias("place"), "part", span.alias("span"))
    grouped = parts.groupBy("conv_id", "leaf", "rank", "n_turns").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    return grouped.select(
        "conv_id", "rank", "n_turns",
        F.array_join(F.col("_t.part"), "").alias("formatted"),
        F.filter(F.col("_t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_trees(messages: DataFrame, branches: int | None = 1, template: Template = Template()) -> DataFrame:
    """Messages (conv_id, msg_id, parent_id, role, text, score) to formatted conversations; see the steps for every case."""
    messages = materialise(messages, "messages")
    return format_paths(choose_branches(root_to_leaf_paths(messages), messages, branches), template)


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, _quote(template.close) + "\n", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    start = len(template.open)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece.substr(F.lit(start + 1), F.length(piece)), "\n", 1)
        text = piece.substr(F.length(role) + start + 2, F.length(piece))
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(whole, turn)


def digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Read the formatted conversations back: turns_sha256, loss_chars, loss_sha256, formatted_chars beside conv_id and n_turns."""
    turns = read_turns(F.col("formatted"), template)
    learned = F.transform(
        "loss_spans", lambda s: template.unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    read = conversations.select("conv_id", "formatted", turns.alias("_turns"), F.array_join(learned, "").alias("_loss"))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
