"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message they answer. Iterative self-joins double the distance of each pointer, so a tree of any
depth takes as many rounds as the logarithm of its depth; they give every message its depth and the score of
the branch down to it. Branches (root to leaf) are ranked within a conversation, the chosen ones are enumerated by the same pointers, and
each becomes one text with a loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import written

# The control strings of the template; texts never hold one once escaped.
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>"
_CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    """Double every backslash, and put one inside each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


@dataclass
class Paths:
    """Pointers up by 1, 2, 4 and so on, and each message's depth and branch score."""

    jumps: list[DataFrame]
    nodes: DataFrame


def climb(messages: DataFrame) -> Paths:
    """``messages``: conv, node, parent, score; a parent that is missing makes its message a root.

    Messages on a ring of parents, or below one, never reach a root and are left out.
    """
    known = messages.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    linked = messages.join(known, ["conv", "parent"], "left").select(
        "conv", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total")
    )
    start = written(linked.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "jumps")
    done, active = start.filter("up is null"), start.filter("up is not null")
    jumps, size = [], start.count()
    # Each round joins only messages that have not reached their root; the others wait in ``done``.
    while not active.isEmpty():
        jumps.append(active.select("conv", "node", "up"))
        if 2 ** (len(jumps) - 1) > size:
            break
        far = done.unionByName(active).select("conv", F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("depth").alias("steps"))
        now = active.join(far, ["conv", "up"], "left").select(
            "conv", "node", F.col("far").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth")
        )
        now = written(now, "jumps")
        done, active = done.unionByName(now.filter("up is null")), now.filter("up is not null")
    return Paths(jumps, done.select("conv", "node", "total", "depth"))


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv, branch, node, place): the messages of the ``best`` branches of each conversation, or of all.

    A branch ranks by its mean score, then by length, then by its leaf's id. ``place`` counts from the root, from 0.
    """
    paths = climb(messages)
    parents = messages.select("conv", F.col("parent").alias("node")).distinct()
    leaves = paths.nodes.join(parents, ["conv", "node"], "left_anti")
    order = Window.partitionBy("conv").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), F.col("depth").desc(), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    chosen = ranked if best is None else ranked.filter(F.col("branch") <= best)
    found = chosen.select("conv", "branch", "node", F.col("depth").alias("place"))
    for k in reversed(range(len(paths.jumps))):
        above = found.join(paths.jumps[k], ["conv", "node"]).select("conv", "branch", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"))
        found = written(found.unionByName(above), "branches")
    return found


def format_branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """One row per chosen branch: conv, branch, formatted, loss_mask (array of start, end in code points, end exclusive).

    ``messages``: conv string, node long (unique within conv), parent long, role, text, score double. Null roles and texts are
    empty, null scores 0. The mask covers each assistant text, escaped as it stands, and nothing else.
    A turn is ``<s>[INST] role [/INST]``, a line end, the text and ``</s>``. An empty table gives an empty one.
    """
    slim = messages.select("conv", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    turns = branches(slim, best).join(
        messages.select("conv", "node", escape(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("role", F.lit("")).alias("is"), escape(F.coalesce("text", F.lit(""))).alias("text")),
        ["conv", "node"],
    )
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(ROLE_END))
    pieces = turns.withColumn("piece", F.concat(head, F.col("text"), F.lit(CLOSE))).withColumn("lead", F.length(head))
    before = Window.partitionBy("conv", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.col("lead")
    span = F.when(F.col("is") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("text")).alias("end")))
    parts = F.array_sort(F.collect_list(F.struct("place", "piece", "span")))
    grouped = pieces.withColumn("at", at).withColumn("span", span).groupBy("conv", "branch").agg(parts.alias("parts"))
    return grouped.select(
        "conv", "branch", F.array_join("parts.piece", "").alias("formatted"), F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_mask")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^<s>\[INST\] (.*?) \[/INST\]\n"
    return F.transform(whole, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped and joined."""
    pick = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(mask, pick), "")


def as_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each turn answers the one before it.

    Equal or null turns keep a fixed order by role and text; repeated rows are turns of their own. Rows without a conversation id
    are one conversation, whose id is ''.
    """
    conv = F.coalesce(F.col(conv_col).cast("string"), F.lit(""))
    plain = rows.select(conv.alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return plain.select("conv", place.alias("node"), (place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
