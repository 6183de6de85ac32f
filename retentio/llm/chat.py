"""Chat formatting of reply trees.

Messages name their parent. Self-joins double the reach of the ancestor table
(1, 2, 4, ... steps) until no message has an ancestor that far; the leaves'
paths are then enumerated from the widest step to the narrowest, so a path of n
messages takes log2(n) joins instead of n. The paths of a tree are ranked by
the sum of their messages' scores, and each chosen path becomes one
conversation: a string with turn marks, and the spans under the loss mask
(assistant texts).

Template: ``<|role|>\\n`` text ``</s>\\n`` per turn. Inside a text one backslash is put
after each ``<`` and ``[`` and taken away again when read; so no control
string (they all begin with one of these) can occur in a text, and any text
comes back unchanged.

Defined results: a message whose parent is missing is a root; messages on a
cycle have no root-to-leaf path and are in no conversation; null texts and
roles are empty; null scores are 0; ties between paths go to the smaller leaf
key; a null tree is a tree; an empty table gives no rows. Turns of a flat
conversation are ordered by turn, role, text; repeated rows are turns of their
own. A conversation is one output row, so it must fit a task.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches, text_or_empty

LOSS_ROLE = "assistant"
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def render(roles, texts) -> tuple[str, list[tuple[int, int]]]:
    """(the conversation, spans under the loss mask in code points, of the escaped texts)."""
    out, spans, at = [], [], 0
    for role, text in zip(roles, texts):
        head, body = "<|" + escape(role).replace("|", "|\\") + "|>\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, "</s>\n")
        at += len(head) + len(body) + 5
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(r.replace("|\\", "|")), unescape(t)) for r, t in _TURN.findall(formatted)]


def _key(tree: Column, message: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("t"), tree.cast("string")), F.lit("-")), F.lit("/"), message.cast("string"))


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, rank, node, dist): the messages of the ``top`` best root-to-leaf paths of each tree.

    ``messages``: tree_id, msg_id (unique in its tree), parent_id, score.
    """
    nodes = cut_lineage(messages.select(
        F.coalesce(F.concat(F.lit("t"), F.col("tree_id").cast("string")), F.lit("-")).alias("tree"),
        _key(F.col("tree_id"), F.col("msg_id")).alias("node"), _key(F.col("tree_id"), F.col("parent_id")).alias("parent"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    bound = max(1, nodes.count()).bit_length()
    step = cut_lineage(nodes.select(F.col("node").alias("low"), F.col("parent").alias("high")).where("high is not null")
                       .join(nodes.select(F.col("node").alias("high")), "high", "left_semi").select("low", "high"))
    ups = []
    # a cycle would go on for ever: no path is longer than the table
    while len(ups) < bound and not step.isEmpty():
        ups.append(step)
        far = step.select(F.col("low").alias("high"), F.col("high").alias("top"))
        step = cut_lineage(step.join(far, "high").select("low", F.col("top").alias("high")))
    parents = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = nodes.join(parents, "node", "left_anti")
    found = cut_lineage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")))
    for k in range(len(ups) - 1, -1, -1):
        higher = found.join(ups[k], found["node"] == ups[k]["low"]).select(
            "tree", "leaf", F.col("high").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        found = cut_lineage(found.unionByName(higher))
    totals = found.join(nodes.select("node", "score"), "node").groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "leaf")
    chosen = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("leaf", "rank")
    return found.join(chosen, "leaf").select("leaf", "rank", "node", "dist")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen path: tree_id, rank, n_turns, formatted, loss_spans (start, end in code points).

    ``messages``: tree_id, msg_id, parent_id, role, text, score.
    """
    small_batches(messages.sparkSession)
    told = messages.select("tree_id", _key(F.col("tree_id"), F.col("msg_id")).alias("node"),
                           text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    turns = paths(messages, top).join(told, "node").groupBy("leaf", "rank").agg(
        F.first("tree_id").alias("tree_id"),
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<struct<start:int,end:int>>")
    def rendered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            rows = [render(r, t) for r, t in zip(roles, texts)]
            yield pd.DataFrame({"formatted": [f for f, _ in rows],
                                "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in rows]})

    done = turns.select("tree_id", "rank", F.size("turns").cast("long").alias("n_turns"),
                        rendered(F.col("turns.role"), F.col("turns.text")).alias("r"))
    return done.select("tree_id", "rank", "n_turns", "r.formatted", "r.loss_spans")


def as_messages(conversations: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees of one branch."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.xxhash64("text"))
    n = F.row_number().over(order)
    numbered = conversations.select(F.col("conv_id").alias("tree_id"), n.cast("long").alias("msg_id"), "role", "text")
    return numbered.withColumns({"parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1), "score": F.lit(0.0)})


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from the formatted strings and their loss spans."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            rows = []
            for text, spans in zip(texts, masks):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col("tree_id").alias("conv_id"), read("formatted", "loss_spans").alias("d")).select("conv_id", "d.*")
