"""Conversations out of reply trees.

Messages (tree_id, msg_id, parent_id, role, text, score) form trees.  Pointer doubling enumerates
root-to-leaf paths: in round k a self-join gives each message its 2**k-th ancestor and the score and
length of the 2**k messages from it upwards, until the root is passed; messages that are done
leave the join.  Leaves are then ranked
within their tree by their branch's total score (then length, then id), the ``best`` first ones are
chosen, and the same jump tables, from small to large, spread each chosen leaf over its ancestors.
Rounds are log2 of the depth; texts join only the chosen paths.

Format: ``<s>``, then for each message a head that names its role, its text with control
characters escaped, and ``</s>``.  Heads are ``[INST]`` (user), ``[SYS]`` (system), ``[OUT]``
(assistant), ``[NONE]`` (no role) and ``[ROLE=name]``.  Escaping puts a backslash after ``[`` and
``<`` and doubles backslashes, so no control string occurs in a text and parsing gives all back.
The loss mask is the spans of the assistants' escaped texts.

Defined results: a null text is empty; a message whose parent is null or missing is a root;
messages in a cycle are on no path; of rows with one (tree_id, msg_id) each is a message of its own
only if the caller numbers them, as ``linear`` does (by turn, role, text); an empty table gives none.
One conversation is one row, so it must fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import per_batch, stored, table

HEADS = {"user": "[INST]", "system": "[SYS]", "assistant": "[OUT]", None: "[NONE]"}
_ROLES = {v: k for k, v in HEADS.items()}
BEGIN, END = "<s>", "</s>"
_TURN = re.compile(r"\[([A-Z]+(?:=[^\]]*)?)\](.*?)</s>", re.S)
ROUNDS = 64


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("[", "[\\").replace("<", "<\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\\\|\[\\|<\\", lambda m: m[0][0], text)


def formatted(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the loss mask: spans of code points."""
    out, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        head = HEADS[role] if role in HEADS else f"[ROLE={quote(role, safe='')}]"
        body = escaped(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    out = []
    for m in _TURN.finditer(text, len(BEGIN)):
        head = f"[{m[1]}]"
        out.append((_ROLES[head] if head in _ROLES else unquote(m[1].removeprefix("ROLE=")), unescaped(m[2])))
    return out


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, leaf, place (of the branch in its tree, from 1), depth (from the root, 0), msg_id, branch_score."""
    nodes = messages.select("tree_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m")).distinct().withColumn("there", F.lit(True))
    # A parent that doesn't exist is none.
    linked = nodes.join(known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("m")), "left")
    jump = stored(linked.select("tree_id", "msg_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("size")), "jumps")
    jumps = [jump.where("up is not null")]
    rows = jump.count()
    settled = jump.where("up is null")  # the root is within reach: nothing left to join
    for k in range(ROUNDS):
        active = jumps[-1]
        if (1 << k) > 2 * rows or not active.limit(1).count():
            break
        far = settled.union(active).select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("size").alias("longer"))
        both = active.join(far, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        moved = stored(both.select("tree_id", "msg_id", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("size") + F.col("longer")).alias("size")), "jumps")
        settled = settled.union(moved.where("up is null"))
        jumps.append(moved.where("up is not null"))
    parents = jumps[0].select(F.col("tree_id").alias("t"), F.col("up").alias("m")).distinct()
    leaves = settled.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m")), "left_anti")
    order = W.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("size"), "msg_id")
    chosen = leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
    paths = stored(chosen.select("tree_id", F.col("msg_id").alias("leaf"), "place", F.col("total").alias("branch_score"), (F.col("size") - 1).alias("depth"), "msg_id"), "paths")
    for k, step in enumerate(jumps):
        hop = step.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "up")
        moved = paths.join(hop, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m")))
        paths = stored(paths.union(moved.select("tree_id", "leaf", "place", "branch_score", F.col("depth") - (1 << k), F.col("up").alias("msg_id"))), "paths")
    return paths


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, place, branch_score, formatted, mask (spans): the best branches of every tree."""
    paths = best_paths(messages, best)
    texts = messages.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "role", "text")
    turns = paths.join(texts, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m")))
    whole = turns.groupBy("tree_id", "place", "branch_score").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def make(batch: pa.RecordBatch):
        made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        return {c: batch.column(c) for c in ("tree_id", "place", "branch_score")} | {"formatted": [m[0] for m in made], "mask": [[{"start": a, "stop": b} for a, b in m[1]] for m in made]}

    return per_batch(whole, make, "tree_id long, place int, branch_score double, formatted string, mask array<struct<start:long,stop:long>>")


def linear(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each replies to the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select(
        F.col("conv_id").cast("long").alias("tree_id"),
        F.row_number().over(order).cast("long").alias("msg_id"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return numbered.withColumns({"parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1), "score": F.lit(0.0)})


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    made = conversations(stored(linear(rows.union(more)), "messages"))

    def make(batch: pa.RecordBatch):
        out = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
            turns = parsed(text)
            loss = "".join(unescaped(text[m["start"] : m["stop"]]) for m in mask)
            whole = "".join(f"{role or ''}\n{body}\n" for role, body in turns)
            out.append((len(turns), hashlib.sha256(whole.encode("utf-8")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(text)))
        return {"conv_id": batch.column("tree_id")} | dict(zip(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), zip(*out)))

    return per_batch(made, make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
