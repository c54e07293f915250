"""Merkle manifest of a dataset: a digest for each row, group and table, and for each row the proof that leads to the root.

Levels are made by windows.  Nodes of a group are numbered; the nodes of one parent are a window
partition (group, number / FAN), and the ordered list over its full frame gives both the parent's preimage and each node's
siblings.  Parents are made once (by the first node of each run) and written before the next level.
Every partition holds FAN rows at most, so a group with a third of all rows is as even as any other.

Numbering needs an order within each group without bringing a group into one task: rows are dealt by
ranges of (group, order), and a row's number is its place within its task's part of the group plus the rows that
earlier tasks hold of it.  Proofs come down from the root: a level's rows meet the rows of their parents, one
sixteenth of them, so every row is joined once on a key that FAN rows share.

Defined results: a null value is ``-`` in a preimage and an empty text ``0:``; null groups are one group, first in order; rows
without an order value come first, and rows of one order value are ordered by digest, so copies have
equal digests and their places are interchangeable; a group of one row is its own subroot; a table without rows has no
manifest rows.  Columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, stored, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:string,after:string>>"


def digest(*inputs: Column) -> Column:
    """Lowercase hex of the SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """One value of a leaf's preimage: its bytes in UTF-8 behind their number."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (grp and others) with ``idx``, from 0 within the group in the given order, and ``n``, the nodes of the group."""
    # The place in the stored table parts rows that are alike, so that a row that is repeated very often is spread too.
    placed = nodes.withColumn("_at", F.monotonically_increasing_id())
    keys = ["grp", *order, "_at"]
    ranged = placed.repartitionByRange(parts(nodes.sparkSession), *[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys])
    # The id of a sorted row: its task in the upper bits, its place there in the lower 33.
    ranked = stored(ranged.drop("_at").withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)), "ranked")
    held = ranked.groupBy("grp", "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy("grp").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("grp", "_task", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy("grp")).alias("n"))
    # A row for each task and group.
    return ranked.join(held, ["grp", "_task"]).withColumn("idx", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_task", "_first", "_before")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes with ``run``, the digests of their parent's nodes in order."""
    whole = W.partitionBy("grp", F.col("up")).orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return nodes.where("n > 1").withColumn("up", F.floor(F.col("idx") / FAN)).withColumn("run", F.collect_list("node").over(whole))


class Tree:
    """The levels over numbered nodes (grp, idx, n, node), from the leaves up; each group ends in one node.

    The number of levels is what the driver learns: log of the largest group."""

    def __init__(self, leaves: DataFrame):
        self.levels = [leaves]
        most = leaves.agg(F.max("n")).first()[0] or 0
        while most > 1:
            first = _runs(self.levels[-1]).where(F.col("idx") % FAN == 0)
            made = first.select("grp", F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), digest(F.array_join("run", "")).alias("node"))
            self.levels.append(stored(made, "level"))
            most = -(-most // FAN)

    def tops(self) -> DataFrame:
        """(grp, top): the last node of each group."""
        found = [level.where("n = 1").select("grp", F.col("node").alias("top")) for level in self.levels]
        for more in found[1:]:
            found[0] = found[0].union(more)
        return found[0]

    def with_paths(self, tops: DataFrame, carried: list[str]) -> DataFrame:
        """The leaves with ``path`` (for each level the siblings before and after) and the columns ``carried`` of
        ``tops`` (grp, path and those), which lie behind the last node of each group."""
        above = None
        for level in reversed(self.levels):
            ends = level.where("n = 1").join(tops, "grp")
            if above is None:
                above = ends
                continue
            place = (F.col("idx") % FAN).cast("int")
            step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(FAN)), "").alias("after"))
            parents = above.select("grp", F.col("idx").alias("up"), *carried, F.col("path").alias("_on"))
            joined = _runs(level).join(parents, ["grp", "up"]).withColumn("path", F.concat(F.array(step), "_on"))
            above = joined.drop("up", "run", "_on").unionByName(ends)
        return above


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, node, lambda got, s: digest(s["before"], got, s["after"]))


def manifest(df: DataFrame, group: str = "source", order: str = "doc_id", fields=FIELDS, more: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``df``: order, group, leaf, subroot, root, path, and the columns ``more`` (small ones, made of the row)."""
    more = more or {}
    group_text = df[group].cast("string")
    made = df.select(
        F.when(group_text.isNull(), "").otherwise(F.concat(F.lit(":"), group_text)).alias("grp"),  # null first, then by bytes
        F.col(order).alias("ord"), leaf(*[df[f] for f in fields]).alias("node"), *[c.alias(f"more_{n}") for n, c in more.items()],
    )
    leaves = Tree(stored(numbered(stored(made, "leaves"), ["ord", "node"]), "numbered"))
    tops = stored(leaves.tops(), "subroots")
    roots = Tree(stored(numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("sub"), F.col("top").alias("node")), ["sub"]), "roots"))
    end = roots.tops().select("grp", F.col("top").alias("root"), F.array().cast(STEP).alias("path"))
    joints = roots.with_paths(end, ["root"]).select(F.col("sub").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    got = leaves.with_paths(stored(joints, "joints"), ["subroot", "root"])
    name = F.when(F.col("grp") != "", F.substr("grp", F.lit(2)))
    return got.select(F.col("ord").alias(order), name.alias(group), F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(f"more_{n}").alias(n) for n in more])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, leaf(*[lower_ascii(docs[f]) if f == "text" else docs[f] for f in FIELDS]))
    got = manifest(docs, more={"changed": changed})
    got = got.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"))
