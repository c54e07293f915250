"""Mixing sources to target weights by pivotal dependent rounding.

A document's copies are a number between 0 and 2: its source's target over its source's size.
The whole part is certain; the rest is a probability.  Pivotal rounding takes two documents of a
source with fractional probabilities, and at random moves mass from one to the other until one of
the two is 0 or 1.  Mass is words: what one gives in (size x probability) the other gets, so a
source's expected words stay what they are at every step, and each probability is a martingale.
A document that is LARGE in its group is not paired with one other, as it would stay fractional beside
small ones to the end, but with all smaller ones at once, which share what it gives or takes, each by the room it has.
Within a group this leaves one fractional document; these residuals go up a tree: groups of a
source's documents (by a hash, GROUP documents on average), then groups of FAN groups,
until one is left for each source.  With them go RESERVE documents of each group, small ones and others, that had a probability too.  When the
last residual is rounded, it and the reserve (in a source of one group: all its documents) decide how near the source's words come to its
target: roundings are turned over, one or two at a time, as long as that brings the words nearer, and among few documents all choices are tried.

Randomness is a hash of seed, level and document id: reruns agree, whatever the partitioning.
Rows that are alike in id, source and text are one unit with as many expected copies as they have together, counted
before the shuffle, so no group grows with repeated rows; the unit's copies are dealt evenly.

Defined results: sizes count words of ``[^\x20\x09-\x0D]+``; a null or empty text has size 0 and
is taken 0 times; a null source is a source of its own, last in order; rows with the same
id and different texts are separate documents; rows without an id are too.  The number of sources is what the driver holds (one
row each), not the number of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
GROUP, FAN = 4000, 64
#: A document with more than this share of its group's words is large.
LARGE = 0.004
#: Rounded documents that a group hands up for the last choice, and how many are few enough to try all choices.
RESERVE, FEW = 200, 14
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: by weight, at most ``most`` times its size, the excess reshared by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values()) * share
    done: dict[str | None, float] = {}
    while True:
        left, free = total - sum(done.values()), [s for s in names if s not in done]
        unit = left / sum(weight[s] for s in free) if free else 0.0
        above = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not above:
            return done | {s: unit * weight[s] for s in free}
        done |= {s: most * sizes[s] for s in above}


def _draw(level: int, a: int, b: int, seed: int) -> float:
    return xxhash.xxh3_64_intdigest(f"{level}:{a}:{b}".encode(), seed) / 2.0**64


def _open(p: np.ndarray) -> np.ndarray:
    return (p > 0) & (p < 1)


def _settle(ids: np.ndarray, mass: np.ndarray, p: np.ndarray, level: int, seed: int) -> None:
    """Large documents come to 0 or 1, each in exchange with all smaller ones that are still open.  ``mass`` falls."""
    total = mass.sum()
    for i in np.flatnonzero(mass > LARGE * total).tolist():
        rest = np.flatnonzero(_open(p[i + 1 :])) + i + 1
        if not 0 < p[i] < 1 or not len(rest):
            continue
        up, down = (1 - p[i]) * mass[i], p[i] * mass[i]
        room = p[rest] * (1 - p[rest]) * mass[rest]  # one share for both ways, so that nobody's expectation moves
        room /= room.sum()
        if (up * room > p[rest] * mass[rest]).any() or (down * room > (1 - p[rest]) * mass[rest]).any():
            continue
        if _draw(level, int(ids[i]), -1, seed) < p[i]:
            p[rest] -= up * room / mass[rest]
            p[i] = 1
        else:
            p[rest] += down * room / mass[rest]
            p[i] = 0
        p[rest] = _clean(p[rest])


def _clean(p: np.ndarray) -> np.ndarray:
    return np.where((p < 1e-9) | (p > 1 - 1e-9), np.round(p), p)


def pivotal(ids: np.ndarray, mass: np.ndarray, p: np.ndarray, level: int, seed: int) -> np.ndarray:
    """Probabilities after rounding all but one of them, in the given order (mass falls).  Words are conserved."""
    p = np.where(mass > 0, _clean(p.astype(np.float64)), np.round(p))
    _settle(ids, mass, p, level, seed)
    hold = -1
    for i in np.flatnonzero(_open(p)).tolist():
        if hold < 0:
            hold = i
            continue
        a, b = hold, i
        sa, sb = mass[a], mass[b]
        up = min((1 - p[a]) * sa, p[b] * sb)  # most words that a can take from b
        down = min(p[a] * sa, (1 - p[b]) * sb)
        move = up if _draw(level, int(ids[a]), int(ids[b]), seed) * (up + down) < down else -down
        p[a] += move / sa
        p[b] -= move / sb
        p[[a, b]] = _clean(p[[a, b]])
        hold = next((x for x in (b, a) if 0 < p[x] < 1), -1)
    return p


def nearest(mass: np.ndarray, p: np.ndarray, free: np.ndarray, want: float) -> np.ndarray:
    """Roundings ``p`` (0 or 1) with some of the ``free`` ones turned over so that their words come near to ``want``."""
    p, at = p.copy(), np.flatnonzero(free)
    if len(at) <= FEW:
        fixed = float((mass * p)[~free].sum())
        chosen = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = np.abs(chosen @ mass[at] + fixed - want)
        turned = (chosen != p[at]).sum(axis=1)
        p[at] = chosen[np.lexsort((np.arange(len(off)), turned, np.round(off, 6)))[0]]
        return p
    miss = want - float((mass * p).sum())
    while abs(miss) > 0.5:
        change = np.where(p[at] == 0, mass[at], -mass[at]).astype(np.float64)
        order = np.argsort(change, kind="stable")
        ranked = change[order]
        # For each document the partner that brings the two nearest.
        found = []
        right = np.searchsorted(ranked, miss - ranked)
        for near in (right - 1, right, right + 1):
            near = np.clip(near, 0, len(at) - 1)
            off = np.where(near == np.arange(len(at)), np.inf, np.abs(miss - ranked - ranked[near]))
            found.append((float(off.min()), int(off.argmin()), int(near[off.argmin()])))
        two = min(found)
        one = int(np.abs(miss - ranked).argmin())
        turn = [one] if abs(miss - ranked[one]) <= two[0] else list(two[1:])
        left = miss - float(ranked[turn].sum())
        if abs(left) >= abs(miss) - 1e-6:
            break
        p[at[order[turn]]] = 1 - p[at[order[turn]]]
        miss = left
    return p


def _reserve(mass: np.ndarray, free: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which free documents go up: half of RESERVE by size, the least first, half by ``key``."""
    at = np.flatnonzero(free)
    out = np.zeros(len(mass), bool)
    out[at[np.argsort(mass[at], kind="stable")[: RESERVE // 2]]] = True
    out[at[np.argsort(key[at], kind="stable")[: RESERVE // 2]]] = True
    return out


UNIT = "src int, grp long, doc_id long, mark long, size long, p double, up boolean"


def _round(df: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree: each (src, grp) keeps at most one fractional unit, which goes ``up`` with a reserve; the last level keeps none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], kind="stable")
        ids, mass, p = (pdf[c].to_numpy() for c in ("doc_id", "size", "p"))
        key = ids ^ pdf["mark"].to_numpy()
        free = _open(_clean(p)) | pdf["up"].to_numpy()
        got = pivotal(key, mass, p, level, seed)
        if last:  # words are conserved up to here
            pdf["p"], pdf["up"] = nearest(mass, np.floor(got + 0.5), free, float((mass * p).sum())), False
        else:
            pdf["p"], pdf["up"] = got, _open(got) | _reserve(mass, free & ~_open(got), key)
        return pdf

    return df.groupBy("src", "grp").applyInPandas(run, UNIT)


def _units(docs: DataFrame):
    """Rows alike in id, source and text, and how many there are; a unit is known by its source, doc_id and mark."""
    text = F.col("text").cast("string")
    sized = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"),  # Python sees no null ids: a column with both would come as floats
        F.col("doc_id").isNotNull().alias("named"),
        F.col("source").cast("string").alias("source"),
        _mark(F.col("doc_id"), text).alias("mark"),
        _size(text).alias("size"),
    )
    return sized.groupBy("doc_id", "named", "source", "mark", "size").agg(F.count("*").alias("rows"))


def _mark(doc_id, text):
    """Tells the texts of one id apart, and rows without an id (-1 here) from those of id -1."""
    return F.xxhash64(doc_id.isNotNull(), F.coalesce(text, F.lit("")))


def _size(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _copies(docs: DataFrame, seed: int, weights, share: float, most: float) -> DataFrame:
    """Units with source_size, target and ``copies`` of all their rows together."""
    spark = docs.sparkSession
    units = stored(_units(docs), "sizes")
    found = {r["source"]: r for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("n"), F.count("*").alias("units")).collect()}  # a row for each source
    want = targets({s: r["n"] for s, r in found.items()}, weights, share, most)
    rows = [(i, s, r["n"], want[s], want[s] / r["n"] if r["n"] else 0.0, -(-r["units"] // GROUP)) for i, (s, r) in enumerate(found.items())]
    sources = spark.createDataFrame(rows, "src int, name string, source_size long, target double, rate double, groups long")
    joined = units.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).withColumn("expected", F.col("rate") * F.col("rows"))
    grp = F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.col("groups")).alias("grp")
    grouped = joined.where("size > 0").select("src", grp, "doc_id", "mark", "size", (F.col("expected") - F.floor("expected")).alias("p"), F.lit(False).alias("up"))
    # The tree: what does not go up is done.
    done, groups, level = [], max((r[5] for r in rows), default=1), 0
    while True:
        last = groups <= 1
        rounded = stored(_round(grouped, level, seed, last), "pivotal")
        done.append(rounded.where("not up"))
        if last:
            break
        grouped = rounded.where("up").withColumn("grp", F.floor(F.col("grp") / FAN))
        groups, level = -(-groups // FAN), level + 1
    picked = done[0]
    for more in done[1:]:
        picked = picked.union(more)
    whole = joined.join(picked.select("src", "doc_id", "mark", F.col("p").cast("long").alias("more")), ["src", "doc_id", "mark"], "left")
    copies = F.when(F.col("size") > 0, F.floor("expected") + F.coalesce("more", F.lit(0))).otherwise(0)
    return whole.select("doc_id", "named", "source", "mark", "size", "rows", "source_size", "target", copies.alias("copies"))


def mixed_copies(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies: a row for each row of ``docs`` (doc_id, text, source)."""
    units = _copies(docs, seed, weights, share, most)
    each = units.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("at") <= F.col("copies") % F.col("rows")).cast("long")
    return each.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", own.cast("int").alias("copies"))


def mixed(df: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (0, 1 or 2 times), with all their columns."""
    units = _copies(df, seed, weights, share, most).where("copies > 0")
    names = {c: fresh(df, f"mixed_{c}") for c in ("doc_id", "source", "mark", "rows", "copies")}
    units = units.select(*[F.col(c).alias(n) for c, n in names.items()])
    mark, nth = fresh(df, "mark"), fresh(df, "nth")
    rows = df.withColumn(mark, _mark(df["doc_id"], F.col("text").cast("string")))
    same = (F.coalesce(rows["doc_id"].cast("long"), F.lit(-1)) == F.col(names["doc_id"])) & (rows[mark] == F.col(names["mark"]))
    same &= rows["source"].cast("string").eqNullSafe(F.col(names["source"]))
    joined = rows.join(units, same)
    single = joined.where(F.col(names["rows"]) == 1).withColumn(nth, F.lit(1))
    order = W.partitionBy(*[names[c] for c in ("doc_id", "source", "mark")]).orderBy(names["mark"])
    several = joined.where(F.col(names["rows"]) > 1).withColumn(nth, F.row_number().over(order))
    n, all_ = F.col(names["rows"]), F.col(names["copies"])
    times = (F.floor(all_ / n) + (F.col(nth) <= all_ % n).cast("long")).cast("int")
    return single.union(several).withColumn(nth, F.explode(F.array_repeat(F.lit(1), times))).select(*df.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed_copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
