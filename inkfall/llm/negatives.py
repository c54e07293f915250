"""Hard negatives by dual-tree search on inner products.

Vectors are dealt to blocks by a tree of coordinate splits (fitted on FIT_ROWS vectors, first by a hash), so that a block holds
neighbours; inside of a block a tree cuts them further, down to leaves of LEAF vectors.  Anchors make groups
with trees of their own.  Every node has a ball, and for two balls the inner products lie within
c1.c2 +- (r1 |c2| + r2 |c1| + r1 r2).  A pair of nodes whose interval cannot change any anchor's result is
left with all that is below it: first group against block, in the join, then node against node, at last the anchors of a leaf against
a leaf.  The pairs of leaves that remain are scored exactly.

Two searches.  The first keeps each anchor's best rows of its own label; it starts from a bound that the anchor's own block gives.
The second keeps, for each positive, the best rows of other labels within a band of scores.

Groups are sent to the blocks SENT bytes at a time, so a broadcast is bounded whatever the number of anchors; a
row leaves a task only if it is among the best that the task has seen for its anchor.  A cell with very many vectors is dealt to as many blocks
as it needs by a hash of the row.

Defined results: scores are whole numbers, exact at any size that a long holds (beyond 2**53 by Python's integers); a shorter vector
counts as padded with zeros; ties go to the smaller id, rows without an id come last and are never anchors; rows that repeat an id are rows of
their own; an anchor without positives, or a positive without rows in its band, has no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, stored, table

LEAF, BLOCK, GROUP = 64, 4096, 1024
FIT_ROWS, CELLS = 2048, 256
#: Bytes of vectors in a group, and in the groups of one broadcast.
HELD, SENT = 8 << 20, 32 << 20
NO_ID = (1 << 63) - 1
EXACT = float(1 << 53)


# --- trees ----------------------------------------------------------------


def matrix(vectors) -> np.ndarray:
    """Rows of equal length, shorter ones padded with zeros."""
    wide = max(map(len, vectors), default=0)
    if all(len(v) == wide for v in vectors):
        return np.array(list(vectors), np.float64).reshape(len(vectors), wide)
    out = np.zeros((len(vectors), wide))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class Ball:
    """A tree over rows, with the ball of each node.  A node's rows are a slice of ``order``; it is cut in two at the widest gap
    (of the middle three quarters) of the coordinate that varies most, so that rows close together stay together.

    ``x``, ``labels`` and the columns of ``more`` are kept in the tree's order."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, **more: np.ndarray):
        self.spans, children, order = [(0, len(x))], [], np.arange(len(x))
        while len(children) < len(self.spans):
            lo, hi = self.spans[len(children)]
            cut = self._cut(x, order, lo, hi)
            children.append((len(self.spans), len(self.spans) + 1) if cut else (-1, -1))
            if cut:
                self.spans += [(lo, cut), (cut, hi)]
        self.left, self.right = np.array(children, np.int64).T
        self.x, self.labels, self.more = x[order], labels[order], {n: v[order] for n, v in more.items()}
        self.center = np.array([self.x[a:b].mean(axis=0) for a, b in self.spans])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(self.spans, self.center)])
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        self.most = float(np.sqrt((x**2).sum(axis=1)).max())
        self.least_label, self.most_label = self.over(self.labels, np.min), self.over(self.labels, np.max)

    @staticmethod
    def _cut(x: np.ndarray, order: np.ndarray, lo: int, hi: int) -> int:
        """Where the slice is cut, in order then; 0 if it is a leaf."""
        n = hi - lo
        if n <= LEAF or not x.shape[1]:
            return 0
        part = order[lo:hi]
        spread = np.var(x[part], axis=0)
        if not spread.max() > 0:
            return 0
        values = x[part, spread.argmax()]
        by = np.argsort(values, kind="stable")
        order[lo:hi] = part[by]
        return lo + n // 8 + int(np.diff(values[by[n // 8 : n - n // 8]]).argmax()) + 1

    def over(self, values: np.ndarray, of) -> np.ndarray:
        return np.array([of(values[a:b]) for a, b in self.spans])


def leaf_pairs(a: Ball, b: Ball, keep) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that are left when ``keep(i, j, low, high)`` has judged all pairs of nodes above them."""
    i = j = np.zeros(1, np.int64)
    wide, done = min(a.x.shape[1], b.x.shape[1]), []
    while len(i):
        mid = (a.center[i, :wide] * b.center[j, :wide]).sum(axis=1)
        off = a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j]
        off += 1e-9 * (np.abs(mid) + off) + 1e-6
        kept = keep(i, j, mid - off, mid + off)
        i, j = i[kept], j[kept]
        ends = (a.left[i] < 0) & (b.left[j] < 0)
        done.append((i[ends], j[ends]))
        i, j = i[~ends], j[~ends]
        # Of each other pair the node with the larger ball is cut, if it can be.
        of_a = (a.left[i] >= 0) & ((b.left[j] < 0) | (a.radius[i] >= b.radius[j]))
        ia, ja, ib, jb = i[of_a], j[of_a], i[~of_a], j[~of_a]
        i, j = np.concatenate([a.left[ia], a.right[ia], ib, ib]), np.concatenate([ja, ja, b.left[jb], b.right[jb]])
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if bound < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(a).astype(object), whole(b).astype(object).T).reshape(len(a), len(b))


# --- what a search keeps --------------------------------------------------


def exact_array(values: list) -> np.ndarray:
    """Doubles, or Python's integers where a double is not exact."""
    return np.array(values, object if any(abs(v) >= EXACT for v in values if v != -np.inf) else np.float64)


class Best:
    """The first ``k`` of each slot by score, then by id."""

    def __init__(self, slots: int, k: int, floor: list):
        self.k, self.floor = k, exact_array(floor)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)

    def add(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each of ``slots`` and a column for each of ``ids``."""
        scores = np.where(allowed, scores, -np.inf)
        least = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] > self.k else np.full(len(slots), -np.inf)
        at, col = np.nonzero(allowed & (scores >= np.maximum(least, self.floor[slots])[:, None]))
        if not len(at):
            return
        new = np.array([int(s) for s in scores[at, col]], object)
        slot, score, found = np.concatenate([self.slot, slots[at]]), np.concatenate([self.score, new]), np.concatenate([self.id, ids[col]])
        order = np.array(sorted(range(len(slot)), key=lambda x: (slot[x], -score[x], found[x])))
        slot, score, found = slot[order], score[order], found[order]
        start = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - start
        self.slot, self.score, self.id = (x[rank < self.k] for x in (slot, score, found))
        full = rank == self.k - 1
        reached = score[full]
        if self.floor.dtype != object:  # a double beyond 2**53 may have been rounded up
            reached = reached.astype(np.float64)
            reached = np.where(np.abs(reached) < EXACT, reached, np.nextafter(reached, -np.inf))
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], reached)


class Positives:
    """Rows of the anchor's label."""

    def __init__(self, group: dict, k: int):
        self.tree, self.rows = group["tree"], group["rows"]
        self.best = Best(len(self.rows), k, [-np.inf if f is None else f for f in group["floors"]])

    def limits(self):
        """The scores that each anchor can use: from, to."""
        return self.best.floor.astype(np.float64), None

    def fits(self, i, j, block: Ball) -> np.ndarray:
        a = self.tree
        return (a.least_label[i] <= block.most_label[j]) & (block.least_label[j] <= a.most_label[i])

    def score(self, lo: int, hi: int, scores: np.ndarray, at: np.ndarray, block: dict) -> None:
        allowed = (self.tree.labels[lo:hi, None] == block["labels"][None, at]) & (self.rows[lo:hi, None] != block["rows"][None, at])
        self.best.add(np.arange(lo, hi), scores, allowed, block["ids"][at])

    def found(self):
        return self.rows[self.best.slot], np.zeros(len(self.best.slot), np.int32), self.best.score, self.best.id


class Negatives:
    """Rows of other labels, for each positive in its band of scores."""

    def __init__(self, group: dict, k: int):
        self.tree, self.rows = group["tree"], group["rows"]
        bands = sorted((at, place, lo, hi) for at, (places, los, his) in enumerate(group["bands"]) for place, lo, hi in zip(places, los, his))
        self.owner, self.place = np.array([b[0] for b in bands], np.int64), np.array([b[1] for b in bands], np.int32)
        self.best = Best(len(bands), k, [b[2] for b in bands])
        self.high = exact_array([b[3] for b in bands])

    def limits(self):
        low, high = np.full(len(self.rows), np.inf), np.full(len(self.rows), -np.inf)
        np.minimum.at(low, self.owner, self.best.floor.astype(np.float64))
        np.maximum.at(high, self.owner, self.high.astype(np.float64))
        return low, high

    def fits(self, i, j, block: Ball) -> np.ndarray:
        a = self.tree
        same = (a.least_label[i] == a.most_label[i]) & (block.least_label[j] == block.most_label[j]) & (a.least_label[i] == block.least_label[j])
        return ~same

    def score(self, lo: int, hi: int, scores: np.ndarray, at: np.ndarray, block: dict) -> None:
        bands = np.flatnonzero((self.owner >= lo) & (self.owner < hi))
        if not len(bands):
            return
        own = self.owner[bands] - lo
        other = self.tree.labels[lo:hi, None] != block["labels"][None, at]
        self.best.add(bands, scores[own], other[own] & (scores[own] <= self.high[bands][:, None]), block["ids"][at])

    def found(self):
        slot = self.best.slot
        return self.rows[self.owner[slot]], self.place[slot], self.best.score, self.best.id


def meet(search, block: dict, counts: list | None = None) -> None:
    """One group of anchors against one block."""
    a, b = search.tree, block["tree"]
    low, high = search.limits()
    node_low, node_high = a.over(low, np.min), None if high is None else a.over(high, np.max)

    def keep(i, j, least, most):
        kept = (most >= node_low[i]) & search.fits(i, j, b)
        return kept if high is None else kept & (least <= node_high[i])

    pairs, wide = leaf_pairs(a, b, keep), min(a.x.shape[1], b.x.shape[1])
    for i in np.unique(pairs[0]).tolist():
        (lo, hi), leaves = a.spans[i], np.sort(pairs[1][pairs[0] == i])
        # The same interval with single anchors in place of their ball.
        mid, off = a.x[lo:hi, :wide] @ b.center[leaves, :wide].T, np.sqrt((a.x[lo:hi] ** 2).sum(axis=1))[:, None] * b.radius[leaves]
        off += 1e-9 * (np.abs(mid) + off) + 1e-6
        used = mid + off >= low[lo:hi, None]
        if high is not None:
            used &= mid - off <= high[lo:hi, None]
        leaves = leaves[used.any(axis=0)]
        if len(leaves):
            at = np.concatenate([np.arange(*b.spans[j]) for j in leaves.tolist()])
            search.score(lo, hi, products(a.x[lo:hi], b.x[at], a.most * b.most), at, block)
            if counts is not None:
                counts[0] += (hi - lo) * len(at)
    if counts is not None:
        counts[1] += len(a.x) * len(b.x)


# --- blocks and groups ----------------------------------------------------


def splits(x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and threshold of each inner node of a balanced tree of at most ``cells`` cells."""
    depth = max(0, min(cells, len(x) // 8).bit_length() - 1) if x.shape[1] else 0
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: np.arange(len(x))}
    for node in range(len(dims)):
        part = held.pop(node)
        if len(part):
            dims[node] = np.var(x[part], axis=0).argmax()
            cuts[node] = np.median(x[part, dims[node]])
        right = x[part, dims[node]] > cuts[node]
        held[2 * node + 1], held[2 * node + 2] = part[~right], part[right]
    return dims, cuts


def _placed(rows: DataFrame, dims: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """``rows`` with the ``cell`` of each vector."""
    schema = "row long, vec_id long, label long, anchor boolean, vec array<double>, cell int"

    def run(batches):
        for batch in batches:
            x, node = matrix(batch.column("vec").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 0)), np.zeros(batch.num_rows, np.int64)
            if len(dims) and batch.num_rows:
                x = np.pad(x, ((0, 0), (0, max(0, int(dims.max()) + 1 - x.shape[1]))))
                while node[0] < len(dims):
                    node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((node - len(dims)).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return map_batches(rows, run, schema)


def dealt(counts: dict[int, int], size: int) -> tuple[list[int], list[int], int]:
    """First part and number of parts of each cell, and the number of parts: neighbours share one up to ``size`` rows, large cells have several."""
    first, ways, part, room = [], [], 0, size
    for cell in range(max(counts, default=0) + 1):
        n = counts.get(cell, 0)
        if n > size:
            part += room < size
            first.append(part)
            ways.append(-(-n // size))
            part, room = part + ways[-1], size
        else:
            if n > room:
                part, room = part + 1, size
            first.append(part)
            ways.append(1)
            room -= n
    return first, ways, part + (room < size)


def _part(first: list[int], ways: list[int]) -> Column:
    cell = F.col("cell") + 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), cell)
    return of(first) + F.pmod(F.xxhash64("row"), of(ways)).cast("int")


SHAPE = "center array<double>, radius double, norm double, wide int, rows binary, ids binary, labels binary, vecs binary"


def _shape(x: np.ndarray, pdf: pd.DataFrame) -> dict:
    center = x.mean(axis=0)
    radius = float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))
    packed = {c: pdf[n].to_numpy(np.int64).tobytes() for c, n in (("rows", "row"), ("ids", "vec_id"), ("labels", "label"))}
    return {"center": center, "radius": radius, "norm": float(np.sqrt((center**2).sum())), "wide": x.shape[1], "vecs": x.tobytes(), **packed}


def opened(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, **lists: list) -> dict:
    """A block or group with its tree, all in the tree's order."""
    tree = Ball(x, labels, rows=rows, ids=ids, at=np.arange(len(x)))
    at = tree.more.pop("at").tolist()
    return {"tree": tree, "labels": tree.labels, **tree.more} | {n: [v[k] for k in at] for n, v in lists.items()}


def _opened(row: dict, **lists: list) -> dict:
    rows, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
    return opened(np.frombuffer(row["vecs"], np.float64).reshape(len(rows), row["wide"]), rows, ids, labels, **lists)


def _blocks(placed: DataFrame, part: Column, k: int) -> DataFrame:
    """Blocks, with what each anchor of theirs finds in its own block: the k-th best row of its label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, (rows, ids, labels) = matrix(pdf["vec"].tolist()), (pdf[c].to_numpy(np.int64) for c in ("row", "vec_id", "label"))
        block, seeds = opened(x, rows, ids, labels), []
        at = np.flatnonzero(pdf["anchor"].to_numpy())
        for lo in range(0, len(at), GROUP):
            own = at[lo : lo + GROUP]
            search = Positives(opened(x[own], rows[own], ids[own], labels[own], floors=[None] * len(own)), k)
            meet(search, block)
            seeds += [{"row": int(r), "floor": None if f == -np.inf else int(f)} for r, f in zip(search.rows, search.best.floor)]
        return pd.DataFrame([{"block": int(pdf["part"].iloc[0]), "seeds": seeds} | _shape(x, pdf)])

    return placed.withColumn("part", part).groupBy("part").applyInPandas(run, f"block int, seeds array<struct<row:long,floor:long>>, {SHAPE}")


BANDS = "array<struct<place:int,low:long,high:long>>"


def _groups(anchors: DataFrame) -> DataFrame:
    """Groups of anchors (part, row, vec_id, label, vec, floor, bands)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        floors = [None if pd.isna(f) else int(f) for f in pdf["floor"]]
        bands = [list(map(dict, b)) if b is not None else [] for b in pdf["bands"]]
        least = None if None in floors else min(floors)
        return pd.DataFrame([{"grp": int(pdf["part"].iloc[0]), "floors": floors, "bands": bands, "least": least} | _shape(matrix(pdf["vec"].tolist()), pdf)])

    return anchors.groupBy("part").applyInPandas(run, f"grp int, floors array<long>, bands array<{BANDS}>, least long, {SHAPE}")


def _pairs(blocks: DataFrame, groups: DataFrame, lo: int, hi: int) -> DataFrame:
    """Blocks beside the groups lo .. hi - 1, without the pairs whose interval ends below what the group can use."""
    named = groups.where(F.col("grp").between(lo, hi - 1)).select("grp", "floors", "bands", "least", *[F.col(c).alias(f"g_{c}") for c in ("center", "radius", "norm", "wide", "rows", "ids", "labels", "vecs")])
    each = blocks.drop("seeds").withColumn("grp", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    joined = each.join(F.broadcast(named), "grp")  # SENT bytes at most
    dot = F.aggregate(F.zip_with("center", "g_center", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    off = F.col("radius") * F.col("g_norm") + F.col("g_radius") * F.col("norm") + F.col("radius") * F.col("g_radius")
    return joined.where(F.col("least").isNull() | (dot + off * (1 + 1e-9) + F.abs(dot) * 1e-9 + 1e-6 >= F.col("least"))).drop("least", "center", "g_center")


FOUND = "row long, place int, id long, score long"


def _searched(blocks: DataFrame, groups: DataFrame, n_groups: int, sent: int, kind, k: int) -> DataFrame:
    """What ``kind`` of search keeps of each task's blocks, for all groups."""

    def run(batches):
        state: dict = {}
        last: tuple = (None, None)
        for batch in batches:
            for at in range(batch.num_rows):
                number, grp = batch.column("block")[at].as_py(), batch.column("grp")[at].as_py()
                if last[0] != number:
                    last = (number, _opened({c: batch.column(c)[at].as_py() for c in ("rows", "ids", "labels", "vecs", "wide")}))
                if grp not in state:
                    own = {c: batch.column(f"g_{c}")[at].as_py() for c in ("rows", "ids", "labels", "vecs", "wide")}
                    bands = [([b["place"] for b in bs], [b["low"] for b in bs], [b["high"] for b in bs]) for bs in batch.column("bands")[at].as_py()]
                    state[grp] = kind(_opened(own, floors=batch.column("floors")[at].as_py(), bands=bands), k)
                meet(state[grp], last[1])
        for search in state.values():
            row, place, score, found = search.found()
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(found, pa.int64()), pa.array(score.tolist(), pa.int64())], names=["row", "place", "id", "score"])

    got = None
    for lo in range(0, n_groups, sent):
        part = map_batches(_pairs(blocks, groups, lo, min(lo + sent, n_groups)), run, FOUND)
        got = part if got is None else got.union(part)
    return got


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("row", "place").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels that score
    ``low`` to ``high`` percent of the positive.  ``rows``: vec_id, label, anchor (boolean), vec (array of whole doubles), none null but vec_id."""
    spark = rows.sparkSession
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), (F.col("anchor") & F.col("vec_id").isNotNull()).alias("anchor"), "vec")
    sample = matrix(rows.orderBy(F.xxhash64("row"), "row").limit(FIT_ROWS).select("vec").toPandas()["vec"].tolist())  # FIT_ROWS vectors
    placed = stored(_placed(rows, *splits(sample, CELLS)), "placed")
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("int")).alias("a"), F.max(F.size("vec")).alias("wide")).collect()  # CELLS rows
    wide = max([r["wide"] for r in held], default=0)
    group = max(1, min(GROUP, HELD // (8 * max(wide, 1))))
    sent = max(1, SENT // (8 * max(wide, 1) * group))
    if not any(r["a"] for r in held):
        return spark.createDataFrame([], RESULT)
    first, ways, _ = dealt({r["cell"]: r["n"] for r in held}, BLOCK)
    blocks = stored(_blocks(placed, _part(first, ways), positives), "blocks")
    first, ways, n_groups = dealt({r["cell"]: r["a"] for r in held}, group)
    anchors = placed.where("anchor").withColumn("part", _part(first, ways)).drop("anchor", "cell")

    seeds = blocks.select(F.explode("seeds").alias("s")).select("s.row", "s.floor")
    groups = stored(_groups(anchors.join(seeds, "row", "left").withColumn("bands", F.lit(None).cast(BANDS))), "groups")
    best = stored(_first(_searched(blocks, groups, n_groups, sent, Positives, positives), positives), "positives")

    # Bands in whole numbers: low * positive <= 100 * score <= high * positive.
    ends = [F.ceil(F.col("score").cast("decimal(38,0)") * low / 100).cast("long").alias("low"), F.floor(F.col("score").cast("decimal(38,0)") * high / 100).cast("long").alias("high")]
    bands = best.select("row", F.col("nth").alias("place"), *ends).where("low <= high").groupBy("row").agg(F.collect_list(F.struct("place", "low", "high")).alias("bands"), F.min("low").alias("floor"))
    groups = stored(_groups(anchors.join(bands, "row")), "bands")
    worst = _first(_searched(blocks, groups, n_groups, sent, Negatives, negatives), negatives)

    pairs = best.select("row", F.col("nth").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    got = worst.select("row", "place", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return got.select("anchor_id", real("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative_id"), "positive_score", "negative_score")


def whole_parts(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles; null for a vector that is null or has a component that is null or not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(scaled, lambda y: F.coalesce(F.isnan(y) | (F.abs(y) == float("inf")), F.lit(True)))
    # Beyond 2**53 a double is whole.
    return F.when(~bad, F.transform(scaled, lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = got.select("vec_id", shifted.alias("label"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)).alias("anchor"), whole_parts(F.col("embedding")).alias("vec"))
    return hard_negatives(rows.where("label is not null and vec is not null"))
