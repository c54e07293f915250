"""Similarity join of documents by the Jaccard likeness of their word shingles.

1. Every document's set of shingle hashes is made once for its size and a 128-bit signature;
   documents with equal sets form a class, of which the least id stands for all.
2. A table of counters holds how often shingles fall into each slot, over all documents.  It has
   more slots for larger inputs (by the plan's estimate of bytes), within fixed bounds.  It gives each shingle a level: 0, or how far its slot is above the usual.
   Shingles are ordered by level and then by hash, so what very many documents share comes last.
   Any order is right, a good one is fast.
3. Blocking.  Let a and b be the shingles of x and y that the other lacks.  Among the first
   (a + b + 1)(RUN - 1) + 1 common shingles in that order there are RUN that follow each other
   without a lacking one in between (a + b breaks leave a run of that length).  So each document
   gives a key for each RUN shingles in a row within a prefix that is long enough for any like
   set's a and b, and like documents have a key in common.  Sets up to SMALL shingles, for which
   that need not hold, and those that may be like them, give their single prefix shingles as keys.
   Holders of a key are linked to its least holder; the components of these links are communities,
   and no pair of like documents lies in two of them.  Kin share runs, documents that share a
   passage hardly do.
4. Within a community the adaptive multi-match join finds the links: shingles are ordered by their
   counts there; a document's prefix may be lengthened by l - 1 shingles, and then a pair must have
   min(l, l') shingles of both prefixes in common before it is verified.  l is chosen for each
   document by estimated cost: the postings its prefix meets, and for verification the bound
   postings / l on documents met l times.  Pairs already in one component need no check.  Only
   links that join two components are emitted, never all pairs of a group.
5. Communities larger than BLOCK_ROWS sets or BLOCK_SHINGLES shingles are joined in rounds.  First in blocks
   by hash, so that a set meets its block only: near copies are one class of links then.  The
   least of each class stands for it while classes are joined in blocks anew, as long as that leaves fewer of them.  What may
   still be missing are links between sets of two classes, and such sets share a token of their prefixes (in the
   order of 2): only sets with a token that two classes hold go on, and of those the sets outside of the largest class
   meet all others, block by block.  The work is (sets outside of the largest class) x (all that are left) / block, not the square of the community.

Shingles are taken as equal if their 64-bit hashes are.  Defined results: a null text is empty; a
document without words has an empty set and no links; with fewer words than a shingle has, its
whole sequence is the one shingle.  Rows repeated with one id, and rows without an id, are documents of their own: where there
are such rows all rows are numbered and linked by number; a component's id is the least id in it, null if it has none.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, gram_hashes, id_text, map_batches, mixed, packed_texts, parts, per_batch, raw_texts, signed, stored, table, unpacked, word_hashes
from .components import components

#: Bits of the number of slots: least and most.  Of the most, a task holds 64 MB, the driver as much, and 16 MB are broadcast.
SLOT_BITS = 20, 24
#: Bytes of input for a slot, within those bounds.
SLOT_BYTES = 4096
PIECES = 16
RUN, SMALL = 3, 20
BLOCK_ROWS = 2000
BLOCK_SHINGLES = 1_500_000
LONGEST_MATCH = 6


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the text in lower case (A-Z only)."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(k, len(words))))


def _needed(n: int, percent: int) -> int:
    """Fewest common shingles a set of n can have with a like set."""
    return -(-percent * n // 100)


def _slot(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def slot_bits(docs: DataFrame) -> int:
    """By the optimizer's estimate of the input's bytes; any number is right."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // SLOT_BYTES).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


def _profiles(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows of documents (doc_id, n, sig), and each task's counters in PIECES rows (piece, counts)."""

    def run(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in (b for b in batches if b.num_rows):
            sets = [shingle_set(t, k) for t in raw_texts(batch.column("text"))]
            at, many = np.unique(_slot(np.concatenate(sets), bits), return_counts=True)
            total[at] += many.astype(np.uint32)
            n = len(sets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(list(map(len, sets)), pa.int64()), "sig": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "piece": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        for i, part in enumerate(np.split(total, PIECES)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "sig": pa.nulls(1, pa.binary()), "piece": pa.array([i], pa.int32()), "counts": pa.array([_narrow(part)], pa.binary())})

    return map_batches(docs, run, "doc_id long, n long, sig binary, piece int, counts binary")


def _narrow(part: np.ndarray) -> bytes:
    """Counts with as few bytes each as the largest needs."""
    kind = next((k for k in ("u1", "u2", "u4") if part.max() < 1 << 8 * int(k[1])), "i8")
    return kind.encode() + part.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data[2:], data[:2].decode()).astype(np.int64)


def _levels(counters: DataFrame, bits: int) -> np.ndarray:
    """The level of each slot.  The counters are summed in two steps; PIECES rows come to the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << bits) // PIECES, np.int64)
        for data in pdf["counts"]:
            total += _wide(data)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "counts": [_narrow(total)]})

    some = counters.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(32)))
    first = some.groupBy("piece", "part").applyInPandas(add, "piece int, counts binary")
    total = np.zeros((PIECES, (1 << bits) // PIECES), np.int64)
    for piece, data in first.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect():
        total[piece] = _wide(bytes(data))
    usual = max(4.0, 2 * total.mean() + 5 * math.sqrt(total.mean()))
    return np.floor(np.log2(np.maximum(total.ravel() / usual, 1))).astype(np.uint8)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Level and hash in one number, which stands for the shingle from here on: its last bits can go, as keys may agree by chance."""
    return np.sort(levels[_slot(s, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6))


def block_keys(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: like sets have one in common."""
    n, run = len(s), RUN if percent >= 75 else 1
    if not n:
        return np.empty(0, np.uint64)
    ordered = _ordered(s, levels)
    out = []
    if n * percent <= 100 * SMALL or run == 1:
        out.append(mixed(ordered[: n - _needed(n, percent) + 1]))
    if n > SMALL and run > 1:
        lacking = (100 - percent) * n / 100
        out.append(gram_hashes(ordered[: int(max(run, (run - 1) * 100 / percent) * lacking) + run + 1], run))
    return np.concatenate(out)


def _block_links(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(a, b): documents with a key in common, as links to its least holder."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # a byte for each slot: 16 MB at most

    def make(batch: pa.RecordBatch):
        keys = [block_keys(shingle_set(t, k), sent.value, percent) for t in raw_texts(batch.column("text"))]
        doc = np.repeat(batch.column("doc_id").to_numpy(), list(map(len, keys)))
        key = np.concatenate(keys)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        ends = np.append(first[1:], len(key))
        # Within a batch a key goes on once, with its other holders.
        others = [doc[a + 1 : b].tobytes() if b - a > 1 else None for a, b in zip(first.tolist(), ends.tolist())]
        return {"key": signed(key[first]), "doc_id": doc[first], "others": others}

    dealt = per_batch(docs, make, "key long, doc_id long, others binary").repartition("key").sortWithinPartitions("key", "doc_id")

    def run(batches):
        held = least = None
        for batch in batches:
            a, b = [], []
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            others = batch.column("others")
            same = np.empty(len(keys), bool)
            same[0] = keys[0] == held
            same[1:] = keys[1:] == keys[:-1]
            start = np.maximum.accumulate(np.where(same, -1, np.arange(len(keys))))
            lead = np.where(start >= 0, ids[start], least if least is not None else ids[0])
            a.append(ids[same])
            b.append(lead[same])
            for i in np.flatnonzero(others.is_valid().to_numpy(zero_copy_only=False)).tolist():
                more = np.frombuffer(others[i].as_py(), np.int64)
                a.append(more)
                b.append(np.full(len(more), lead[i]))
            held, least = keys[-1], lead[-1]
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return map_batches(dealt, run, "a long, b long")


class Forest:
    """Union-find over 0 .. n-1 whose roots are least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def adaptive_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets that join two components, by adaptive multi-match prefixes.

    Where sides are given, pairs of one side are left to other groups; sets of one label are joined already."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    alive = [i for i in range(n) if size[i]]
    if len(alive) < 2:
        return []
    tokens, inverse, df = np.unique(np.concatenate([sets[i] for i in alive]), return_inverse=True, return_counts=True)
    rank_of = np.empty(len(tokens), np.int64)
    rank_of[np.argsort(df, kind="stable")] = np.arange(len(tokens))
    df_by_rank = np.sort(df, kind="stable")
    ends = np.cumsum(size[alive])
    ranked: list[np.ndarray] = [np.empty(0, np.int64)] * n
    for i, lo, hi in zip(alive, ends - size[alive], ends):
        ranked[i] = np.sort(rank_of[inverse[lo:hi]])
    # The cheapest l of each set: scanning all postings met, and verifying the sets met l times.
    match = np.ones(n, np.int64)
    base = size - np.array([_needed(int(s), percent) for s in size]) + 1
    for i in alive:
        met = np.cumsum(df_by_rank[ranked[i][: base[i] + LONGEST_MATCH - 1]] - 1)
        best = None
        for ell in range(1, LONGEST_MATCH + 1):
            p = base[i] + ell - 1
            if p > size[i]:
                break
            cost = met[p - 1] + met[p - 1] / ell * (4 + size[i] / 64)
            if best is None or cost < best:
                best, match[i] = cost, ell
    forest, links = Forest(n), []
    if label is not None:
        first = {}
        for i, x in enumerate(label.tolist()):
            forest.join(first.setdefault(x, i), i)
    postings: dict[int, list[int]] = {}
    mark = np.zeros(len(tokens), bool)
    order = sorted(alive, key=lambda i: (size[i], i))
    for x in order:
        prefix = ranked[x][: base[x] + match[x] - 1]
        prefix = prefix[df_by_rank[prefix] > 1].tolist()
        lists = [postings[t] for t in prefix if t in postings]
        if lists:
            met, count = np.unique(np.concatenate([np.array(v, np.int64) for v in lists]), return_counts=True)
            good = (count >= np.minimum(match[met], match[x])) & (100 * size[met] >= percent * size[x])
            if side is not None:
                good &= side[met] != side[x]
            met, count = met[good], count[good]
            if len(met):
                mark[ranked[x]] = True
                for y in met[np.argsort(-count, kind="stable")].tolist():
                    if forest.find(x) != forest.find(y):
                        common = int(np.count_nonzero(mark[ranked[y]]))
                        if 100 * common >= percent * (size[x] + size[y] - common):
                            forest.join(x, y)
                            links.append((x, y))
                mark[ranked[x]] = False
        for t in prefix:
            postings.setdefault(t, []).append(x)
    return links


def _join(groups: DataFrame, percent: int, *keys: str) -> DataFrame:
    """groups (keys, doc_id, shingles, and maybe side, label) -> links (a, b) within each group."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, sets = pdf["doc_id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        side, label = (pdf[c].to_numpy() if c in pdf else None for c in ("side", "label"))
        links = adaptive_links(sets, percent, side, label)
        return pd.DataFrame({"a": ids[[x for x, _ in links]], "b": ids[[y for _, y in links]]}, dtype="int64")

    return groups.groupBy(*keys).applyInPandas(join, "a long, b long")


def _blocks(rows, shingles):
    return F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("long")


def _told(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` with what ``few`` (a row for each large community, of more than a block) says of their components.  A community may
    hold a third of all rows, so its row is there once for each task."""
    n = parts(rows.sparkSession)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n))).join(salted, ["component", "salt"], "left").drop("salt")


def _community_links(docs: DataFrame, members: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """members (doc_id, n, component) -> links (a, b) that connect what is alike within each component."""
    large = stored(members.groupBy("component").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1"), "large")
    placed = _told(members, large).withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))

    def make(batch: pa.RecordBatch):
        kept = {c: batch.column(c) for c in ("doc_id", "n", "component", "blocks")}
        return kept | {"shingles": [shingle_set(t, k).tobytes() for t in unpacked(batch.column("packed"))]}

    texts = packed_texts(docs).join(placed, "doc_id").select("doc_id", "n", "component", "blocks", "packed")
    sets = per_batch(texts, make, "doc_id long, n long, component long, blocks long, shingles binary")
    if not large.limit(1).count():
        return _join(sets, percent, "component")
    sets = stored(sets, "sets")
    found = _join(sets.where("blocks = 1"), percent, "component")
    return found.union(_large_links(sets.where("blocks > 1"), percent, levels))


ROUNDS = 8


def _labels(groups: DataFrame, percent: int, *keys: str) -> DataFrame:
    """groups (keys, doc_id, shingles) -> doc_id, label: the least id that links within the group lead to."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, forest = pdf["doc_id"].to_numpy(), Forest(len(pdf))
        for a, b in adaptive_links([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], percent):
            forest.join(a, b)
        return pd.DataFrame({"doc_id": ids, "label": ids[[forest.find(i) for i in range(len(ids))]]}, dtype="int64")

    return groups.groupBy(*keys).applyInPandas(label, "doc_id long, label long")


def _large_links(sets: DataFrame, percent: int, levels: np.ndarray) -> DataFrame:
    """sets (doc_id, n, component, shingles) of large communities -> links (a, b)."""
    labels = left = None
    chosen = sets
    for seed in range(ROUNDS):
        count = chosen.groupBy("component").agg(F.count("*").alias("rows"), _blocks(F.count("*"), F.sum("n")).alias("blocks"))
        now, most = count.agg(F.sum("rows"), F.max("blocks")).first()
        if left is not None and now > 0.9 * left:
            break
        left = now
        dealt = _told(chosen.drop("blocks"), count.select("component", "blocks")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
        found = stored(_labels(dealt, percent, "component", "block"), "labels")
        # A set's label is its class's, and that of the class's least set in this round.
        new = found.toDF("old", "new")
        labels = found if labels is None else stored(labels.join(new, F.col("label") == F.col("old"), "left").select("doc_id", F.coalesce("new", "label").alias("label")), "labels")
        if most == 1:
            break
        chosen = sets.join(found.where("doc_id = label").select("doc_id"), "doc_id", "left_semi")
    links = labels.where("doc_id <> label").toDF("a", "b")
    return links.union(_open_links(sets, labels, percent, levels))


def _open_links(sets: DataFrame, labels: DataFrame, percent: int, levels: np.ndarray) -> DataFrame:
    """Links between sets of different labels (doc_id, label)."""
    sent = sets.sparkSession.sparkContext.broadcast(levels)

    def make(batch: pa.RecordBatch):
        prefixes = []
        for x in batch.column("shingles").to_pylist():
            s = np.frombuffer(x, np.uint64)
            prefixes.append(_ordered(s, sent.value)[: len(s) - _needed(len(s), percent) + 1])
        many = list(map(len, prefixes))
        doc, component, label = (np.repeat(batch.column(c).to_numpy(), many) for c in ("doc_id", "component", "label"))
        return {"component": component, "token": signed(np.concatenate(prefixes)), "label": label, "doc_id": doc}

    labelled = stored(sets.select("doc_id", "n", "component", "shingles").join(labels, "doc_id"), "labelled")
    tokens = stored(per_batch(labelled, make, "component long, token long, label long, doc_id long"), "tokens")
    shared = tokens.groupBy("component", "token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("component", "token")
    shared = stored(shared, "shared")
    if not shared.limit(1).count():
        return labels.limit(0).toDF("a", "b")
    rest = stored(labelled.join(tokens.join(shared, ["component", "token"]).select("doc_id").distinct(), "doc_id"), "open")
    # The largest class of a community against the others; its own sets are joined already.
    most = rest.groupBy("component", "label").agg(F.count("*").alias("m")).groupBy("component").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    parted = _told(rest, most).withColumn("out", F.col("label") != F.col("main"))
    sizes = parted.groupBy("component").agg(
        *[F.coalesce(_blocks(F.sum(F.when(test, 1)), F.sum(F.when(test, F.col("n")))), F.lit(0).cast("long")).alias(name) for name, test in (("outer", F.col("out")), ("inner", ~F.col("out")))],
    )
    dealt = _told(parted, sizes).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(ROUNDS)), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))))
    # Groups: outer block i with outer block j >= i, and with each inner block j.
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    own = F.col("own")
    outer = F.transform(upto(F.col("outer")), lambda j: F.struct(F.lit(True).alias("among"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    inner = F.transform(upto(F.col("inner")), lambda j: F.struct(F.lit(False).alias("among"), own.alias("i"), j.alias("j")))
    visited = F.transform(upto(F.col("outer")), lambda i: F.struct(F.lit(False).alias("among"), i.alias("i"), own.alias("j")))
    groups = dealt.withColumn("group", F.explode(F.when(F.col("out"), F.concat(outer, inner)).otherwise(visited)))
    # Within one outer block all pairs count, else those across.
    side = F.when(~F.col("group.among"), F.col("out").cast("long")).when(F.col("group.i") < F.col("group.j"), own).otherwise(F.col("doc_id"))
    return _join(groups.select("component", "group.among", "group.i", "group.j", "doc_id", "shingles", "label", side.alias("side")), percent, "component", "among", "i", "j")


def _components(docs: DataFrame, k: int, percent: int, profiles: DataFrame, bits: int) -> DataFrame:
    """doc_id, n, component of documents with ids that are there and different."""
    levels = _levels(profiles.where("piece is not null").select("piece", "counts"), bits)
    base = profiles.where("piece is null").select("doc_id", "n", "sig")
    classes = stored(base.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("size")), "classes")
    community = components(_block_links(docs, k, percent, levels))
    members = stored(classes.join(community, F.col("rep") == F.col("id")).select(F.col("rep").alias("doc_id"), F.col("size").alias("n"), "component"), "members")
    found = components(_community_links(docs, members, k, percent, levels))
    classed = base.join(classes.drop("size"), "sig", "left").join(found, F.col("rep") == F.col("id"), "left")
    return classed.select("doc_id", "n", F.coalesce("component", "rep", "doc_id").alias("component"))


def _profiled(docs: DataFrame, k: int) -> tuple[DataFrame, int, bool]:
    """Profiles, slot bits, and whether every row has an id of its own."""
    bits = slot_bits(docs)
    profiles = stored(_profiles(docs, k, bits), "profiles")
    ids = profiles.where("piece is null")
    odd = ids.where("doc_id is null").limit(1).count() or ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return profiles, bits, not odd


def _numbered(df: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, str]:
    """``df`` with a number for each row, and (row, doc_id, n, component) by these numbers."""
    row = fresh(df, "row")
    rows = stored(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    docs = id_text(rows, id_col=row)
    profiles, bits, _ = _profiled(docs, k)
    found = _components(docs, k, percent, profiles, bits).select(F.col("doc_id").alias("row"), "n", "component")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows, found.join(ids, "row"), row


def near_components(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links lead to, for every document."""
    docs = id_text(df)
    profiles, bits, plain = _profiled(docs, k)
    if plain:
        return _components(docs, k, percent, profiles, bits).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    _, found, _ = _numbered(df.select("doc_id", "text"), k, percent)
    found = stored(found, "numbered")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` for each component, that of its least id, with all its columns."""
    docs = id_text(df)
    profiles, bits, plain = _profiled(docs, k)
    if plain:
        name = fresh(df, "kept")
        kept = _components(docs, k, percent, profiles, bits).where("doc_id = component").select(F.col("doc_id").alias(name))
        return df.join(kept, df["doc_id"].cast("long") == kept[name], "left_semi")
    rows, found, row = _numbered(df, k, percent)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    kept = first.select(F.col("least.row").alias(row))
    chosen = rows.join(kept, row, "left_semi").select(*df.columns)
    # Rows without words are linked with nothing; those of one id and text are still one.
    return chosen.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(chosen.where("doc_id is null"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=3, percent=90)
