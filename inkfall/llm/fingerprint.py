"""Canonical exact digests of documents.

The canonical form of a text is NFKC of its case-folded NFKC form, with runs of white space as one
space and none at the ends.  Its fingerprint is the 128-bit xxhash of its UTF-8 bytes.  Inside each
bucket of equal digests the canonical bytes themselves are compared; should two texts of a bucket
differ, all but the least get a suffix that tells them apart, so fingerprints of documents are equal exactly
where canonical texts are.  An edited text is compared byte by byte with its own document only.

Digests are counted first.  Those that occur more than once mark their slots in a bitmap that has SPARE slots for each of
them, so that about one text in SPARE passes by chance, and only texts of marked slots go to the comparison.  Where they are too many for
a bitmap of MOST_SLOTS (a broadcast of 16 MB), texts are joined with the repeated digests instead.  The comparison sees one row of a digest from each batch (copies are compared within
the batch already), then streams over partitions sorted by digest; a group of any size takes no memory.

Defined results: a null text is empty, and the empty text has a fingerprint like any other;
repeated rows have equal fingerprints; rows without an id come after all others in descending order, in the order of a hash of their
text, as do rows of one id among themselves; a single document is its own next one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_batches, parts, per_batch, raw_texts, stored, table

SPARE = 16
MOST_SLOTS = 1 << 27
#: Colliding texts that the driver holds; a 128-bit hash has none to speak of, so more mean that something is broken.
CLASHES = 10_000
#: Keys from which the ranges of documents are made.
SAMPLED = 10_000


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode("ascii")
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""

    def make(batch: pa.RecordBatch):
        return {"doc_id": batch.column("doc_id"), "fingerprint": [digest(canonical((t or b"").decode("utf-8"))) for t in raw_texts(batch.column("text"))]}

    docs = id_text(df)
    marked = _with_suffixes(per_batch(docs, make, "doc_id long, fingerprint string"), docs)
    return marked


def repeated_digests(docs: DataFrame) -> DataFrame:
    """key, first (its first four bytes as a number) of the digests that occur more than once, as a table."""

    def digests(batch: pa.RecordBatch):
        keys = [bytes.fromhex(digest(canonical((t or b"").decode("utf-8")))) for t in raw_texts(batch.column("text"))]
        return {"key": keys, "first": [_first(k) for k in keys]}

    counted = per_batch(docs.select("text"), digests, "key binary, first long").groupBy("key", "first").count()
    return stored(counted.where("count > 1").select("key", "first"), "digests")


def _first(key: bytes) -> int:
    return int.from_bytes(key[:4], "little")


def slots_of(repeated: DataFrame, n: int) -> np.ndarray | None:
    """The marked slots of a bitmap for n repeated digests, packed; None if they are too many for one."""
    slots = 1 << max(16, (SPARE * n - 1).bit_length())
    if slots > MOST_SLOTS:
        return None
    marked = np.zeros(slots, bool)
    marked[repeated.select((F.col("first") % slots).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True  # MOST_SLOTS / SPARE rows at most
    return np.packbits(marked, bitorder="little")


def collisions(docs: DataFrame) -> DataFrame:
    """fingerprint, canon_sha256: canonical texts of buckets with different ones.  All but always empty."""
    repeated = repeated_digests(docs)
    n = repeated.count()
    bits = slots_of(repeated, n)
    sent = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def make(batch: pa.RecordBatch):
        seen: dict[tuple[str, bytes], bytes] = {}
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for text in raw_texts(batch.column("text")):
            canon = canonical((text or b"").decode("utf-8"))
            key = digest(canon)
            if sent is not None:
                at = _first(bytes.fromhex(key)) % (8 * len(sent.value))
                if not sent.value[at >> 3] >> (at & 7) & 1:
                    continue
            if (key, canon) not in seen:
                seen[key, canon] = squeeze.compress(canon)
        return {"key": [bytes.fromhex(k) for k, _ in seen], "canon": list(seen.values())}

    def compare(batches):
        key, held = None, []  # the different canonical texts of the current bucket, compressed: one, but for a collision
        for batch in batches:
            found = []
            for k, z in zip(batch.column("key").to_pylist(), batch.column("canon").to_pylist()):
                if k != key:
                    found += [(key, x) for x in held] if len(held) > 1 else []
                    key, held = k, [z]
                elif z not in held:
                    if zstandard.decompress(z) not in [zstandard.decompress(x) for x in held]:
                        held.append(z)
            if found:
                yield _named(found)
        if len(held) > 1:
            yield _named([(key, x) for x in held])

    rows = per_batch(docs.select("text"), make, "key binary, canon binary")
    if sent is None:
        rows = rows.join(repeated.select("key"), "key", "left_semi")
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), compare, "fingerprint string, canon_sha256 string")


def _named(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"fingerprint": [k.hex() for k, _ in found], "canon_sha256": [hashlib.sha256(zstandard.decompress(z)).hexdigest() for _, z in found]})


def _clashing(docs: DataFrame) -> dict[tuple[str, str], str]:
    """Suffixes of colliding canonical texts; a 128-bit hash leaves none to speak of."""
    found: dict[str, list[str]] = {}
    rows = collisions(docs).limit(CLASHES + 1).collect()
    if len(rows) > CLASHES:
        raise RuntimeError(f"more than {CLASHES} different texts share 128-bit digests")
    for row in rows:
        found.setdefault(row["fingerprint"], []).append(row["canon_sha256"])
    return {(k, s): f"-{i}" for k, v in found.items() for i, s in enumerate(sorted(v)) if i}


def _with_suffixes(marked: DataFrame, docs: DataFrame) -> DataFrame:
    clash = _clashing(docs)
    if not clash:
        return marked

    def make(batch: pa.RecordBatch):
        out = []
        for text in raw_texts(batch.column("text")):
            canon = canonical((text or b"").decode("utf-8"))
            out.append(digest(canon) + clash.get((digest(canon), hashlib.sha256(canon).hexdigest()), ""))
        return {"doc_id": batch.column("doc_id"), "fingerprint": out}

    return per_batch(docs, make, "doc_id long, fingerprint string")


def _neighbours(docs: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """Rows dealt by ranges of their keys and sorted there, so that each row's predecessor is the row before.

    A key is whether there is an id, the id and a hash of the text: rows without an id come before all others, by that hash, so many of them
    are spread like others.  Ranges [s_j, s_j+1) begin at keys that exist.  The rows of s_j go to range j, where they come
    first and only serve as predecessors, and to range j - 1, where they come last.  The
    predecessor of the least key is the greatest; its row goes first in range 0 (``lead``)."""
    n = parts(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    key = F.struct("named", "doc_id", "hash")
    most = keyed.agg(F.max(key).alias("k")).first()["k"]
    most = tuple(most) if most else None
    # SAMPLED rows, each as likely as any other, so rows that are repeated count as often as they are there.
    sample = sorted(tuple(r["k"]) for r in keyed.select(key.alias("k"), F.xxhash64("hash", F.monotonically_increasing_id()).alias("by")).orderBy("by", "k").limit(SAMPLED).select("k").collect())
    at = sorted({sample[len(sample) * j // n] for j in range(1, n)}) if sample else []

    def make(batch: pa.RecordBatch):
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("named", "doc_id", "hash"))))
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
        rows = []
        for k, text in zip(keys, raw_texts(batch.column("text"))):
            z, home = squeeze.compress(text), bisect_right(at, k)
            rows.append((home, *k, False, z))
            if home and at[home - 1] == k:
                rows.append((home - 1, *k, False, z))
            if k == most:
                rows.append((0, *k, True, z))
        return dict(zip(("range", "named", "doc_id", "hash", "lead", "packed"), zip(*rows)))

    dealt = per_batch(keyed, make, "range int, named boolean, doc_id long, hash long, lead boolean, packed binary")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", F.desc("lead"), "named", "doc_id", "hash", "packed"), at


def edited_digests(df: DataFrame) -> DataFrame:
    """What the query returns; the next document is the one before in ascending order of ids."""
    docs = id_text(df)
    clash = _clashing(docs)
    rows, at = _neighbours(docs)

    def named(canon: bytes) -> str:
        key = digest(canon)
        return key + clash.get((key, hashlib.sha256(canon).hexdigest()), "") if clash else key

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        before = None  # (range, canonical bytes, fingerprint, text) of the row before
        for batch in batches:
            out = []
            for where, known, i, h, lead, z in zip(*(batch.column(c).to_pylist() for c in ("range", "named", "doc_id", "hash", "lead", "packed"))):
                text = unpack.decompress(z).decode("utf-8")
                canon = canonical(text)
                mark = named(canon)
                owned = not lead and not (where > 0 and at[where - 1] == (known, i, h))
                if owned:
                    assert before is not None and before[0] == where
                    cut = len(text) // 3
                    edited = text[: len(text) - cut] + before[3][:cut]
                    new = canonical(edited)
                    new_mark = named(new)
                    out.append(
                        (i if known else None, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), mark, new_mark, float(mark == new_mark and canon == new), float(mark == before[2] and canon == before[1])),
                    )
                before = (where, canon, mark, text)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return map_batches(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_digests(table(spark, sf_dir, "documents"))
