"""Packing token sequences by minimum bin slack.

A document's tokens are cut at every CAPACITY ids; full pieces are sequences by themselves, and
the last piece of 1 to CAPACITY ids is what is packed.  Pieces of one length are alike, so packing
works on the counts of the lengths (CAPACITY numbers at most, whatever the size of the corpus):
the largest length left opens a window, a bitset subset-sum over the lengths left (bounded by
their counts) finds the reachable fills, the fill closest to the capacity is taken and its
multiset of lengths is backtracked.  That pattern is used as many times as the counts allow before
the next search.  A window that cannot be filled to the capacity may stop at a power of two, where
a sequence needs no padding.

Pieces then take their places by rank: the n-th piece of a length goes to the n-th place of that
length in the list of patterns.  Ranks are made per (length, salt), with offsets from a table of
counts, so one length that holds a third of all pieces is ranked in many tasks.

Defined results: a null text is empty; every document ends in id END, so an empty text is one
piece of one id; repeated rows are separate documents.  Ranks follow (doc_id, start).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, parts, per_batch, raw_texts, stored, table

CAPACITY = 2048
END = 1
#: Pieces of one length that are ranked in one task, about: a task's share of all pieces, but at least and at most so many.
LEAST_RANKED, RANKED = 1_000, 200_000

#: How a file must prepare texts for ``Tokens`` to take them apart into runs.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Tokens:
    """Ids of texts by a tokenizers file.

    If the file ignores case and white space and takes runs of letters,
    single digits and runs of other characters as pretokens (``wordwise``), then
    in a text of ASCII and Latin letters (precomposed, without apostrophes, control characters or
    special strings) a run of letters and digits and a run of punctuation are pretokens apart, so
    its ids are those of its runs in lower case; runs seen before come from a bounded cache.  All
    other texts, and all texts of other files, go through the tokenizer whole."""

    OTHER = re.compile("[^\t-\r -&(-~\xc0-\xd6\xd8-\xf6\xf8-\u024f]|<\\||\u0130")
    RUNS = re.compile(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
    LIMIT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.by_runs = self.wordwise(json.loads(self.tok.to_str()))

    @staticmethod
    def wordwise(file: dict) -> bool:
        plain = not any(file[c] for c in ("post_processor", "truncation", "padding")) and file["model"]["type"] == "BPE" and not file["model"]["dropout"]
        special = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in file["added_tokens"])
        return plain and special and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[bytes | None], at_once: int = 500) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for lo in range(0, len(texts), at_once):
            runs, whole = [], {}
            for i, text in enumerate(texts[lo : lo + at_once]):
                text = (text or b"").decode("utf-8")
                if not self.by_runs or self.OTHER.search(text):
                    whole[i] = text
                    runs.append([])
                else:
                    runs.append(self.RUNS.findall(text.lower().encode("utf-8")))
            if len(self.known) > self.LIMIT:
                self.known.clear()
            new = list(set().union(*runs).difference(self.known))
            self.known.update(zip(new, self._encode([w.decode("utf-8") for w in new])))
            coded = dict(zip(whole, self._encode(list(whole.values()))))
            for i, found in enumerate(runs):
                yield coded[i] if i in coded else b"".join(map(self.known.__getitem__, found))


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The worker's tokenizer of that file, with what it has cached."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of every document."""
    tail = np.array([end], "<u4").tobytes()

    def make(batch: pa.RecordBatch):
        tok, doc, rows = tokens(path), [], []
        for i, ids in zip(batch.column("doc_id").to_pylist(), tok.ids(raw_texts(batch.column("text")))):
            ids += tail
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                doc.append(i)
                rows.append((start, len(part) // 4, zlib.crc32(part), n))
        return {"doc_id": doc} | dict(zip(("start", "length", "ids_crc32", "doc_tokens"), zip(*rows)))

    return per_batch(id_text(df), make, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long")


def _pattern(counts: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The multiset of lengths with ``first`` whose sum is closest to the capacity, or reaches a power of two exactly."""
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []  # bit b: the sum b can be reached
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        have, many = min(int(counts[size]), room // size), 1
        while have > 0:  # parts 1, 2, 4, ... and the rest stand for any number of pieces of this length
            take = min(many, have)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            have, many = have - take, many * 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    if fill < room:
        whole = 1 << ((first + fill).bit_length() - 1)  # the largest power of two not above what can be reached
        if whole >= first and reach >> (whole - first) & 1:
            fill = whole - first
    got = {first: 1}
    for size, take, before in reversed(steps):
        if not before >> fill & 1:  # the sum needs this part
            got[size] = got.get(size, 0) + take
            fill -= size * take
    return got


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, until no piece is left.  counts[n]: pieces of length n."""
    left, out = counts.copy(), []
    for first in range(len(left) - 1, 0, -1):
        while left[first]:
            left[first] -= 1
            got = _pattern(left, first, capacity)
            left[first] += 1
            times = min(int(left[size]) // n for size, n in got.items())
            for size, n in got.items():
                left[size] -= n * times
            out.append((got, times))
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, pieces per sequence, first sequence, offset there)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for got, times in patterns:
        offset = 0
        for size in sorted(got, reverse=True):
            at = used.get(size, 0)
            out.setdefault(size, []).append((at, got[size], sequence, offset))
            used[size] = at + got[size] * times
            offset += size * got[size]
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces`` (``total`` rows) with ``rank``: 0, 1, ... within each length, by salt and then (doc_id, start)."""
    share = min(RANKED, max(LEAST_RANKED, -(-total // parts(pieces.sparkSession))))
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    salts = counts.select("length", F.greatest(F.lit(1), F.ceil(F.col("n") / share)).alias("salts"))
    # The broadcast table has a row for each length: no more than the capacity.
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts"))).drop("salts")
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    local = salted.withColumn("local", F.row_number().over(own) - 1)
    return local.join(offsets, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("base")).drop("local", "base", "salt")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # a row for each length
        counts[length] = n
    at = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # patterns: a few for each length

    def make(batch: pa.RecordBatch):
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for size in np.unique(length).tolist():
            here = np.flatnonzero(length == size)
            t = at.value[size]
            k = np.searchsorted(t[:, 0], rank[here], side="right") - 1
            nth = rank[here] - t[k, 0]
            seq[here] = t[k, 2] + nth // t[k, 1]
            off[here] = t[k, 3] + nth % t[k, 1] * size
        kept = {c: batch.column(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")}
        return kept | {"length": length.astype(np.int64), "sequence_id": seq, "offset": off}

    return per_batch(ranked(pieces, int(counts.sum())), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), default_tokenizer()))
