"""Removal of repeated passages by suffix automata of reference shards.

A window is ``window`` consecutive words; one whose words also start earlier (smaller id, or
earlier in the document) is repeated, and all words it covers go.

The reference of a window is the whole corpus, so an automaton of all of it cannot be sent to
every task: it grows with the input.  Instead shards are made by content.  The minimizer of a window is the
least hash of its ``GRAM``-word runs, and windows of equal words have equal minimizers; so each
document is cut into segments, runs of windows with the same minimizer, and the minimizer's shard
gets them.  Equal segments are told from their first occurrence by key alone (already within a
batch, so that copies don't travel): what an automaton holds it matches whole.  Where a shard has several different segments, an automaton
is built over their first occurrences in document order, and its matching statistics, streamed
while it grows, give the windows that start earlier.

An automaton holds at most SHARD different segments.  A shard with more (one phrase among very many
contexts) is split by content again: its segments are cut by the minimizers of longer runs, at last by runs as long as the
window.  Then all windows of a shard are equal and its automaton is one window, however many stream through it.  So every
shard at every size gets an automaton of bounded size.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none; documents with
fewer words than a window lose nothing; rows that share an id and differ in text are documents of their own, in the order of
their texts' digests (``tag``), and rows alike in both are one document that is kept as often as it is there; rows without an id are left as they are.  Windows are judged on the input.  Words are taken as equal if their
64-bit hashes are.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import fresh, gram_hashes, id_text, map_batches, mixed, per_batch, raw_texts, signed, stored, table, unpacked

GRAM = 4
SHARD = 500
#: Bytes of texts whose words are hashed at once (a longer text by itself), and of the longest word hashed by columns.
CHUNK = 1 << 18
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_B = np.uint64(0x2545F4914F6CDD1D)
_B_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_B, _B_INVERSE)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def range_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of h[lo:hi] for many ranges, by prefix sums."""
    power, inverse = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    return mixed((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts of up to CHUNK bytes, one text at least."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def text_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and where each text's begin, with the end."""
    data = b" " + b" ".join(texts) + b" " * 16
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) <= 4)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    at, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # eight bytes from each place on
    h = mixed(size.astype(np.uint64) * _B)
    inside = size <= LONG_WORD
    for i in np.flatnonzero(~inside).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + size[i]])
    rest = slice(None) if inside.all() else np.flatnonzero(inside)
    where, left = at[rest], size[rest]
    while len(where):
        h[rest] = mixed(h[rest] ^ (eights[where] & _LOW_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        rest = more if isinstance(rest, slice) else rest[more]
        where, left = where[more] + 8, left[more] - 8
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(at, begins)


def least_at(x: np.ndarray, wide: int) -> np.ndarray:
    """Place of the least of each ``wide`` consecutive values, the first of equal ones."""
    at, have = np.arange(len(x)), 1
    while have < wide:
        step = min(have, wide - have)
        at = np.where(x[step:] < x[:-step], at[step:], at[:-step])
        x = np.minimum(x[step:], x[:-step])
        have += step
    return at


def run_lengths(window: int) -> list[int]:
    """Words of the runs whose hashes make minimizers, from level to level; the last is the window itself."""
    first = min(GRAM, window)
    return sorted({first, (first + window) // 2, window})


def segments(h: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Number of the run, minimizer, key, first window in the run and number of windows of each segment of runs of word
    hashes; the i-th run is h[begins[i]:begins[i + 1]]."""
    windows = np.maximum(np.diff(begins) - (window - 1), 0)
    if not windows.any():
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    grams = gram_hashes(h, gram)
    run = np.repeat(np.arange(len(windows)), windows)
    first = np.cumsum(windows) - windows
    place = np.arange(len(run)) + (begins[:-1] - first)[run]  # of each window in h
    at = least_at(grams, window - gram + 1)[place]
    new = np.append(True, (at[1:] != at[:-1]) | (run[1:] != run[:-1]))
    lo = np.flatnonzero(new)
    n = np.diff(lo, append=len(at))
    run, place = run[lo], place[lo]
    return run, grams[at[lo]], range_hashes(h, place, place + n + window - 1), place - begins[run], n


def _folded(mini, key, doc, tag, start, n) -> dict:
    """One row for each (mini, key), which come in the order of doc, tag and start: its first occurrence, and the others packed
    as triples of them."""
    order = np.argsort(key, kind="stable")  # equal keys are of equal words and so of one minimizer
    mini, key, doc, tag, start, n = (x[order] for x in (mini, key, doc, tag, start, n))
    first = np.flatnonzero((np.diff(mini, prepend=~mini[:1]) != 0) | (np.diff(key, prepend=~key[:1]) != 0))
    packed = np.stack([doc, tag, start], axis=1).astype(np.int64)
    ends = np.append(first[1:], len(mini))
    others = [None] * len(first)
    for k in np.flatnonzero(ends - first > 1).tolist():
        others[k] = packed[first[k] + 1 : ends[k]].tobytes()
    return {"mini": signed(mini[first]), "key": signed(key[first]), "doc_id": doc[first], "tag": tag[first], "start": start[first].astype(np.int32), "n": n[first].astype(np.int32), "others": others}


SEGMENT = "mini long, key long, doc_id long, tag long, start int, n int, others binary"


def tag(text: Column) -> Column:
    """A number of 60 bits that tells the texts of one id apart, in the order of their MD5 digests."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _segments(docs: DataFrame, window: int) -> DataFrame:
    def make(batch: pa.RecordBatch):
        doc, own = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        order, texts, got = np.lexsort((own, doc)), raw_texts(batch.column("text")), []
        texts = [texts[i] or b"" for i in order.tolist()]
        for a, b in chunks(texts):
            run, mini, key, lo, n = segments(*text_hashes(texts[a:b]), window, run_lengths(window)[0])
            rows = order[a:b][run]
            got.append((mini, key, doc[rows], own[rows], lo, n))
        got = [np.concatenate(x) for x in zip(*got)]
        return _folded(*got) if len(got[0]) else None

    return per_batch(docs, make, SEGMENT)


MARK = "doc_id long, tag long, start int, n int, mini long, whole boolean"


def _linked(found: DataFrame) -> DataFrame:
    """Segments of shards with more than one occurrence: ``whole`` ones start earlier altogether,
    the others are first occurrences next to different segments.  Streams over sorted partitions."""
    sorted_rows = found.repartition("mini").sortWithinPartitions("mini", "key", "doc_id", "tag", "start")

    def run(batches):
        carry = None  # of the last minimizer: itself, its last key, that run's first place, and its first row if it is the only one so far
        for batch in batches:
            if not batch.num_rows:
                continue
            mini, key, doc, own, start, n = (batch.column(c).to_numpy() for c in ("mini", "key", "doc_id", "tag", "start", "n"))
            place = np.stack([doc, own, start.astype(np.int64)], axis=1)
            new_mini = np.append(True, mini[1:] != mini[:-1])
            new_run = np.append(True, (mini[1:] != mini[:-1]) | (key[1:] != key[:-1]))
            goes_on = carry is not None and carry[0] == mini[0]
            if goes_on:
                new_mini[0], new_run[0] = False, carry[1] != key[0]
            # Each row beside the first of its run, which may stand in an earlier batch.
            runs = np.flatnonzero(new_run)
            at = np.cumsum(new_run) - 1
            firsts = np.concatenate([place[runs], [carry[2] if goes_on else place[0]]])[at]  # -1 is the run that goes on
            later = ~new_run & (firsts != place).any(axis=1)  # the same place: a row that is repeated as it is
            out = [(place[later], n[later], mini[later], np.ones(int(later.sum()), bool))]
            # First occurrences next to different segments.
            group = np.cumsum(new_mini) - (0 if goes_on else 1)
            keys = np.bincount(group[runs], minlength=int(group[-1]) + 1) if len(runs) else np.zeros(int(group[-1]) + 1, np.int64)
            if goes_on:
                keys[0] += 1 if carry[3] is not None else 2  # 2: others are told already
            told = runs[keys[group[runs]] > 1]
            out.append((place[told], n[told], mini[told], np.zeros(len(told), bool)))
            alone = carry[3] if goes_on else None
            if alone is not None and keys[0] > 1:
                out.append((alone[0][None], alone[1][None], mini[:1], np.zeros(1, bool)))
                alone = None
            others = batch.column("others")
            for i in np.flatnonzero(others.is_valid().to_numpy(zero_copy_only=False)).tolist():
                more = np.frombuffer(others[i].as_py(), np.int64).reshape(-1, 3)
                more = more[(more != firsts[i]).any(axis=1)]
                out.append((more, np.full(len(more), n[i], np.int32), np.full(len(more), mini[i], np.int64), np.ones(len(more), bool)))
            last = int(group[-1])
            if keys[last] > 1:
                alone = None
            elif last or not goes_on:
                alone = (place[runs[-1]], n[runs[-1]])
            carry = (mini[-1], key[-1], firsts[-1] if not new_run[-1] else place[-1], alone)
            found, count, minis, whole = (np.concatenate(c) for c in zip(*out))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(minis), pa.array(whole)], ["doc_id", "tag", "start", "n", "mini", "whole"])

    return map_batches(sorted_rows, run, MARK)


WORDS = "mini long, doc_id long, tag long, start int, n int, words binary"
NAMES = ("mini", "doc_id", "tag", "start", "n", "words")


def _cut(h: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of h[lo:lo + size] for many ranges."""
    ends = np.append(0, np.cumsum(size))
    words = h[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(8 * ends), pa.py_buffer(words)])


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, tag, packed: each text compressed by itself, for shuffles of whole texts."""

    def make(batch: pa.RecordBatch):
        squeeze = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "packed": [squeeze.compress(t) for t in raw_texts(batch.column("text"))]}

    return per_batch(docs, make, "doc_id long, tag long, packed binary")


def _with_words(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """The word hashes of first occurrences."""
    lists = marks.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("mini", "start", "n")).alias("marks"))

    def make(batch: pa.RecordBatch):
        doc, own, found = (batch.column(c) for c in ("doc_id", "tag", "marks"))
        doc, own = doc.to_numpy(), own.to_numpy()
        mark, ends = found.flatten(), np.append(0, np.cumsum(found.value_lengths().to_numpy()))
        mini, start, n = (mark.field(c).to_numpy().astype(np.int64) for c in ("mini", "start", "n"))
        texts = list(unpacked(batch.column("packed")))
        for a, b in chunks(texts):
            h, begins = text_hashes(texts[a:b])
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            at = slice(ends[a], ends[b])
            lo, size = begins[row] + start[at], n[at] + window - 1
            there = np.flatnonzero(lo + size <= begins[row + 1])
            row = row[there] + a
            yield dict(zip(NAMES, (mini[at][there], doc[row], own[row], start[at][there].astype(np.int32), n[at][there].astype(np.int32), _cut(h, lo[there], size[there]))))

    return per_batch(_packed(docs).join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "packed", "marks"), make, WORDS)


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "tag", "start", "n"])


def _matched(shards: DataFrame, window: int) -> DataFrame:
    """Windows of first occurrences that start earlier, by each shard's automaton."""
    rows = shards.repartition("mini").sortWithinPartitions("mini", "doc_id", "tag", "start")

    def run(batches):
        automaton, current, last, held, out = SuffixAutomaton(), None, None, None, []

        def stream(doc, own, start, words, more):
            # No window is twice in one segment, so the last one of a shard is only matched, not added.
            values = np.frombuffer(words, np.uint64).tolist()
            sizes = automaton.feed(values) if more else automaton.matches(values)
            if max(sizes) < window:
                return
            begin = None
            for i, size in enumerate([*sizes, 0], start - window + 1):
                if size >= window:
                    begin = i if begin is None else begin
                elif begin is not None:
                    out.append((doc, own, begin, i - begin))
                    begin = None

        for batch in batches:
            for mini, doc, own, start, _, words in zip(*(batch.column(c).to_pylist() for c in NAMES)):
                if mini == current and last == (doc, own, start):
                    continue  # of a row that is repeated as it is
                if held:
                    stream(*held, mini == current)
                if mini != current:
                    automaton, current = SuffixAutomaton(), mini
                last, held = (doc, own, start), (doc, own, start, words)
            if out:
                yield _windows(out)
                out.clear()
        if held:
            stream(*held, False)
        if out:
            yield _windows(out)

    return map_batches(rows, run, "doc_id long, tag long, start int, n int")


def _split(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Pieces of shards that are too large, cut again by the minimizers of runs of ``gram`` words."""

    def make(batch: pa.RecordBatch):
        mini, doc, own, start = (batch.column(c).to_numpy() for c in NAMES[:4])
        data = batch.column("words").to_pylist()
        h, begins = np.frombuffer(b"".join(data), np.uint64), np.cumsum([0] + [len(d) // 8 for d in data])
        row, fine, _, lo, n = segments(h, begins, window, gram)
        fine = signed(mixed(fine + mini[row].view(np.uint64)))
        return dict(zip(NAMES, (fine, doc[row], own[row], (start[row] + lo).astype(np.int32), n.astype(np.int32), _cut(h, begins[row] + lo, n + window - 1))))

    return per_batch(pieces, make, WORDS)


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, start, n): windows start .. start + n - 1 of the document start earlier in the corpus.  docs: doc_id, tag, text."""
    docs = docs.where("doc_id is not null")
    marks = stored(_linked(_segments(docs, window)), "marks")
    pieces = _with_words(docs, marks.where("not whole").select("mini", "doc_id", "tag", "start", "n"), window)
    found = marks.where("whole").select("doc_id", "tag", "start", "n")
    counts = marks.where("not whole")
    for gram in run_lengths(window)[1:]:
        large = counts.groupBy("mini").count().where(F.col("count") > SHARD).select("mini", F.lit(True).alias("large"))
        placed = stored(pieces.join(large, "mini", "left"), "shards")
        found = found.union(_matched(placed.where("large is null").drop("large"), window))
        pieces = counts = stored(_split(placed.where("large").drop("large"), window, gram), "split")
    # Here a shard's windows are all equal, or there was one level only.
    return found.union(_matched(pieces, window))


def kept(words: list[bytes], starts: np.ndarray, counts: np.ndarray, window: int) -> list[bytes]:
    """The words that no marked window covers."""
    order, out, at = np.argsort(starts, kind="stable"), [], 0
    for start, n in zip(starts[order].tolist(), counts[order].tolist()):
        out += words[at:start]
        at = max(at, start + n + window - 1)
    return out + words[at:]


def _left(texts, marks: pa.Array, window: int) -> Iterator[tuple[bytes, list[bytes], list[bytes]]]:
    """Each text, its words and those of them that are left."""
    mark, ends = marks.flatten(), np.append(0, np.cumsum(marks.value_lengths().fill_null(0).to_numpy())).tolist()
    start, n = mark.field("start").to_numpy(), mark.field("n").to_numpy()
    for i, text in enumerate(texts):
        words, at = (text or b"").split(), slice(ends[i], ends[i + 1])
        yield text, words, kept(words, start[at], n[at], window) if at.stop > at.start else words


def _tagged(df: DataFrame) -> DataFrame:
    return id_text(df).withColumn("tag", tag(F.col("text")))


def _lists(docs: DataFrame, window: int) -> DataFrame:
    return repeated_windows(docs, window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def _texts_and_marks(df: DataFrame, window: int) -> DataFrame:
    docs = _tagged(df)
    return _packed(docs).join(_lists(docs, window), ["doc_id", "tag"], "left").select("doc_id", "packed", "marks")


def without_repeats(df: DataFrame, window: int) -> DataFrame:
    """``df`` with its repeated passages removed from ``text`` (the words left joined by a space where
    anything went) and ``n_chars``, if there, counted anew.  All rows and columns stay."""
    names = {c: fresh(df, f"marked_{c}") for c in ("doc_id", "tag", "marks")}
    lists = _lists(_tagged(df), window).select(*[F.col(c).alias(n) for c, n in names.items()])
    own = tag(F.coalesce(df["text"].cast("string"), F.lit("")))
    joined = df.join(lists, (df["doc_id"].cast("long") == F.col(names["doc_id"])) & (own == F.col(names["tag"])), "left").drop(names["doc_id"], names["tag"])
    text_at = df.columns.index("text")
    chars_at = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(batches):
        for batch in batches:
            texts, counts = [], batch.column(chars_at).to_pylist() if chars_at is not None else None
            marks = batch.column(batch.num_columns - 1)
            for i, ((text, words, left), marked) in enumerate(zip(_left(raw_texts(batch.column(text_at)), marks, window), marks.is_valid().to_pylist())):
                if marked:
                    text = b" ".join(left)
                    if counts is not None:
                        counts[i] = len(text.decode("utf-8"))
                texts.append(text)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, pa.binary()).cast(batch.schema.field(text_at).type)
            if counts is not None:
                columns[chars_at] = pa.array(counts, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return map_batches(joined, run, df.schema)


def repeat_digests(df: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def make(batch: pa.RecordBatch):
        rows = [(len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()) for _, words, left in _left(unpacked(batch.column("packed")), batch.column("marks"), window)]
        return {"doc_id": batch.column("doc_id")} | dict(zip(("n_words", "n_removed", "kept_sha256"), zip(*rows)))

    return per_batch(_texts_and_marks(df, window), make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), window=20)
