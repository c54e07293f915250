"""Shared pieces: reading tables, shared-folder tables, word hashing, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_dir

#: Entries after which a worker's word cache starts anew; bounds its memory.
WORD_CACHE = 100_000


#: Rows of an Arrow batch; whole texts make batches of Spark's default size too large for two tasks' memory.
BATCH_ROWS = 2000


def tuned(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: list[str] = []


def stored_so_far() -> int:
    """How many tables ``stored`` has written in this process and that are still there."""
    return len(_STORED)


def drop_stored(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Delete the tables that ``stored`` has written in this process, or those of them after the first ``since`` and before
    the last ``but_last``; frames made of them end with it."""
    gone = _STORED[since : len(_STORED) - but_last]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.remove(name)
    return len(gone)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: lineage ends there,
    and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Words(dict):
    """Bytes of a word to a value made once; emptied when it has grown to ``limit`` entries."""

    def __init__(self, make: Callable, limit: int = WORD_CACHE):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = self.make(word)
        return got


_HASHES = Words(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) + h[i : i + n] * _ODD[i % 8] * np.uint64(2 * (i // 8) + 1)
        if i + 1 < k:
            out = out * np.uint64(0x9FB21C651E98DF25)
    return mixed(out)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow``; a task's freed memory goes back to the system, as workers stay for later tasks."""
    tuned(df.sparkSession)

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(wrapped, schema)


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` by a function from a batch to columns, or to several sets of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            got = make(batch)
            for columns in [got] if isinstance(got, dict) else got or ():
                arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for f in arrow for c in [columns[f.name]]]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_batches(df, run, kind)


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, packed: each text compressed by itself, for shuffles of whole texts."""

    def make(batch: pa.RecordBatch):
        squeeze = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column("doc_id"), "packed": [squeeze.compress(t or b"") for t in raw_texts(batch.column("text"))]}

    return per_batch(docs, make, "doc_id long, packed binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return (unpack.decompress(z) for z in column.to_pylist())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
