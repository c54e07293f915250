"""One document of all rows, in parts of bounded size.

Rows are dealt by ranges of their order, and each task counts the bytes before each of its rows.  The tasks' sums, a row for each
task, give where each task's text begins, so every row knows its place in the document.  A part is the texts that begin
within ``size`` bytes; parts are the same however the rows were dealt.  A row longer than that makes a part larger, but no row is cut."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import shared_dir

PARTS = "part long, start long, bytes long, text string"


def _counted(batches):
    done, task = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("bytes").to_numpy()
        ends = done + np.cumsum(sizes)
        task = batch.column("task")
        yield pa.RecordBatch.from_arrays([task, pa.array(ends - sizes), pa.array(sizes), batch.column("text")], names=["task", "before", "bytes", "text"])
        done = int(ends[-1])


def parts(rows: DataFrame, order: list[str], text: str, separator: str, size: int) -> DataFrame:
    """``rows`` has the columns ``order`` and ``text``; rows that are alike in order follow by text."""
    spark = rows.sparkSession
    # The number tells rows apart that are alike in all, so that many of them are spread.
    lined = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.concat(F.lit(separator), F.col(text)).alias("text"))
    lined = lined.where(F.col("text").isNotNull()).withColumn("nth", F.monotonically_increasing_id())
    keys = [*[f"k{i}" for i in range(len(order))], "text", "nth"]
    dealt = lined.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    sized = dealt.select(F.spark_partition_id().alias("task"), F.octet_length("text").cast("long").alias("bytes"), "text")
    path = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    sized.mapInArrow(_counted, "task int, before long, bytes long, text string").write.parquet(path)
    placed = spark.read.schema("task int, before long, bytes long, text string").parquet(path)
    # A row for each task: small at any size of the document.
    sums = placed.groupBy("task").agg(F.sum("bytes").alias("all"))
    begin = sums.select("task", F.coalesce(F.sum("all").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    lead = len(separator.encode("utf-8"))
    # The first row has no separator before it.
    at = F.col("begin") + F.col("before")
    start = F.greatest(at - lead, F.lit(0).cast("long"))
    own = F.when(at == 0, F.substr("text", F.lit(len(separator) + 1))).otherwise(F.col("text"))
    known = placed.join(F.broadcast(begin), "task").select(start.alias("start"), (F.col("bytes") - F.when(at == 0, lead).otherwise(0)).alias("bytes"), own.alias("text"))
    part = F.floor(F.col("start") / size).alias("part")
    grouped = known.groupBy(part).agg(F.min("start").alias("start"), F.sum("bytes").alias("bytes"), F.expr("listagg(text, '') WITHIN GROUP (ORDER BY start, bytes)").alias("text"))
    return grouped.select("part", "start", "bytes", "text")
