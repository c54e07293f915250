"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfall.llm.common import drop_stored, id_text, stored, stored_so_far, table
from inkfall.llm.jaccard import one_of_each
from inkfall.llm.mixing import mixed
from inkfall.llm.packing import default_tokenizer, pack, token_pieces
from inkfall.llm.substring import without_repeats
from inkfall.llm.toxicity import fit, not_toxic, training_labels

#: Words of the passages that are removed where they repeat.
PASSAGE = 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    return not_toxic(docs, fit(id_text(docs), training_labels(table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words or more stay only where they come first."""
    return without_repeats(docs, PASSAGE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(token_pieces(docs, default_tokenizer()))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: A trained classifier and pseudo-random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other.  Once a stage's rows are written, its own tables and its predecessor's rows go."""
    docs, before = table(spark, sf_dir, "documents"), stored_so_far()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_stored(spark, before, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
