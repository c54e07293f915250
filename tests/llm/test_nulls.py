"""Rows with nulls in every column, in every operator on documents."""

import ctypes
import hashlib

import numpy as np
import pytest
import xxhash

from inkfall.llm import fingerprint, jaccard, media, mixing, packing, substring, tokencount, toxicity

ROWS = [(None, None, None), (None, "a b c", "s"), (1, None, None), (1, None, None), (2, "a b c", None), (2, "a b c d", "s"), (3, "", "s")]
MODEL = (np.array([1, 2]), np.array([0.5, -0.5]), 0.1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.mark.parametrize("name,make", {
    "media": media.media_digests,
    "media columns": media.media_columns,
    "toxicity": lambda d: toxicity.scored(d, MODEL),
    "fingerprints": fingerprint.fingerprints,
    "tokens": lambda d: tokencount.token_counts(d, tokencount.default_vocabulary()),
    "packing": lambda d: packing.pack(packing.token_pieces(d, packing.default_tokenizer())),
    "mixing": mixing.mixed_copies,
    "components": lambda d: jaccard.near_components(d, 3, 90),
    "repeats": lambda d: substring.repeat_digests(d, 2),
    "cutting": lambda d: substring.without_repeats(d, 2),
    "filter": lambda d: toxicity.not_toxic(d, MODEL, threshold=1.1),
}.items())
def test_every_row_comes_back(docs, name, make):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in make(docs).collect())
    assert got == sorted((i is None, i or 0) for i, _, _ in ROWS)


@pytest.mark.parametrize("copies", [1, 40])
def test_neighbours_of_rows_without_id(spark, copies):
    """Rows without an id come last in descending order, by a hash of their text; each row's next one is the row before in the other order."""
    rows = [(i, t) for i, t in [(None, "b b b b"), (None, "c é c"), (None, ""), (2, "xyz xyz"), (2, "other"), (-1, "minus one"), (7, None)] for _ in range(copies)]
    hashed = lambda t: ctypes.c_int64(xxhash.xxh64_intdigest(t.encode(), 42)).value
    order = sorted((i is not None, i or 0, hashed(t or ""), t or "") for i, t in rows)
    want = []
    for at, (known, i, _, text) in enumerate(order):
        cut, after = len(text) // 3, order[at - 1][3]
        want.append((i if known else None, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    got = fingerprint.edited_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_labels_with_nulls(spark, docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (5, 1)], "doc_id long, toxic int")
    assert {r["doc_id"] for r in toxicity.training_labels(labels).collect()} <= {2, 5}
    toxicity.fit(docs.select("doc_id", "text").na.fill({"text": ""}), toxicity.training_labels(labels))


def test_mixed_repeats_rows(docs):
    assert mixing.mixed(docs).columns == docs.columns
