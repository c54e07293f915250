"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkfall.llm.merkle import FIELDS, folded, manifest, proof_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, idx int, grp string, n int, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(shown(row[f]) for f in FIELDS))


def climbed(nodes):
    """The end of a list of nodes, and for each the siblings (before, after) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, own = [], {}
    for s in names:
        rs = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)), i) for i, r in enumerate(groups[s]))
        top, paths = climbed([k[2] for k, _ in rs])
        subs.append(top)
        own[s] = [(k[1] if k[0] else None, k[2], p) for (k, _), p in zip(rs, paths)]
    root, above = climbed(subs)
    return [(i, s, leaf, sub, root, p + q) for s, sub, q in zip(names, subs, above) for i, leaf, p in own[s]]


def made(spark, rows):
    full = [tuple(r[f] for f in ("doc_id", "text", "lang", "source", "n_chars")) + ("x", 1, "y", 2, "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def some_rows(seed, sizes):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            i = rng.choice([None, rng.randrange(50), *[rng.randrange(10**6)] * 8])
            text = rng.choice([None, "", "É ß x", "word " * rng.randrange(1, 9)])
            rows.append({"doc_id": i, "text": text, "lang": rng.choice([None, "en"]), "source": source, "n_chars": rng.choice([None, 3])})
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 2}, {"a": 16, "b": 17, None: 3, "": 2}, {"hot": 300, "z": 1, "é": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_by_hand(spark, sizes):
    rows = some_rows(len(sizes), sizes)
    got = manifest(made(spark, rows)).select("doc_id", "source", "leaf", "subroot", "root", "path", proof_digest(F.col("path")).alias("proof"), folded(F.col("leaf"), F.col("path")).alias("back")).collect()
    key = lambda r: tuple(map(str, r))
    # Copies share their places, in any order.
    assert sorted(key((r[0], r[1], r[2], r[3], r[4], [tuple(s) for s in r[5]])) for r in got) == sorted(map(key, by_hand(rows)))
    assert all(r["back"] == r["root"] and r["proof"] == H(*(x for s in r["path"] for x in s)) for r in got)


def test_copies_of_one_row(spark):
    rows = [{"doc_id": 5, "text": "t", "lang": "en", "source": "a", "n_chars": 1}] * 300 + some_rows(3, {"b": 20})
    got = manifest(made(spark, rows)).collect()
    assert len(got) == 320 and {r["root"] for r in got} == {by_hand(rows)[0][4]}


def test_changed_text_is_found(spark):
    rows = some_rows(9, {"a": 40, "b": 5})
    docs = made(spark, rows)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = manifest(docs, more={"other": F.when(hit, F.sha2(F.lit("x").cast("binary"), 256))}).withColumn("back", folded(F.coalesce("other", "leaf"), F.col("path"))).collect()
    for r in got:
        expected = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert (r["back"] != r["root"]) == expected


def test_no_rows(spark, no_docs):
    assert manifest(no_docs).collect() == []
