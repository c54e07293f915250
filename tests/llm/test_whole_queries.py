"""Every query, and the pipeline, on empty and odd tables; the pipeline against plain versions of its stages."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkfall.llm import mixing, packing, toxicity
from inkfall.llm.common import id_text
from inkfall.llm.queries import queries

from .conftest import SMALL
from .test_corpus_operators import brute_components, brute_repeats

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn int, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
#: Columns of names that operators use inside.
CLASHES = ", mini string, marks string, row string, n string, component string, mark string, size string, packed string, key string, verdict string"


def write(spark, folder, rows, more=""):
    for name, schema in TABLES.items():
        extra = tuple("x" for _ in more.split(",") if _.strip())
        spark.createDataFrame([(*r, *extra) for r in rows.get(name, [])], schema + more).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    long = "word " * 3000 + "x" * 20000
    docs = [(None, None, None, None, None), (1, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d", "en", None, 7), (3, "a b c d", "en", None, 7)]
    docs += [(3, "e f g h", "en", "s", 7), (4, long, "en", "s", len(long)), (5, long, "en", "t", len(long)), (None, "a b c d", "en", "t", 7), (-1, "ü ß ﬁ", "de", "t", 5)]
    docs += [(10 + i, f"some words number {i % 4} and more of them", "en", f"s{i % 2}", 30) for i in range(30)]
    chats = [(None, 0, "user", "n"), (1, None, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, 0, "assistant", long)] + [(3, i, "user", str(i)) for i in range(500)]
    pages = [(i, u, None) for i, u in enumerate([None, "", "http://a.net/es/x", "http://a.org/y", "http://a.org/y"])] + [(3, "http://b.com/", "h"), (None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 0, 1)]
    vectors = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (5, [0.9, 0.1], 1), (None, [0.8, 0.0], 1), (6, None, 1), (7, [1.0, 1.0], None), (8, [float("nan"), 0.0], 1), (9, [None, 1.0], 0), (11, [], 2), (100, [0.5, 0.5, 0.1], 3), (12, [1.0], 2)]
    return write(spark, tmp_path_factory.mktemp("odd"), {"documents": docs, "labels": labels, "pages": pages, "conversations": chats, "embeddings": vectors}, CLASHES)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_of_nothing(spark, nothing, name):
    assert queries()[name](spark, nothing).count() == (name == "op4_chat_format")


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_of_odd_rows(spark, odd, name):
    rows = queries()[name](spark, odd).collect()
    if name == "op3_url_filter":
        assert len(rows) == 7 and all(r["verdict"] in ("allow", "block") for r in rows)
    elif name == "op11_hard_negatives":  # both rows of id 0 have label 1, and [256, 0] as anchors; 0.95 of 65536 is 62259
        both = [(0, 0, 1, 100, 65536, 32768), (0, 5, 1, 100, 58880, 32768), (0, None, 1, 100, 52224, 32768)]
        assert sorted(map(str, (tuple(r) for r in rows if r["anchor_id"] == 0))) == sorted(map(str, both + both))
    elif name == "op4_chat_format":
        assert {r["conv_id"]: r["n_turns"] for r in rows} == {None: 1, 1: 3, 2: 1, 3: 500, -1: 2}
    else:
        ids = [r["doc_id"] for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
        found = {(r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows} if name == "op7_packing" else rows
        assert len(found) == len(rows)
        got = Counter(r["doc_id"] for r in rows if name != "op7_packing" or r["start"] == 0)
        assert got == Counter(ids)


def test_pipeline_of_odd_rows(spark, odd):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, odd)
        assert at.columns == docs.columns
    last = P.run(spark, odd)
    assert {r["doc_id"] for r in last.collect()} <= {r["doc_id"] for r in docs.collect()}


def test_pipeline_keeps_unlike_rows_of_one_id(spark, tmp_path):
    """Rows that share an id and nothing else lose nothing to the stages that compare texts."""
    import corpus_pipeline as P

    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("p", "q", "r")]
    rows = [(1, texts[0]), (5, "x " * 10 + texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[2] + " end"), (5, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r["text"] for r in P.substrings(spark, docs, SMALL).collect())
    assert got == Counter([texts[0], "x " * 9 + "x", texts[1], texts[1], texts[2], texts[2] + " end"])
    near = Counter(r["text"] for r in P.near_duplicates(spark, docs, SMALL).collect())
    assert {texts[0], texts[1]} <= set(near)


def test_pipeline_by_plain_versions(spark):
    """What is left of each document, how often, and its pieces."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    at, w, bias = toxicity.fit(id_text(docs), toxicity.training_labels(spark.read.parquet(f"{SMALL}/labels.parquet")))
    weight = dict(zip(at.tolist(), w.tolist()))

    def score(text):
        return 1 / (1 + math.exp(-max(-35, min(35, bias + sum(weight.get(p, 0.0) for p in toxicity.features(text.encode()).tolist())))))

    left = [(r["doc_id"], r["text"] or "") for r in docs.collect() if score(r["text"] or "") < toxicity.THRESHOLD]
    classes = brute_components(left, 5, 80)
    left = [(i, t) for i, t in left if classes[i][1] == i]
    gone = brute_repeats(left, 50)
    texts, first = {}, set()
    for i, text in sorted(left):
        words = text.encode().split()
        drop = [False] * len(words)
        for s in range(len(words) - 49):
            key = tuple(words[s : s + 50])
            if key in first:
                drop[s : s + 50] = [True] * 50
            first.add(key)
        assert sum(drop) == gone[i][1]
        texts[i] = b" ".join(x for x, d in zip(words, drop) if not d).decode() if any(drop) else text
    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces, places = defaultdict(Counter), defaultdict(list)
    for r in P.run(spark, SMALL).collect():
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    taken, sizes = Counter(), Counter()
    for i, text in texts.items():
        size = len(text.encode().split())
        sizes[source[i]] += size
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        want = {(s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)}
        times = set(pieces[i].values()) or {0}
        assert set(pieces[i]) == (want if times != {0} else set()) and len(times) == 1 and times <= {0, 1, 2}
        taken[source[i]] += size * times.pop()
    assert {i for i in pieces if pieces[i]} <= set(texts)
    target = mixing.targets(dict(sizes))
    large = {s: max(len(t.encode().split()) for i, t in texts.items() if source[i] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], large[s] / 2) for s in sizes)
    for parts in places.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
