"""Packing, mixing, similarity join, substring removal: against brute force, with odd rows."""

import ast
import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkfall.llm import jaccard, mixing, packing, substring
from inkfall.llm.automaton import SuffixAutomaton

from .conftest import words

# --- packing ----------------------------------------------------------------


def test_pieces_are_the_tokenizers(odd_docs, odd_texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    got = {}
    for r in packing.token_pieces(odd_docs, path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in odd_texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_tokens_of_strange_characters():
    tok = packing.tokens(packing.default_tokenizer())
    rng = random.Random(3)
    alphabet = "aBc .,'|<>-_9\n\téÉİß\u0301ΣŉǰĲ×ª\xa0\x1c$%日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["<|endoftext|>. A<|ENDOFTEXT|>!", "don't IT'S x''s", "\u212a K"]
    for text, ids in zip(texts, tok.ids([t.encode() for t in texts])):
        assert ids == np.array(tok.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_other_files(file):
    """A file that prepares texts in another way goes its own way."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    exact = Tokenizer.from_file(path)
    texts = ["Hello World, this is 2024 text.", "", " two  spaces\n", "don't", "ÄÖ 12a"]
    got = list(packing.tokens(path).ids([t.encode() for t in texts]))
    assert got == [np.array(exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += 0 if at & (at - 1) == 0 else capacity - at
    return total


def test_packing(odd_docs, odd_texts, no_docs):
    path = packing.default_tokenizer()
    pieces = packing.token_pieces(odd_docs, path, capacity=256)
    rows = packing.pack(pieces, capacity=256).collect()
    assert len(rows) == pieces.count() and check_packing(rows, 256) < 0.01 * sum(r["length"] for r in rows)
    assert packing.pack(packing.token_pieces(no_docs, path)).count() == 0


def test_plan_fills_windows(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(20):
        cap = 64
        counts = np.zeros(cap + 1, np.int64)
        for n in rng.integers(1, cap + 1, 300):
            counts[n] += 1
        patterns = packing.plan(counts, cap)
        used = np.zeros_like(counts)
        for got, times in patterns:
            assert sum(n * k for n, k in got.items()) <= cap
            for n, k in got.items():
                used[n] += k * times
        assert (used == counts).all()
        fills = [(sum(n * k for n, k in got.items()), times) for got, times in patterns]
        assert sum(0 if f & (f - 1) == 0 else t * (cap - f) for f, t in fills) <= 0.08 * int((counts * np.arange(cap + 1)).sum())


def test_best_pattern_is_exact():
    """Against all multisets."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        cap = 20
        counts = np.zeros(cap + 1, np.int64)
        for n in rng.integers(3, cap, 6):
            counts[n] += 1
        first = int(np.flatnonzero(counts)[-1])
        counts[first] -= 1
        sums = {0}
        for n in np.flatnonzero(counts):
            for _ in range(counts[n]):
                sums |= {s + n for s in sums}
        best = max(s for s in sums if s <= cap - first) + first
        got = packing._pattern(counts, first, cap)
        fill = sum(n * k for n, k in got.items())
        assert fill == best or (best < cap and fill & (fill - 1) == 0)
        counts[first] += 1
        assert all(counts[n] >= k for n, k in got.items())


def test_one_length_ranked_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    pieces = spark.range(1000).selectExpr("id doc_id", "0L start", "cast(if(id % 3 = 0, id % 7 + 1, 5) as int) length", "id ids_crc32", "5L doc_tokens")
    rows = packing.pack(pieces, capacity=32).collect()
    assert len(rows) == 1000 and check_packing(rows, 32) <= 64


# --- mixing -----------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 100, "c": 100, None: 100})
    # a 5, b 2, c 1, null 5 of 600 words: a and null stop at 200, b and c share the rest
    assert got["a"] == got[None] == 200 and got["b"] == pytest.approx(400 / 3) and got["c"] == pytest.approx(200 / 3)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_pivotal_keeps_words():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 500, 400), rng.random(400)
    got = mixing.pivotal(np.arange(400), size, p, 0, 1)
    assert (size * got).sum() == pytest.approx((size * p).sum())
    assert ((got > 0) & (got < 1)).sum() <= 1
    mean = np.mean([mixing.pivotal(np.arange(40), size[:40], p[:40], 0, s) for s in range(600)], axis=0)
    assert np.abs(mean - p[:40]).max() < 0.1


def test_mixing(odd_docs, odd_texts, no_docs, monkeypatch):
    rows = {(r["doc_id"]): r for r in mixing.mixed_copies(odd_docs).collect()}
    assert len(rows) == len(odd_texts)
    total, sizes = {}, {}
    for i, text in odd_texts:
        r, s = rows[i], None if i % 5 == 0 else f"s{i % 3}"
        assert r["size"] == len((text or "").encode().split()) and r["copies"] in (0, 1, 2)
        total[s] = total.get(s, 0) + r["copies"] * r["size"]
        sizes.setdefault(s, []).append(r["size"])
    want = mixing.targets({s: sum(v) for s, v in sizes.items()})
    for i, _ in odd_texts:
        s = None if i % 5 == 0 else f"s{i % 3}"
        assert rows[i]["target"] == pytest.approx(want[s]) and abs(total[s] - want[s]) <= max(sizes[s])
    again = {r["doc_id"]: r["copies"] for r in mixing.mixed_copies(odd_docs.repartition(7)).collect()}
    assert again == {i: r["copies"] for i, r in rows.items()}
    assert mixing.mixed_copies(no_docs).count() == 0
    kept = mixing.mixed(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["copies"] for r in rows.values())


def test_one_large_document_is_no_obstacle(spark):
    """A fifth of a source in one document, the rest small: the source still meets its target."""
    rows = [(i, "w " * (900 if i % 60 == 0 else 20 + i % 90), f"s{i // 60}") for i in range(480)]
    got = mixing.mixed_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, want = {}, {}
    for r in got:
        s = r["doc_id"] // 60
        taken[s], want[s] = taken.get(s, 0) + r["copies"] * r["size"], r["target"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)


def test_repeated_rows_are_dealt_evenly(spark):
    rows = [(None, "a b c", "s")] * 40 + [(-1, "a b c", "s")] * 3 + [(7, "a b c", "s"), (7, "d e", "s"), (7, "d e", "t"), (None, "x " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mixed_copies(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["size"]) for r in got))) == sorted(map(str, ((i, len(t.split())) for i, t, _ in rows)))
    ones = [r["copies"] for r in got if r["doc_id"] is None and r["size"] == 3]
    assert max(ones) - min(ones) <= 1
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)


def test_mixing_tree_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = spark.range(1500).selectExpr("if(id % 50 = 0, null, id) doc_id", "repeat('w ', cast(1 + id % 17 as int)) text", "if(id % 3 = 0, 'hot', cast(id % 4 as string)) source")
    rows = mixing.mixed_copies(docs).collect()
    assert len(rows) == 1500
    found = {}
    for r in rows:
        key = (r["source_size"], r["target"])
        found[key] = found.get(key, 0) + r["copies"] * r["size"]
    assert all(abs(n - target) <= 1 for (_, target), n in found.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    """Within 2 %, or nearer than any one of the source's documents could bring it."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = {}
    for r in mixing.mixed_copies(docs).collect():
        found.setdefault((r["source_size"], r["target"]), []).append((r["size"], r["copies"]))
    for (size, target), rows in found.items():
        rate, miss = target / size, target - sum(n * c for n, c in rows)
        assert all(c in (int(rate), int(rate) + (rate % 1 > 0)) for n, c in rows if n)
        turns = [n if c == int(rate) else -n for n, c in rows if n] if rate % 1 > 0 else []
        assert abs(miss) <= 0.02 * target or all(abs(miss - t) >= abs(miss) for t in turns), (target, miss, sorted(turns))


def test_last_choice():
    rng = np.random.default_rng(8)
    for n in [1, 2, 5, 10, 14, 15, 60, 400]:
        mass = rng.integers(1, 500, n).astype(np.int64)
        p = rng.integers(0, 2, n).astype(float)
        free = rng.random(n) < 0.9
        want = float(mass.sum() * 0.4)
        got = mixing.nearest(mass, p, free, want)
        assert set(np.unique(got)) <= {0.0, 1.0} and (got[~free] == p[~free]).all()
        off = abs((mass * got).sum() - want)
        assert off <= abs((mass * p).sum() - want) + 1e-6
        if free.sum() <= mixing.FEW:
            at = np.flatnonzero(free)
            assert off == pytest.approx(min(abs(sum(mass[a] for a, c in zip(at, picks) if c) + (mass * p)[~free].sum() - want) for picks in itertools.product((0, 1), repeat=len(at))))
        elif n >= 60:
            assert off <= 1


# --- similarity join --------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 60), (3, 100)])
def test_near_components(odd_docs, odd_texts, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(odd_docs, k, percent).collect()}
    assert got == brute_components(odd_texts, k, percent)


def test_near_components_in_small_blocks(odd_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(odd_docs, 3, 80).collect()}
    assert got == brute_components(odd_texts, 3, 80)


@pytest.mark.parametrize("rows", [3, 20])
def test_large_communities(spark, monkeypatch, rows):
    """Near copies of a few texts that share a passage, as one community dealt in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows)
    rng = random.Random(rows)
    passage, bases = words(rng, 60), [words(rng, 60) for _ in range(4)]
    texts = []
    for i in range(150):
        w = (passage + " " + bases[i % 4 if i % 7 else 0]).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 12])):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append((i, " ".join(w)))
    members = spark.createDataFrame([(i, len(jaccard.shingle_set(t.encode(), 3)), 0) for i, t in texts], "doc_id long, n long, component long")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    levels = np.zeros(1 << jaccard.SLOT_BITS[0], np.uint8)
    for percent in (60, 85):
        forest = jaccard.Forest(150)
        for r in jaccard._community_links(docs, members, 3, percent, levels).collect():
            forest.join(r["a"], r["b"])
        assert {i: forest.find(i) for i, _ in texts} == {i: c for i, (_, c) in brute_components(texts, 3, percent).items()}


def test_repeated_ids_are_rows_of_their_own(spark):
    a, b = "one two three four five six seven eight", "red green blue black white brown pink grey"
    rows = [(5, a), (5, b), (3, b + " x"), (None, a), (None, "q r s t u v"), (9, a), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_components(docs, 3, 80).collect())
    assert got == sorted([("5", 6, "5"), ("5", 6, "3"), ("3", 7, "3"), ("None", 6, "5"), ("None", 4, "None"), ("9", 6, "5"), ("7", 0, "7"), ("7", 0, "7")])
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard.one_of_each(docs, 3, 80).collect())
    assert kept == sorted([("5", a), ("3", b + " x"), ("None", "q r s t u v"), ("7", "None")])


def test_one_of_each(odd_docs, odd_texts, no_docs, spark):
    want = {i for i, (_, c) in brute_components(odd_texts, 5, 80).items() if c == i}
    kept = jaccard.one_of_each(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    twice = odd_docs.union(odd_docs).union(spark.createDataFrame([(None, "no id", None, None, None, None, None)], odd_docs.schema))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in jaccard.one_of_each(twice, 5, 80).collect()) == sorted([(False, i) for i in want] + [(True, 0)])
    assert jaccard.near_components(no_docs).count() == 0


def test_adaptive_links_find_every_component():
    rng = random.Random(1)
    for percent in (60, 80, 90):
        base = [rng.getrandbits(60) for _ in range(60)]
        sets = []
        for _ in range(80):
            s = set(base[: rng.choice([20, 60])])
            for _ in range(rng.randint(0, 12)):
                s.discard(rng.choice(base))
                s.add(rng.getrandbits(60))
            sets.append(np.array(sorted(s), np.uint64))
        links = jaccard.adaptive_links(sets, percent)
        forest, want = jaccard.Forest(80), jaccard.Forest(80)
        for a, b in links:
            forest.join(a, b)
        for a in range(80):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    want.join(a, b)
        assert [forest.find(i) for i in range(80)] == [want.find(i) for i in range(80)]


def test_like_sets_share_a_block_key():
    rng = random.Random(9)
    levels = np.array([rng.choice([0, 0, 0, 1, 5]) for _ in range(1 << jaccard.SLOT_BITS[0])], np.uint8)
    for percent in (75, 80, 90, 95):
        for _ in range(400):
            n = rng.choice([3, 8, 15, 20, 21, 24, 30, 60, 200])
            x = {rng.getrandbits(64) for _ in range(n)}
            y = set(x)
            while True:  # as unlike as can be
                z = set(y)
                if rng.random() < 0.5:
                    z.discard(rng.choice(sorted(z)))
                if rng.random() < 0.6:
                    z.add(rng.getrandbits(64))
                if not z or 100 * len(x & z) < percent * len(x | z):
                    break
                y = z
            keys = [set(jaccard.block_keys(np.array(sorted(s), np.uint64), levels, percent).tolist()) for s in (x, y)]
            assert keys[0] & keys[1], (percent, n)


def test_stored_tables_can_go(spark):
    from inkfall.llm.common import drop_stored, stored

    held = stored(spark.range(3), "t")
    assert held.count() == 3 and drop_stored(spark) >= 1 and drop_stored(spark) == 0
    with pytest.raises(Exception):
        held.count()


def test_components(spark):
    from inkfall.llm.components import components

    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)] + [(500, 500 + i) for i in range(1, 40)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100 and all(got[500 + i] == 500 for i in range(40))
    assert len(got) == 61 + 3 + 40


# --- substring removal ------------------------------------------------------


def brute_repeats(rows, window):
    first, out = {}, {}
    for i, text in sorted((i, t) for i, t in rows):
        w = (text or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in first:
                gone[s : s + window] = [True] * window
            else:
                first[key] = (i, s)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def plain_spaces(rows):
    return [(i, None if t is None else " ".join(t.encode().decode("utf-8").replace("　", "_").split())) for i, t in rows]


@pytest.mark.parametrize("window,shard", [(20, 2000), (5, 2000), (2, 2000), (20, 1), (5, 1), (2, 1)])
def test_repeat_digests(spark, odd_texts, monkeypatch, window, shard):
    monkeypatch.setattr(substring, "SHARD", shard)
    rows = plain_spaces(odd_texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeat_digests(docs, window).collect()}
    assert got == brute_repeats(rows, window)


def brute_rows(rows, window):
    """As ``brute_repeats``, but rows of one id are documents of their own by the digest of their text; a multiset of (id, words, removed, digest)."""
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    order = sorted({(i, md5(t), t or "") for i, t in rows if i is not None})
    named = {k: n for n, k in enumerate(order)}
    by = brute_repeats([(n, t) for (_, _, t), n in named.items()], window)
    whole = lambda t: (len(t.split()), 0, hashlib.sha256(" ".join(t.split()).encode()).hexdigest())
    return sorted(map(str, ((i, *(whole(t or "") if i is None else by[named[i, md5(t), t or ""]])) for i, t in rows)))


@pytest.fixture(params=["10000", "3"])
def batches(spark, request):
    """Arrow batches of several sizes: groups of rows reach over their ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("window,shard", [(5, 2000), (3, 2), (2, 1)])
def test_rows_that_share_an_id(spark, monkeypatch, batches, window, shard):
    monkeypatch.setattr(substring, "SHARD", shard)
    rng = random.Random(window)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "", " ".join(rng.choice("abcd") for _ in range(rng.randrange(25)))])) for _ in range(60)]
    rows += rows[:9]
    rows = [(i, None if t is None else " ".join(t.split())) for i, t in rows]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, tag int, marks string, start int, packed int").repartition(3)
    assert sorted(str(tuple(r)) for r in substring.repeat_digests(docs, window).collect()) == brute_rows(rows, window)
    cut = substring.without_repeats(docs, window)
    assert cut.columns == docs.columns
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(str((r["doc_id"], digest(r["text"] or ""))) for r in cut.collect()) == sorted(str((ast.literal_eval(x)[0], ast.literal_eval(x)[3])) for x in brute_rows(rows, window))


def test_an_unlike_row_of_one_id_stays_whole(spark):
    w, b = [" ".join(f"{c}{i}" for i in range(60)) for c in "wb"]
    docs = spark.createDataFrame([(1, w), (5, " ".join(f"a{i}" for i in range(10)) + " " + w), (5, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.repeat_digests(docs, 20).collect()) == [(1, 60, 0), (5, 60, 0), (5, 70, 60)]


def test_without_repeats(odd_docs, odd_texts, no_docs):
    got = {r["doc_id"]: r for r in substring.without_repeats(odd_docs, 50).collect()}
    want = brute_repeats(odd_texts, 50)
    texts = dict(odd_texts)
    for i, r in got.items():
        if want[i][1] == 0:
            assert r["text"] == texts[i] and r["n_chars"] == (None if texts[i] is None else len(texts[i]))
        else:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[i][2] and r["n_chars"] == len(r["text"])
    assert len(got) == len(texts) and sum(n for _, n, _ in want.values()) > 0
    assert substring.without_repeats(no_docs, 50).count() == 0


def test_automaton():
    rng = random.Random(4)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 4))]
        auto, seen = SuffixAutomaton(), []
        for t in texts:
            auto.start()
            for i, c in enumerate(t):
                got = auto.extend(c)
                best = max((n for n in range(0, i + 2) if n == 0 or any(t[i + 1 - n : i + 1] in s for s in seen) or t[i + 1 - n : i + 1] in t[:i]), default=0)
                assert got == best, (texts, t, i)
            seen.append(t)
        probe = "".join(rng.choice("ab") for _ in range(10))
        for i, got in enumerate(auto.matches(probe)):
            assert got == max(n for n in range(0, i + 2) if n == 0 or any(probe[i + 1 - n : i + 1] in s for s in seen))


def test_words_of_long_documents_stay_whole(spark):
    rng = random.Random(5)
    text = words(rng, 20000)
    docs = spark.createDataFrame([(1, text), (2, words(rng, 40) + " " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.repeat_digests(docs, 20).collect()}
    assert got == {1: 0, 2: 20000}


def test_texts_are_cut_together_as_one_by_one(monkeypatch):
    rng = random.Random(11)
    pool = [bytes(rng.choice(b"ab\x00\x1c\xc3\xa9.") for _ in range(n)) for n in [*range(1, 26), 63, 64, 65, 66, 128, 700] for _ in range(3)]
    texts = [b"".join(rng.choice(pool) + rng.choice([b" ", b"\t", b"\n", b"\x0b\x0c", b"\r "]) for _ in range(rng.choice([0, 0, 1, 19, 20, 21, 60, 300]))) for _ in range(80)]
    texts += [b"", b" ", b"\n\t", b"a " * 90, b"a b " * 40, b" x", b"x"]
    h, begins = substring.text_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert np.diff(begins).tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    monkeypatch.setattr(substring, "CHUNK", 3000)
    assert [i for a, b in substring.chunks(texts) for i in range(a, b)] == list(range(len(texts)))
    for x, y in substring.chunks(texts):
        part, edges = substring.text_hashes(texts[x:y])
        assert (part == h[begins[x] : begins[y]]).all() and (edges == begins[x : y + 1] - begins[x]).all()
    for window, gram in ((1, 1), (20, 4), (20, 12), (20, 20), (50, 4)):
        together = list(zip(*(c.tolist() for c in substring.segments(h, begins, window, gram))))
        single = [(i, *row[1:]) for i, (a, b) in enumerate(zip(begins, begins[1:])) for row in zip(*(c.tolist() for c in substring.segments(h[a:b], np.array([0, b - a]), window, gram)))]
        assert together == single
        assert sum(row[4] for row in together) == sum(max(0, len(t.split()) - window + 1) for t in texts)
    x = np.array([rng.randrange(6) for _ in range(500)], np.uint64)
    for wide in (1, 2, 3, 9, 17, 31, 500):
        assert substring.least_at(x, wide).tolist() == [i + int(x[i : i + wide].argmin()) for i in range(len(x) - wide + 1)]
    for _ in range(200):
        n, window = rng.randrange(40), rng.choice([1, 2, 20])
        marks = [(rng.randrange(45), rng.randrange(1, 6)) for _ in range(rng.randrange(6))]
        gone = {i for a, k in marks for i in range(a, a + k + window - 1)}
        text = [b"%d" % i for i in range(n)]
        assert substring.kept(text, *np.array(marks, np.int64).reshape(-1, 2).T, window) == [w for i, w in enumerate(text) if i not in gone]


def test_fed_sequences_match_as_extended_ones():
    rng = random.Random(3)
    for _ in range(60):
        plain, fed = SuffixAutomaton(), SuffixAutomaton()
        for _ in range(rng.randrange(1, 8)):
            values = [rng.randrange(3) for _ in range(rng.randrange(30))]
            plain.start()
            assert fed.feed(values) == [plain.extend(v) for v in values]


def test_cutting_texts_costs_little_more_than_splitting_them(monkeypatch):
    """CPU time of the segments of a batch, in that of splitting its texts into words: 14 when each text and word was hashed by itself."""
    monkeypatch.setattr(substring, "per_batch", lambda docs, make, schema: make)
    make, rng = substring._segments(None, 20), random.Random(5)
    texts = [" ".join(f"{rng.randrange(10**rng.randint(1, 9)):x}" for _ in range(500)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], ["doc_id", "tag", "text"])

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: make(batch)) < 6 * least(lambda: [t.encode().split() for t in texts])
