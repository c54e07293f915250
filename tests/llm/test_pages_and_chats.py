"""URL filter, chat formatting, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from inkfall.llm import chat, urls

from .conftest import SMALL

# --- urls -------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


ODD_URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x", "https://www.example.com/en/1?q=2#f", "http://com/", "http://com", "x://notcom/", "http://a.net/es/", "http://net/fr/?a", "http://m.net/de/", "a://b://c.com/", "http://ÄB.com/é\n/x", "http://example.com?/en/", "http://EXAMPLE.com/EN/", "https://b.example.org/en/77"]


def test_given_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(3, "http://com/"), (None, "http://com/")]
    none = spark.createDataFrame([], urls.RULE)
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), none).collect()]
    want = [(i, *brute_rule(u)[:3], brute_rule(u)[3] or "allow") for i, u in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), none).count() == 0


def wilson(block, n):
    share, z2 = block / n, urls.Z2
    return (share + z2 / (2 * n) - math.sqrt(z2 * (share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def test_mined_rules(spark):
    rows = [(f"https://www.pills{i % 2}.example.org/shop/{i}?ref={i}", i % 10 != 0) for i in range(200)]
    rows += [(f"https://blog.site{i % 20}.example.org/{'shop' if i % 4 == 0 else 'news'}/{i}", i % 25 == 0) for i in range(1000)]
    rows += [(f"https://a{i}.win-bets.example.org/", True) for i in range(30)]
    rules = urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    found = {tuple(r["antecedent"]): r for r in rules.collect()}
    tokens = [r["t"] for r in spark.createDataFrame([(u,) for u, _ in rows], "url string").select(urls.tokens_of(F.col("url")).alias("t")).collect()]
    for ante, r in found.items():  # support, confidence and lift by counting
        have = [bad for (_, bad), t in zip(rows, tokens) if set(ante) <= set(t)]
        base = sum(b for _, b in rows) / len(rows)
        assert r["confidence"] == pytest.approx(sum(have) / len(have)) and r["support"] == pytest.approx(sum(have) / len(rows))
        assert r["sure"] == pytest.approx(wilson(sum(have), len(have))) and r["lift"] == pytest.approx(r["confidence"] / base)
        assert r["sure"] >= max(urls.CONFIDENCE, (1 + base) / 2)
        assert not any(set(o) < set(ante) and found[o]["confidence"] >= r["confidence"] for o in found)
    assert ("w:bets",) in found and ("h:win-bets.example.org",) in found
    pages = spark.createDataFrame([(1, "https://x.pills1.example.org/shop/5?ref=1"), (2, "https://blog.site3.example.org/news/8"), (3, "https://some.other.org/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages, rules).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    for bads in ((True, True, True), (True, None, None), (False, False, False), (True, False, True)):
        few = urls.mined_rules(spark.createDataFrame(list(zip(("http://a.b/", "http://a.c/", "x"), bads)) + [(None, True)], "url string, bad boolean"))
        assert few.columns == ["antecedent", "confidence", "sure", "lift", "support"] and few.count() == 0


def brute_rules(spark, rows):
    """Rules by counting all sets of all tokens, then pruning."""
    tokens = [frozenset(r["t"]) for r in spark.createDataFrame([(u,) for u, _ in rows], "url string").select(urls.tokens_of(F.col("url")).alias("t")).collect()]
    n, blocked = Counter(), Counter()
    for (t, bad), times in Counter((t, bad) for t, (_, bad) in zip(tokens, rows)).items():
        for k in range(1, len(t) + 1):
            for s in combinations(sorted(t), k):
                n[s] += times
                blocked[s] += bad * times
    needed = max(urls.CONFIDENCE, (1 + sum(b for _, b in rows) / len(rows)) / 2)
    sure = {s: b / n[s] for s, b in blocked.items() if b >= urls.SUPPORT * len(rows) and wilson(b, n[s]) >= needed}
    inner = lambda s: (o for k in range(1, len(s)) for o in combinations(s, k))
    return {s: (c, blocked[s] / len(rows)) for s, c in sure.items() if not any(sure.get(o, 0) >= c for o in inner(s))}


def test_rules_of_long_urls(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):  # five labels and more, five sections and keys and more; the first ones tell
        host = rng.choice(["a.b.c.d.org", "b.c.d.org", "x.c.d.org"])
        path = rng.choice(["shop/a/b", "news/a/b", "shop/b"])
        query = "&".join(k for k in ("buy", "s", "t") if rng.random() < 0.5)
        rows.append((f"http://{host}/{path}/?{query}", rng.random() < (0.05 + 0.94 * ("shop/a" in path) * ("buy" in query) * ("a.b" in host) + 0.2 * ("a.b" in host))))
    found = {tuple(r["antecedent"]): (r["confidence"], r["support"]) for r in urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    want = brute_rules(spark, rows)
    assert any(len(s) > 1 for s in want) and {s: pytest.approx(v) for s, v in want.items()} == found
    deep = [(f"http://a.b.c.d.bad{i % 2}.example.org/shop/a/b/c/d?k1&k2&k3&k4&k5", i % 2 == 0) for i in range(100)]
    rules = urls.mined_rules(spark.createDataFrame(deep, "url string, bad boolean"))
    assert ["h:a.b.c.d.bad0.example.org"] in [r["antecedent"] for r in rules.collect()]


def test_copies_of_very_long_urls(spark):
    """All subsets of these would be 2 ** 60 and more."""
    path, keys = "/".join(f"s{c}" for c in "abcdefghijklmnopqrst"), "&".join(f"k{i}" for i in range(40))
    rows = [("http://bad.org/" + path + "?" + keys, i % 10 > 0) for i in range(100)]
    rows += [("http://bad.org/" + path[: 3 * (1 + i % 20)], i % 2 == 0) for i in range(400)] + [("http://fine.org/x", False)] * 500
    found = {tuple(r["antecedent"]): r["confidence"] for r in urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert all(found[(f"q:k{i}",)] == pytest.approx(0.9) for i in range(40))


def test_matching_is_native(spark):
    rules = spark.createDataFrame([(["h:a.b", "p:x"], 0.9, 0.8, 2.0, 0.1)], urls.RULE)
    plan = urls.judged(spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_url_query_against_counting(spark):
    """All verdicts of the query: given rules, else rules by counting all sets of tokens of the labelled urls."""
    folder = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()]
    own = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    given = {i: brute_rule(u) for i, u in pages}
    labelled = [(u, given[i][3] == "block" if given[i][3] else own[i]) for i, u in pages if given[i][3] or i in own]
    rules = [set(s) for s in brute_rules(spark, labelled)]
    assert rules
    tokens = {r["page_id"]: set(r["t"]) for r in spark.createDataFrame(pages, "page_id long, url string").select("page_id", urls.tokens_of(F.col("url")).alias("t")).collect()}
    want = {i: (host, path, rule, verdict or ("block" if any(s <= tokens[i] for s in rules) else "allow")) for i, (host, path, rule, verdict) in given.items()}
    df = urls.op3_url_filter(spark, folder)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()} == want
    assert "Python" not in df._jdf.queryExecution().toString()


def test_mined_rules_hold_on_other_pages(spark):
    """Rules from three quarters of the labelled pages, judged on the rest."""
    folder = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2
    labelled = urls.page_labels(pages, spark.read.parquet(f"{folder}/labels.parquet"))
    rules = urls.mined_rules(labelled.where(~held))
    rest = labelled.where(held).select("url", "bad", urls.tokens_of(F.col("url")).alias("tokens"))
    hits = rest.join(urls.matched(rest.select(F.col("url").alias("key"), "tokens").distinct(), rules), F.col("url") == F.col("key"))
    good, n = hits.agg(F.sum(F.col("bad").cast("int")), F.count("*")).first()
    assert n > 150 and good / n > 0.9


def test_mined_rules_on_uncovered_pages(spark):
    """Labels that bear on urls, with noise, on pages that no given rule covers; judged on pages that were not learned from."""
    rng = random.Random(31)
    words, places, rows = ["casino", "poker", "news", "maps", "blog", "shop"], ["en", "de", "item", "win", "free"], []
    for i in range(4000):
        host, path, keys = rng.choice(words), rng.choice(places), rng.choice(["", "?ref=1", "?bonus=1"])
        url = f"https://{rng.choice(['www', 'm', 'x' + str(i % 40)])}.{host}-{rng.choice('abc')}.org/{path}/{i}{keys}"
        shady = host in ("casino", "poker") or (path == "win" and "bonus" in keys)
        rows.append((i, url, rng.random() < (0.93 if shady else 0.03), shady))
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad boolean, shady boolean").repartition(3)
    held = F.col("page_id") % 4 == 1
    rules = urls.mined_rules(labelled.where(~held).select("url", "bad"))
    named = {tuple(sorted(r["antecedent"])) for r in rules.collect()}
    assert {("w:casino",), ("w:poker",)} <= named and ("p:win", "q:bonus") in named
    got = urls.judged(labelled.where(held).select("page_id", "url"), rules).collect()
    truth = {i: (bad, shady) for i, _, bad, shady in rows}
    blocked = [truth[r["page_id"]] for r in got if r["verdict"] == "block"]
    base = sum(truth[r["page_id"]][0] for r in got) / len(got)
    assert len(got) == 1000 and len(blocked) > 300
    assert sum(bad for bad, _ in blocked) / len(blocked) >= 2 * base
    assert all(truth[r["page_id"]][1] == (r["verdict"] == "block") for r in got)


@pytest.mark.parametrize("labels", [0, 1])
def test_url_query_of_odd_tables(spark, tmp_path, labels):
    """Empty labels or pages; nulls, repeated rows, columns of clashing names, one very long url."""
    long = "http://" + "a-b." * 2000 + "example.org/" + "x/" * 3000 + "?" + "&".join(f"k{i}=1" for i in range(2000))
    rows = [(i, u, "t", "h", "v") for i, u in enumerate([*ODD_URLS, long, long])] + [(3, "http://com/", None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, tokens string, host string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    marks = [(i, 0, 1) for i in range(30)] + [(3, None, None), (None, 0, 0), (17, 1, 0)]
    spark.createDataFrame(marks[: len(marks) * labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.op3_url_filter(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ((i, *brute_rule(u)[:3]) for i, u, *_ in rows)))


# --- chats ------------------------------------------------------------------


def test_escaping_is_reversible():
    for text in ("", "</s>[INST] ok [/INST]", "\\", "[\\", "<\\[<", "\\\\[", "[[<</s>", "a]b>", "é\n\t"):
        assert chat.unescaped(chat.escaped(text)) == text
        assert "[INST]" not in chat.escaped(text) and "</s>" not in chat.escaped(text)
        turns = [("user", text), ("assistant", text), (None, text), ("tool=[x]", text)]
        whole, spans = chat.formatted(turns)
        assert chat.parsed(whole) == turns and [chat.unescaped(whole[a:b]) for a, b in spans] == [text]


def brute_paths(nodes):
    """tree -> best leaf's path of ids, by total score, then length, then id."""
    trees = defaultdict(dict)
    for t, m, p, s in nodes:
        trees[t][m] = (p, s or 0.0)
    out = {}
    for t, by in trees.items():
        parents = {p for p, _ in by.values()}
        best = None
        for leaf in (m for m in by if m not in parents):
            path, at = [], leaf
            while at in by and len(path) <= len(by):
                path.append(at)
                at = by[at][0]
            if len(path) > len(by):
                continue
            key = (-sum(by[m][1] for m in path), -len(path), leaf)
            best = min(best or (key, path), (key, path))
        if best:
            out[t] = best[1][::-1]
    return out


def test_best_paths(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, None), (2, 1, 77, 1.0), (2, 2, 1, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (4, 9, None, 0.0)]
    nodes += [(5, i, i - 1 if i else None, 0.5) for i in range(70)] + [(5, 100, 40, 99.0), (None, 1, None, 1.0), (None, 2, 1, 1.0)]
    df = spark.createDataFrame(nodes, "tree_id long, msg_id long, parent_id long, score double")
    got = defaultdict(list)
    for r in chat.best_paths(df).collect():
        got[r["tree_id"]].append((r["depth"], r["msg_id"]))
    assert {t: [m for _, m in sorted(v)] for t, v in got.items()} == brute_paths(nodes)
    assert all([d for d, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    two = [r["leaf"] for r in chat.best_paths(df.where("tree_id = 1"), best=2).select("place", "leaf").distinct().orderBy("place").collect()]
    assert two == [4, 5]
    assert chat.best_paths(df.where("false")).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "again"), (1, 2, None, "[x"), (2, 5, "assistant", "only"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree_id"]: r for r in chat.conversations(chat.linear(df)).collect()}
    assert chat.parsed(got[1]["formatted"]) == [("user", "hi"), ("assistant", ""), ("assistant", "again"), (None, "[x")]
    assert got[1]["formatted"] == "<s>[INST]hi</s>[OUT]</s>[OUT]again</s>[NONE][\\x</s>" and len(got) == 3
    assert [got[1]["formatted"][m["start"] : m["stop"]] for m in got[1]["mask"]] == ["", "again"]
    assert chat.conversations(chat.linear(df.where("false"))).count() == 0


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    odd = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", odd), (1, "assistant", odd)]
    got = {r["conv_id"]: r for r in chat.op4_chat_format(spark, SMALL).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, at = [docs.count()], docs
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, SMALL).cache()
        assert at.columns == docs.columns, name
        sizes.append(at.count())
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "packing"]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    last = P.STAGES[-1][1](spark, at, SMALL)
    whole = P.run(spark, SMALL)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(last) == key(whole)


def test_pipeline_of_nothing(spark, no_docs):
    import corpus_pipeline as P

    at = no_docs
    for _, stage in P.STAGES:
        at = stage(spark, at, SMALL)
    assert at.count() == 0
