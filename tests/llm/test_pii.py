"""Personal data: base spans against the rules' patterns, the trees against Spark ML, what the method adds, whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from inkfall.llm import pii
from inkfall.llm.pii import KINDS, base_spans, disguised, fit, found, proposals, redact, redacted, span_digests, spans_of, spoilt

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The rules word for word."""
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def personal(rng):
    return rng.choice([
        f"{rng.choice(['ann', 'b.o'])}.{rng.randrange(99):02}@mail{rng.randrange(9)}.example.com",
        ".".join(str(rng.randrange(256)) for _ in range(4)), card(rng), f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(10000):04}",
    ])


def noise(rng):
    return rng.choice(["wort", "at", "éa", f"{rng.randrange(10**6)}", f"1.{rng.randrange(99)}.{rng.randrange(9)}", f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"token = \"{rng.randrange(16**20):x}\"", str(rng.randrange(10**15, 10**16)), "x@y", "."])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(personal(rng) if rng.random() < 0.1 else noise(rng) for _ in range(rng.randrange(60))), "x", 3) for i in range(400)]
    rows += [(None, None, "x", 1), (7, None, None, None), (7, "", "y", 0), (8, rows[8][1], "z", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, added int").repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return fit(docs)


@pytest.mark.parametrize("alphabet", ["ab@.-+ ", "0123456789.+", "01 -9", "+1 ().-9a", "a1@.b c-\n+(é", "25.0136 "])
def test_base_rules(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert base_spans(text) == plain(text), text


def test_base_rules_in_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = rng.choice(["", " ", ", "]).join(personal(rng) if rng.random() < 0.3 else noise(rng) for _ in range(rng.randrange(30)))
        assert base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "a" * 300_000 + "@", "@" * 300_000, "1" * 300_000, "1." * 200_000, "+" * 300_000, "+1" * 150_000, "1 " * 150_000, "a:" * 200_000, " at" * 100_000):
        base_spans(text)
        assert len(proposals(text)) <= 3_000_000
        spans_of([text], None)


def test_made_forms():
    rng = random.Random(3)
    for _ in range(300):
        own = personal(rng)
        ((kind, lo, hi),) = [s for s in base_spans(own)][:1]
        for form in disguised(kind, own[lo:hi]):
            assert (kind, 0, len(form)) in proposals(form), (kind, form)
        for form in spoilt(kind, own[lo:hi]):
            assert (kind, 0, len(form)) not in base_spans(form) or kind == "phone", (kind, form)


def test_trees_as_spark_ml(spark, docs):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = pii.examples(docs.selectExpr("coalesce(text, '') as text")).select("label", array_to_vector("features").alias("features"))
    boosted = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(rows)
    own = pii.Model([(w, pii.tree_arrays(t.toDebugString)) for w, t in zip(boosted.treeWeights, boosted.trees)], {})
    got = boosted.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("rawPrediction")[1].alias("m")).toPandas()
    assert np.allclose(own.scores(np.stack(got["x"])), got["m"])


def test_disguised_are_found_and_spoilt_are_not(model):
    rng = random.Random(9)
    caught = wrong = shown = bad = 0
    for _ in range(400):
        own = personal(rng)
        kind = base_spans(own)[0][0]
        for forms, good in ((disguised(kind, own), True), (spoilt(kind, own), False)):
            form = rng.choice(forms)
            text = f"{noise(rng)} wort {form} éa {noise(rng)}"
            lo = text.index(form)
            base, added = (s[0] for s in spans_of([text], model))
            hit = any(a < lo + len(form) and lo < b for _, a, b in base + added)
            caught, shown = caught + (hit and good), shown + good
            wrong, bad = wrong + (hit and not good), bad + (not good)
    assert caught >= 0.8 * shown and wrong <= 0.15 * bad, (caught, shown, wrong, bad)


def test_added_spans_touch_nothing(docs, model):
    for r in found(docs, model).collect():
        spans = sorted((s["start"], s["end"]) for s in r["added"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert not any(s["start"] < b["end"] and b["start"] < s["end"] for s in r["added"] for b in r["base"])


def test_digests(docs, model):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    got = span_digests(found(docs, model)).collect()
    assert len(got) == docs.count()
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = []
    for i, ts in texts.items():
        for t in ts:
            base, added = (s[0] for s in spans_of([t], model))
            assert base == plain(t)
            want.append((i, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(pii.in_order(base + added)), len(added)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_redacted(docs, model):
    assert redact("a b@c.de x 1.2.3.4", [("email", 2, 8), ("ip", 11, 18)]) == "a [EMAIL] x [IP]"
    assert redact("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"
    got = redacted(docs, model)
    assert got.schema == docs.schema and got.count() == docs.count()
    of = lambda t: None if t is None else redact(t, sum((s[0] for s in spans_of([t], model)), []))
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(of(r["text"])) for r in docs.collect())
    assert any("[PHONE]" in (r["text"] or "") for r in got.collect())
    assert sum(r["text"] is None for r in got.collect()) == 2


def test_too_little_to_learn_from(spark, no_docs):
    assert fit(no_docs) is None and found(no_docs, None).collect() == []
    few = spark.createDataFrame([(1, "mail a@b.cd or 2865555136")], "doc_id long, text string")
    assert fit(few) is None
    assert [len(r["base"]) for r in found(few, None).collect()] == [1]
