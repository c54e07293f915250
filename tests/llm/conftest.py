import random

import pytest

SMALL = "/root/testdata/sf0.001"


def words(rng, n):
    parts = ["th", "er", "an", "re", "on", "at", "en", "nd", "ti", "es"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, one very long text, non-ASCII."""
    rng = random.Random(7)
    base, passage, long = words(rng, 120), words(rng, 60), words(rng, 21000)
    rows = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two"), (8, "É à ﬁ Ⅷ 　x"), (9, "e\u0301 a\u0300 fi VIII x"), (10, long), (11, long[:60000] + " " + words(rng, 30)), (12, "a " * 90), (13, "a b " * 40), (14, words(rng, 30) + " " + passage + " " + words(rng, 25)), (15, passage), (16, passage + " " + words(rng, 10))]
    for i in range(17, 60):
        w = base.split()
        for _ in range(rng.choice([1, 1, 2, 3, 6, 9])):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(i, words(rng, rng.randint(1, 40))) for i in range(60, 90)]
    rows += [(90 + i, rows[60 + i][1]) for i in range(10)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """With other columns, some of names that operators use inside."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "x", 1) for i, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, marks string, kept int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
