"""The column path: against the plain path on all situations and on random records, errors, plans, streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkfall import errors
from inkfall.template import Template

from .test_templates import OUTPUTS, STAGE, body


def frame(spark, t, records):
    return t.frame(spark, records) if any(records) else spark.range(len(records)).select()


@pytest.mark.parametrize("engine", ["catalyst", "python"])
def test_same_as_plain_path(spark, engine):
    union = None
    for name, (source, values, want) in OUTPUTS.items():
        t = Template(source)
        df = frame(spark, t, [values])
        one = df.select(F.lit(name).alias("name"), t.column(df, engine=engine).alias("out"), F.lit(want).alias("want"))
        union = one if union is None else union.union(one)
    assert [(r["name"], r["out"], r["want"]) for r in union.where("not out <=> want").collect()] == []


WIDE = Template(body(
    ["n = int", "m = int", "f = float", "g = float", "s = str", "x = list(int)", "y = list(option(str))", "o = option(float)", "st = Stage", "e = enum(A(v = int), B(v = str), C)", "rows = list(k = str, n = int, t = option(str))"],
    "{{ n | add(3) }} {{ n | sub(9223372036854775807) }} {{ m | fixed(2) }} {{ f }} {{ f | fixed(3) }} {{ f | add(0.0) | fixed(2) }} {{ g | fixed(0) }} [{{ s | trim }}] {{ s | upper }} {{ len(s) }} {{ len(x) }} {{ x | join(\",\") }} {{ y | join(\"/\") }} {{ o }} {{ kind(o) }} "
    "{% if n > f %}a{% endif_ %}".replace("{% if n > f %}a{% endif_ %}", "")
    + "{% if n > f %}gt{% /if %}{% if n >= f %}ge{% /if %}{% if f < n %}lt{% /if %}{% if f <= n %}le{% /if %}{% if f == g %}eq{% /if %}{% if f < g %}<{% /if %}{% if n == m && !f %}z{% /if %}{% if m in x || s in \"abc\" %}in{% /if %}"
    "{% if has(o) && o > 1.5 %}big{% elif has(o) %}some{% else %}no{% /if %}{% match st case Plan | Ship %}ps{% /match %}{% match e %}{% case A && e.v > 0 %}A+{% case A %}A{% case B %}B{{ e.v }}{% case C %}C{% /match %}"
    "{% for r in rows %}({{ idx(r) }}{{ r.k }}{% if has(r.t) %}{{ r.t | lower }}{% else %}?{% /if %}{% for q in x %}{% if q == r.n %}={{ idx(q) }}.{{ idx(r) }}{% /if %}{% /for %}){% else %}nil{% /for %}",
    STAGE,
))


def random_record(rng):
    ints = [0, 1, -1, 7, (1 << 63) - 1, -(1 << 63), 9007199254740993, rng.randint(-50, 50)]
    floats = [0.0, -0.0, 1.0, -2.5, 0.125, 2.675, 1e21, 1.5e-7, 123456789.125, 9007199254740992.0, float("nan"), float("inf"), -float("inf"), rng.uniform(-1e6, 1e6), rng.randint(-1000, 1000) / 8]
    texts = ["", " a\t", "Straße", " x y ", "ab", "é\n", "b", "\x85q　"]
    word = lambda: rng.choice(texts)
    return {
        "n": rng.choice(ints), "m": rng.choice(ints), "f": rng.choice(floats), "g": rng.choice(floats), "s": word(), "x": [rng.choice(ints) for _ in range(rng.randint(0, 3))],
        "y": [rng.choice([None, word()]) for _ in range(rng.randint(0, 3))], "o": rng.choice([None, rng.choice(floats)]), "st": rng.choice(["Plan", "Make", "Ship"]),
        "e": rng.choice([{"__kind__": "A", "v": rng.randint(-2, 2)}, {"__kind__": "B", "v": word()}, {"__kind__": "C"}]),
        "rows": [{"k": word(), "n": rng.choice(ints), "t": rng.choice([None, word()])} for _ in range(rng.randint(0, 3))],
    }


def test_random_records(spark):
    rng = random.Random(4)
    records = [random_record(rng) for _ in range(300)]
    df = frame(spark, WIDE, records).coalesce(1)
    got = [r["out"] for r in WIDE.render(df).collect()]
    want = [WIDE.render_dict(r) for r in records]
    bad = [(g, w, r) for g, w, r in zip(got, want, records) if g != w]
    assert not bad, "\n".join(f"{g!r}\n{w!r}" for g, w, _ in bad[:3])


def test_numbers_as_text(spark):
    rng = random.Random(2)
    xs = [rng.choice([rng.uniform(-1, 1) * 10 ** rng.randint(-12, 14), rng.randint(-(10**7), 10**7) / 100, rng.randint(-(10**5), 10**5) / 8]) for _ in range(4000)]
    t = Template(body(["x = float"], "{{ x }} {{ x | fixed(2) }} {{ x | sub(0) | fixed(2) }}"))
    got = [r["out"] for r in t.render(spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)).collect()]
    bad = [(x, g, t.render_dict({"x": x})) for x, g in zip(xs, got) if g != t.render_dict({"x": x})]
    assert len(bad) <= 4, bad[:5]  # this JVM's digits are not always the shortest


def test_errors_in_a_column(spark):
    t = Template(body(["n = int", "s = Stage"], "> {% if n > 5 %}{% panic(\"too many: {{ n }}\") %}{% /if %}{{ n }} {{ kind(s) }}", STAGE))
    df = spark.createDataFrame([(1, "Plan"), (None, "Make"), (9, "Ship"), (2, "Zzz")], "n long, s string").coalesce(1)
    got = [(r["out"], r["error_kind"], r["error"]) for r in t.render_try(df).collect()]
    assert got[0] == ("1 Plan", None, None)
    assert got[1] == (None, "type_mismatch", "type mismatch: 'n': expected int, got none ()")
    assert got[2] == (None, "panic", "template panic: too many: 9")
    assert got[3][:2] == (None, "type_mismatch") and "got str (Zzz)" in got[3][2]
    with pytest.raises(Exception, match="type mismatch for 'n': expected int, got none"):
        t.render(df).collect()
    with pytest.raises(Exception, match="template panic: too many: 9"):
        t.render(df.where("n = 9")).collect()
    assert t.render(df.where("n = 1"), unchecked=True).first()["out"] == "1 Plan"


def test_schema_is_checked_before_any_job(spark):
    t = Template(body(["n = int", "rows = list(k = str, v = option(int))"], "{{ n }}{% for r in rows %}{{ r.k }}{{ r.v }}{% /for %}"))
    with pytest.raises(errors.MissingParams, match="rows"):
        t.column(spark.range(1).select(F.col("id").alias("n")))
    with pytest.raises(errors.TypeMismatch, match=r"rows\[\].k"):
        t.column(spark.sql("select 1 n, array(struct(1 k, 2 v)) rows"))
    with pytest.raises(errors.TypeMismatch, match="'n'"):
        t.column(spark.sql("select 'x' n, array(struct('a' k, 2 v)) rows"))
    wide = spark.sql("select 1 n, array(struct('a' k, 2 v, 'more' z)) rows, 0 extra")
    assert t.render(wide).first()["out"] == "1a2"
    with pytest.raises(errors.ExtraParams, match="extra"):
        t.column(wide, allow_extra=False)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_reads_what_the_template_reads(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    t = Template(body(["c_name = str", "c_acctbal = float"], "{{ c_name }}{% if c_acctbal > 0 %} +{% /if %}"))
    text = plan(df.where("c_custkey > 5").select(t.column(df).alias("out")))
    assert "Python" not in text and "Exchange" not in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in text and "GreaterThan(c_custkey,5)" in text


def test_plain_loops_need_no_lambda(spark):
    df = spark.createDataFrame([(["a", "b"],)], "x array<string>")
    t = Template(body(["x = list(str)"], "> {% for i in x %}- {{ i }};{% /for %}"))
    text = plan(df.select(t.column(df, unchecked=True).alias("out")))
    assert "transform" not in text and t.render(df).first()["out"] == "- a;- b;"


def test_nested_columns_are_pruned(spark, tmp_path):
    spark.sql("select struct('a' x, 'b' y) u, 1 z").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    t = Template(body(["u = struct(x = str)"], "{{ u.x }}"))
    assert "ReadSchema: struct<u:struct<x:string>>" in plan(df.select(t.column(df, unchecked=True).alias("out")))


def test_large_trees_go_to_python(spark):
    t = Template(body(["n = int"], "".join(f"{{% if n == {i} %}}{i}{{% /if %}}".replace("{%", "{%") for i in range(900)).join(["x", "y"])))
    assert t.engine() == "python"
    assert t.render(spark.range(3).select(F.col("id").alias("n"))).collect()[2]["out"] == "x2y"


def test_json_append_document(spark):
    t = Template(body(["k = int", "w = str := \"w\""], "<{{ k }}{{ w }}>"))
    df = spark.createDataFrame([('{"k": 4, "w": "q"}', "a"), ('{"k": 5, "w": "r"}', "b")], "json string, id string").coalesce(1)
    assert [r["out"] for r in t.render_json(df).collect()] == ["<4q>", "<5r>"]
    rows = spark.createDataFrame([(2, "B"), (1, "A")], "k long, text string")
    assert sorted(r["text"] for r in t.append(rows, "text").collect()) == ["A<1w>", "B<2w>"]
    assert t.document(rows.select("k"), ["k"], "|").first()["out"] == "<1w>|<2w>"


RECORD = {"k": -7, "big": 1 << 40, "w": "héllo", "xs": [1, 2, 300], "rows": [{"a": "x", "b": 2.5}, {"a": "y", "b": None}], "on": True}
RECORD_TEMPLATE = body(["k = int", "big = int", "w = str", "xs = list(int)", "rows = list(a = str, b = option(float))", "on = bool"], "{{ k }} {{ big }} {{ w }} {{ xs | join(\",\") }} {% for r in rows %}{{ r.a }}={{ r.b }};{% /for %} {{ on }}")


def cbor_bytes(v):
    """A plain encoder for the test."""

    def head(kind, n):
        return bytes([kind << 5 | n]) if n < 24 else bytes([kind << 5 | 27]) + n.to_bytes(8, "big")

    if v is None or isinstance(v, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[v]
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, float):
        import struct

        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return b"\x9f" + b"".join(map(cbor_bytes, v)) + b"\xff"
    return head(5, len(v)) + b"".join(cbor_bytes(x) for pair in v.items() for x in pair)


def test_cbor(spark):
    t = Template(RECORD_TEMPLATE)
    df = spark.createDataFrame([(1, bytearray(cbor_bytes(RECORD)))], "id long, cbor binary")
    assert t.render_cbor(df).select("id", "out").first()["out"] == t.render_dict(RECORD)


def test_flexbuffers(spark):
    flexbuffers = pytest.importorskip("flatbuffers.flexbuffers")
    t = Template(RECORD_TEMPLATE)
    df = spark.createDataFrame([(1, bytearray(flexbuffers.Dumps(RECORD)))], "id long, buffers binary")
    assert t.render_flexbuffers(df).first()["out"] == t.render_dict(RECORD)


def test_catalog_frame(spark):
    from inkfall.sources import catalog_df

    t = Template(body(["k = int := 3"], "{{ k }}"))
    row = catalog_df(spark, {"t": t}).first()
    assert (row["name"], row["params"], row["defaults"], row["source_hash"]) == ("t", "k = int", "k", t.source_hash)


def test_stream_of_windows(spark, tmp_path):
    from inkfall.streaming import windowed_lists

    spark.sql("select timestamp'2024-01-01 00:00:10' ts, 'a' kind, 1.0D v union all select timestamp'2024-01-01 00:00:05', 'b', 2.0D union all select timestamp'2024-01-01 00:03:00', 'c', 3.0D union all select timestamp'2024-01-01 02:00:00', 'z', 0D").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, kind string, v double").parquet(f"{tmp_path}/in")
    lists = windowed_lists(events, "ts", "1 minute", "1 minute", [], ["kind", "v"], "items")
    t = Template(body(["items = list(kind = str, v = float)"], "{% for i in items %}{{ i.kind }}={{ i.v }} {% /for %}".replace("{%", "> {%", 1)))
    out = lists.select(F.col("window.start").cast("string").alias("start"), t.column(lists).alias("out"))
    query = out.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["out"] for r in spark.sql("select * from windows").collect()) == ["b=2 a=1 ", "c=3 "]


def test_math_is_there():
    assert math.isnan(float("nan"))


# --- faults inside of values ------------------------------------------------

KINDS = "types:\n  - K = enum(A, B)\n  - P = enum(Hit(d = str, n = option(int)), Miss, Deep(xs = list(v = float)))\n\n"
DEEP = ["rows = list(a = str, b = option(int), k = K)", "p = P", "ks = list(K)", "o = option(struct(m = list(list(int)))) := None", "f = float := 1.5", "t = str := \"d\""]
DEEP_TEMPLATE = body(DEEP, "> {% for r in rows %}<{{ r.a }}:{{ r.b }}:{{ kind(r.k) }}>{% /for %}{% match p %}{% case Hit %}{{ p.d }}{{ p.n }}{% case Miss %}-{% case Deep %}{% for x in p.xs %}{{ x.v }};{% /for %}{% /match %}{% for k in ks %}{{ k }}{% /for %}{% if has(o) %}{% for m in o.m %}{% for i in m %}{{ i }},{% /for %}{% /for %}{% /if %}{{ f }}{{ t }}", KINDS)
GOOD = {"rows": [{"a": "x", "b": None, "k": "A"}, {"a": "y", "b": 4, "k": "B"}], "p": {"__kind__": "Hit", "d": "d", "n": None}, "ks": ["A", "B"], "o": {"m": [[1, 2], []]}, "f": 2.5, "t": "u"}
#: What is changed in a good record, and where the fault is (None: it stays good).
CHANGES = [
    ({}, None),
    ({"rows": []}, None),
    ({"p": {"__kind__": "Miss"}, "o": None}, None),
    ({"p": {"__kind__": "Deep", "xs": [{"v": 1.5}]}}, None),
    ({"rows": None}, "'rows'"),
    ({"rows": [GOOD["rows"][0], {"a": None, "b": 1, "k": "A"}]}, "'rows[1].a'"),
    ({"rows": [GOOD["rows"][0], {"a": "z", "b": 1, "k": "C"}]}, "'rows[1].k'"),
    ({"rows": [None]}, "'rows[0]'"),
    ({"p": {"__kind__": "Hit", "d": None, "n": 1}}, "'p.d'"),
    ({"p": {"__kind__": "Deep", "xs": [{"v": 0.5}, {"v": None}]}}, "'p.xs[1].v'"),
    ({"p": {"__kind__": "Nope"}}, "'p'"),
    ({"ks": ["A", "Z"]}, "'ks[1]'"),
    ({"ks": [None]}, "'ks[0]'"),
    ({"o": {"m": [[1], [2, None]]}}, "'o.m[1][1]'"),
    ({"o": {"m": None}}, "'o.m'"),
    ({"t": None}, "'t'"),
]


def expected(t, record):
    try:
        return t.render_dict(record), None
    except errors.TemplateError as e:
        return None, e.kind


@pytest.mark.parametrize("engine", ["catalyst", "python"])
def test_faults_inside_of_columns(spark, engine):
    t = Template(DEEP_TEMPLATE)
    records = [GOOD | change for change, _ in CHANGES]

    def row(r):
        p = r["p"]
        return (r["rows"], (p["__kind__"], p.get("d"), p.get("n"), p.get("xs")), r["ks"], r["o"], r["f"], r["t"])

    schema = "rows array<struct<a:string,b:long,k:string>>, p struct<__kind__:string,d:string,n:long,xs:array<struct<v:double>>>, ks array<string>, o struct<m:array<array<long>>>, f double, t string"
    df = spark.createDataFrame([row(r) for r in records], schema).coalesce(1)
    for r, record, (_, where) in zip(t.render_try(df, engine=engine).collect(), records, CHANGES):
        assert (r["out"], r["error_kind"]) == expected(t, record)
        assert (where in r["error"]) if where else r["error"] is None
    with pytest.raises(Exception, match=r"type mismatch for 'rows\[1\].a': expected str, got none"):
        t.render(df.where("exists(rows, r -> r is not null and r.a is null)"), engine=engine).collect()


def test_records_are_held_to_their_types(spark):
    import json

    t = Template(DEEP_TEMPLATE)
    records = [GOOD | change for change, _ in CHANGES]
    drop = lambda *names: {k: v for k, v in GOOD.items() if k not in names}
    records += [drop("t"), drop("f", "o"), drop("rows"), drop("p", "rows"), GOOD | {"z": 1, "y": 2}, GOOD | {"f": 3}, GOOD | {"t": 5}, GOOD | {"ks": "A"}, GOOD | {"p": "Miss"}, GOOD | {"p": "Hit"}, GOOD | {"f": "1"}, GOOD | {"rows": [{"a": "x", "k": "A"}]}, GOOD | {"rows": [{"b": 1, "k": "A"}]}, GOOD | {"rows": [{"a": "x", "b": 1.0, "k": "A"}]}, GOOD | {"f": 1 << 70}, GOOD | {"o": {"m": [[1 << 63]]}}]
    texts = [json.dumps(r) for r in records] + ["{bad", "[1]", "", None, "3"]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "id long, json string, t string").coalesce(1)
    got = t.render_json(df, catch=True).orderBy("id").collect()
    for r, record in zip(got, records):
        want = expected(t, record)
        if isinstance(record.get("f"), int) and record["f"] > 1 << 64:
            continue  # a number too large for an int is a float in JSON
        assert (r["out"], r["error_kind"]) == want, record
        assert r["t"] == "clash"
    assert [r["error_kind"] for r in got[len(records) :]] == ["invalid_record"] * 5
    assert [r["error"] for r in got if r["error_kind"] == "extra_params"] == ["extra undeclared parameters: y, z"]
    assert [r["error"] for r in got if r["error_kind"] == "missing_params"] == ["missing required parameters: rows", "missing required parameters: rows, p"]
    assert t.render_json(df.where("id = 20"), allow_extra=True).first()["out"] == t.render_dict(GOOD)


def test_broken_binary_records(spark):
    t = Template(body(["n = int := 3", "s = str"], "{{ n }}{{ s }}"))
    rows = [(1, bytearray(cbor_bytes({"s": "x"}))), (2, bytearray(b"\xff")), (3, bytearray(b"")), (4, bytearray(cbor_bytes({"s": "x", "n": "y"}))), (5, None)]
    got = t.render_cbor(spark.createDataFrame(rows, "id long, cbor binary"), catch=True).orderBy("id").collect()
    assert [(r["out"], r["error_kind"]) for r in got] == [("3x", None), (None, "invalid_record"), (None, "invalid_record"), (None, "type_mismatch"), (None, "invalid_record")]


def test_digits_of_large_and_small_numbers(spark):
    import random
    import struct
    from decimal import Decimal

    rng = random.Random(11)
    xs = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(1500)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 20) for _ in range(1500)]
    xs += [-7.42745909780761e17, 2e23, 1e23, 9e-22, 1.7976931348623157e308, 9007199254740993.0, 1039514241563211.8, 9.223372036854775e18, 123456789.125]
    xs += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(rng.randint(1, 52)) | 1))[0] * rng.choice((1, -1)) for _ in range(1500)]  # below the normal ones
    xs += [k * 5e-324 for k in range(1, 120)] + [2.2250738585072014e-308, 1e-300, 9.999e-301]
    xs = [x for x in xs if math.isfinite(x)]
    t = Template(body(["x = float"], "{{ x }}"))
    got = [r["out"] for r in t.render(spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)).collect()]
    plain = [format(Decimal(repr(x)), "f") for x in xs]
    assert got == [p.rstrip("0").rstrip(".") if "." in p else p for p in plain]


def test_short_and_long_lists_alike(spark):
    """Loops are written out for short lists and lambdas for long ones."""
    t = Template(body(["x = list(option(int))", "y = list(a = str)"], "> {% for i in x %}{{ idx(i) }}:{{ i }};{% else %}none{% /for %}|{% for r in y %}{% if idx(r) > 0 %},{% /if %}{{ r.a | upper }}{% /for %}"))
    records = [{"x": [None if i % 3 == 1 else i for i in range(n)], "y": [{"a": f"v{i}"} for i in range(7 - n)]} for n in range(8)]
    df = spark.createDataFrame([(r["x"], [(e["a"],) for e in r["y"]]) for r in records], "x array<long>, y array<struct<a:string>>").coalesce(1)
    assert [r["out"] for r in t.render(df).collect()] == [t.render_dict(r) for r in records]


def large(n):
    """A template of about 10 n nodes: choices, matches, filters, nested large branches and stops."""
    out = []
    for i in range(n):
        k = i % 5
        if k == 0:
            out.append(f"\n- row {i}: {{{{ f | upper }}}} {{{{ q | add({i}) }}}} {{{{ d }}}}\n")
        elif k == 1:
            out.append(f"\n> {{% if q > {i % 50} && f == \"A\" %}}a{i}{{% elif d < 0.0{i % 9} %}}b{{{{ d }}}}{{% else %}}c{i}{{% /if %}}\n")
        elif k == 2:
            out.append(f"\nx{i} {{{{ d | fixed(2) }}}}\n")
        elif k == 3:
            out.append(f"\n> {{% match f %}}{{% case \"A\" | \"N\" %}}{{{{ q | sub({i}) }}}}{{% else %}}r{i}{{% /match %}}\n")
        else:
            out.append(f"\n> {{% if q == {i} %}}{{% panic(\"stop {i} of {{{{ f }}}}\") %}}{{% /if %}}\n")
    half = "".join(out[: n // 2])
    return body(["q = int", "d = float", "f = str"], f"> {{% if f == \"R\" %}}\n{half}\n> {{% else %}}\n\nother\n{''.join(out[n // 2:])}\n> {{% /if %}}\n" + "".join(out[:20]))


def test_large_template_by_projections(spark):
    t = Template(large(400))
    rows = [(i % 60, i / 16, "ANR"[i % 3]) for i in range(120)] + [(None, 1.0, "R"), (3, None, "A")]
    df = spark.createDataFrame(rows, "q long, d double, f string").coalesce(1)
    shown = t.render_try(df)
    assert "Python" not in shown._jdf.queryExecution().executedPlan().toString()
    kinds = set()
    for (q, d, f), r in zip(rows, shown.collect()):
        assert (r["out"], r["error_kind"]) == ((None, "type_mismatch") if q is None or d is None else expected(t, {"q": q, "d": d, "f": f}))
        kinds.add(r["error_kind"])
        assert r["error"] is None or r["error_kind"] != "panic" or r["error"] == f"template panic: stop {q} of {f}"
    assert kinds == {None, "panic", "type_mismatch"}
    good = df.where("q is not null and d is not null").where("q % 5 <> 4").withColumn("_piece0", F.lit("kept"))
    got = t.render(good)
    assert got.columns == ["q", "d", "f", "_piece0", "out"]
    assert all(r["out"] == t.render_dict({"q": r["q"], "d": r["d"], "f": r["f"]}) and r["_piece0"] == "kept" for r in got.collect())


def test_equal_parameters_are_rendered_once(spark):
    """Each row has the text that rendering row by row gives it: zeros of both signs, NaN and missing options are sets of their own."""
    t = Template(body(["x = float", "n = option(int)", "f = str"], "{{ x }}|{{ x | fixed(1) }}|{% if x == 0.0 %}plus{% else %}other{% /if %}|{{ n }}|{{ f | upper }}"))
    xs, ns, fs = [0.0, -0.0, math.nan, math.inf, 1.5, -1.5], [None, 0, (1 << 63) - 1], ["", "a", "A", "a "]
    rows = [(i, xs[i % 6], ns[i // 6 % 3], fs[i // 18 % 4]) for i in range(720)]
    df = spark.createDataFrame(rows, "id long, x double, n long, f string").repartition(3)
    want = {r["id"]: r["out"] for r in t.render(df).collect()}
    assert len(set(want.values())) == 54, "a and A read alike here, the zeros do not"
    got = t.render_distinct(df)
    assert got.columns == ["id", "x", "n", "f", "out"]
    shown = got.collect()
    assert len(shown) == 720 and {r["id"]: r["out"] for r in shown} == want
    sized = t.render_distinct(df, {"size": F.length("out")})
    assert {(r["id"], r["size"]) for r in sized.select("id", "size").collect()} == {(i, len(x)) for i, x in want.items()}
    plan = sized._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project", plan.index("AS size")) < plan.index("Aggregate"), "texts are made above the distinct sets"
    with pytest.raises(Exception, match="type mismatch for 'x'"):
        t.render_distinct(df.withColumn("x", F.when(F.col("id") != 7, F.col("x")))).collect()
    with pytest.raises(errors.ExtraParams):
        t.render_distinct(df, allow_extra=False)
    lists = Template(body(["xs = list(float)"], "> {% for x in xs %}{{ x | fixed(1) }};{% /for %}"))
    many = spark.createDataFrame([([0.0, -0.0],), ([-0.0, 0.0],), ([],)], "xs array<double>").coalesce(1)
    assert [r["out"] for r in lists.render_distinct(many).collect()] == [r["out"] for r in lists.render(many).collect()]


HOSTILE = [f"a\x01\x02\x01panic\x01boo\x01\x03\x01b", *map(chr, range(0x20)), "\x7f\x85\u2028\ufeff", "panic", "error: template panic: x", "\x01\x03\x01"]


@pytest.mark.parametrize("engine", ["catalyst", "python"])
def test_errors_cannot_be_forged(spark, engine):
    t = Template(body(["name = str", "xs = list(str)", "go = bool"], "{{ name }}|\n\n> {% for x in xs %}{{ x }}{% if go %}{% panic(\"no {{ x }}{{ name }}\") %}{% /if %}{% /for %}"))
    rows = [(n, [n, "y"], go) for n in HOSTILE for go in (False, True)] + [("z", [], True)]
    df = spark.createDataFrame(rows, "name string, xs array<string>, go boolean").coalesce(1)
    for (name, xs, go), r in zip(rows, t.render_try(df, engine=engine).collect()):
        if go and xs:
            assert (r["out"], r["error_kind"], r["error"]) == (None, "panic", f"template panic: no {name}{name}")
        else:
            assert (r["out"], r["error_kind"], r["error"]) == (t.render_dict({"name": name, "xs": xs, "go": go}), None, None)


def test_the_first_stop_is_told(spark):
    """In conditions, messages, loops and what follows, in the order of the text."""
    source = body(["a = int", "xs = list(int)"], "> {% for x in xs %}{% if x > a %}{% panic(\"big {{ x }}\") %}{% elif x == 0 %}{% panic(\"zero\") %}{% /if %}{{ x }}{% else %}{% panic(\"none\") %}{% /for %}\n\n> {% if a > 5 && a < 8 %}{% panic(\"late\") %}{% /if %}")
    t = Template(source)
    rows = [(a, xs) for a in (1, 6, 9) for xs in ([], [1], [0, 7], [7, 0], [1, 1, 8])]
    got = t.render_try(spark.createDataFrame(rows, "a long, xs array<long>").coalesce(1)).collect()
    for (a, xs), r in zip(rows, got):
        try:
            want = (t.render_dict({"a": a, "xs": xs}), None)
        except errors.TemplateError as e:
            want = (None, str(e))
        assert (r["out"], r["error"]) == want


def test_templates_by_row(spark):
    """A row names its template; the parameters of all are checked once, an unknown name is the row's error."""
    own = {f"t{i}": Template(body(["x = str", "n = int := 3"], f"<{i} {{{{ x | upper }}}} {{{{ n }}}}" + (" {% panic(\"never {{ x }}\") %}" if i == 7 else "") + ">")) for i in range(60)}
    t = Template(body(["w = tmpl(x = str)", "xs = list(str)", "s = str"], "{% include w with x=s %}\n\n> {% for y in xs %}{% include w with x=y %};{% /for %}".replace("{%", "> {%", 1))).bind(w=own)
    assert [f.name for f in t.schema().fields] == ["xs", "s", "w"]
    rows = [(f"t{i % 62}" if i != 5 else None, ["a", "b"][: i % 3], f"s{i}") for i in range(130)]
    df = spark.createDataFrame(rows, "w string, xs array<string>, s string").coalesce(1)
    shown = t.render_try(df)
    assert "Python" not in shown._jdf.queryExecution().executedPlan().toString()
    kinds = set()
    for (w, xs, s), r in zip(rows, shown.collect()):
        if w is None:
            assert r["error_kind"] == "type_mismatch" and "'w'" in r["error"]
            continue
        assert (r["out"], r["error_kind"]) == expected(t, {"w": w, "xs": xs, "s": s})
        kinds.add(r["error_kind"])
    assert kinds == {None, "panic", "include_not_found"}
    good = df.where("w not in ('t7', 't60', 't61')")
    assert all(r["out"] == t.render_dict({"w": r["w"], "xs": r["xs"], "s": r["s"]}) for r in t.render(good).collect())
    with pytest.raises(errors.TemplateSyntaxError, match="does not match"):
        t.bind(w=own | {"bad": Template(body(["x = int"], "{{ x }}"))})


def test_paths_among_many_files(spark, tmp_path):
    for i in range(1200):
        (tmp_path / f"f{i}.tmpl.md").write_text(body(["n = str"], f"{i}: {{{{ n }}}}"))
    t = Template(body(["n = str", "k = str"], "> {% include [f](./f{{ k }}.tmpl.md) with n=n %}"), base_dir=str(tmp_path))
    rows = [(f"x{i}", str(i * 37 % 1300)) for i in range(200)]
    shown = t.render_try(spark.createDataFrame(rows, "n string, k string").coalesce(1))
    assert "Python" not in shown._jdf.queryExecution().executedPlan().toString()
    for (n, k), r in zip(rows, shown.collect()):
        assert (r["out"], r["error_kind"]) == ((f"{k}: {n}", None) if int(k) < 1200 else (None, "include_not_found"))


@pytest.mark.parametrize("separator,size", [("", 1 << 20), ("--é", 40), ("", 1), ("\n", 1000)])
def test_document_in_parts(spark, separator, size):
    """Parts join to the rows' texts in order, and are the same however the rows are dealt."""
    rng = __import__("random").Random(size)
    rows = [(rng.choice([None, *range(30)]), rng.choice("ab"), rng.choice(["", "é", "x" * rng.randrange(60)])) for _ in range(400)] + [(7, "a", "same")] * 300
    t = Template(body(["s = str"], "<{{ s }}>"))
    want = [f"<{s}>" for _, _, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], f"{separator}<{r[2]}>".encode()))]
    found = []
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows, "k int, c string, s string").repartition(n)
        got = t.document_parts(df, ["k", "c"], separator, size).sort("part").collect()
        assert separator.join(want) == "".join(r["text"] for r in got)
        assert [r["start"] for r in got] == [sum(x["bytes"] for x in got[:i]) for i in range(len(got))]
        assert all(r["bytes"] == len(r["text"].encode()) and r["part"] == r["start"] // size for r in got)
        found.append([tuple(r) for r in got])
    assert found[0] == found[1] == found[2]
    assert t.document(df.limit(0), ["k"]).first()["out"] == ""
    assert t.document(df, ["k", "c"], separator).first()["out"] == separator.join(want)


COLUMNAR = body(
    ["name = str", "f = float", "parts = list(h = str, o = option(int), rows = list(n = str, on = bool, x = float, k = K, marks = list(str), m = int))"],
    "# {{ name | upper }} {{ f | fixed(2) }}\n\n> {% for p in parts %}\n\n## {{ idx(p) }} {{ p.h | trim }}{% match p.o %}{% case Some %} o{{ p.o }}{% case None %} no{% /match %}\n\n"
    "> {% for r in p.rows %}\n\n- {{ idx(p) }}.{{ idx(r) }} {{ r.n | lower }} {{ r.x }} {{ r.m | add(9223372036854775000) }} {{ kind(r.k) }} {{ r.marks | limit(2) | join(\"+\") }} of {{ name }}\n\n"
    "> {% if r.on && r.x > 1 || !(r.m >= 2) %}\n\nyes {{ r.x | fixed(1) }}\n\n> {% elif r.n == p.h %}\n\nsame\n\n> {% elif r.m > 7 %}\n\n{% panic(\"seven {{ r.n }}\") %}\n\n> {% else %}\n\nno {{ len(r.marks) }}\n\n> {% /if %}\n"
    "> {% for t in r.marks %}\n\n  * {{ t }}/{{ p.h }}\n\n> {% else %}\n\nbare\n\n> {% /for %}\n> {% else %}\n\nempty {{ name }}\n\n> {% /for %}\n> {% else %}\n\nnothing\n\n> {% /for %}\n",
    "types:\n  - K = enum(A, B)\n\n",
)


def test_loops_by_columns(spark):
    """Nested loops in Arrow batches against single records: lists of every length, stops, nulls, text beyond ASCII."""
    from inkfall.operators import columnar

    rng = __import__("random").Random(6)
    t = Template(COLUMNAR.replace("\n{% panic", "\n> {% panic"))
    assert columnar.nested(t.tree) and columnar.supported(t.tree) and t.engine() == "python"
    word = lambda: rng.choice(["", "a", " b ", "Straße", "ΑΣ", "x\x1cy", "long word"])
    row = lambda: {"n": word(), "on": rng.random() < 0.5, "x": rng.choice([0.0, 1.5, -0.0, 1e300, 0.125, float("nan")]), "k": rng.choice("AB"), "marks": [word() for _ in range(rng.randrange(4))], "m": rng.choice([0, 1, 2, 5, 2**62, 8])}
    part = lambda: {"h": word(), "o": rng.choice([None, 3]), "rows": [row() for _ in range(rng.randrange(4))]}
    records = [{"name": word(), "f": rng.random(), "parts": [part() for _ in range(rng.randrange(4))]} for _ in range(300)]
    df = t.frame(spark, records).withColumn("name", F.when(F.col("f") > 0.05, F.col("name"))).coalesce(1)
    kinds = set()
    for r, record in zip(t.render_try(df).collect(), records):
        want = (None, "type_mismatch") if record["f"] <= 0.05 else expected(t, record)
        assert (r["out"], r["error_kind"]) == want
        kinds.add(r["error_kind"])
    assert kinds == {None, "panic", "type_mismatch"}
    asked = __import__("pyarrow").array([{"name": r["name"], "f": r["f"], "parts": r["parts"]} for r in records])
    texts, stopped = columnar.render(t.tree, asked)
    assert [expected(t, r)[1] == "panic" for r in records] == stopped.tolist()
    assert all(s or x.as_py() == expected(t, r)[0] for x, s, r in zip(texts, stopped, records))


def test_cbor_by_batches(spark):
    """The batch decoder against the one for single records: it gives the same values, or leaves the record to it."""
    import pyarrow as pa

    from inkfall.plans.types import FLOAT, INT, STR
    from inkfall.sources import binary, cbor_batches

    rng = __import__("random").Random(12)
    t = Template(body(["n = int := 3", "s = str", "f = float", "o = option(struct(m = list(list(int)), t = str))", "ks = list(K)", "rows = list(a = str, b = bool, o = option(int))"], "{{ n }}{{ s }}{{ f }}{% match o case Some %}{{ len(o.m) }}{{ o.t }}{% /match %}{{ ks | join(\",\") }}\n\n> {% for r in rows %}{{ r.a }}{{ r.b }};{% /for %}", "types:\n  - K = enum(A, B)\n\n") + "{# {{ n }} #}")
    word = lambda: rng.choice(["", "a", "é" * 30, "x" * 300])
    number = lambda: rng.choice([0, -1, 23, 24, 255, 256, -70000, 2**40, -(2**63), 2**63 - 1])

    def record():
        got = {"n": number(), "s": word(), "f": rng.choice([1.5, -0.25, 3, 1e300]), "o": rng.choice([None, {"m": [[number()] * rng.randrange(3)] * rng.randrange(3), "t": word(), "more": rng.choice(["t", None, 5, 2.5])}]), "ks": [rng.choice("AB") for _ in range(rng.randrange(30))], "rows": [{"b": rng.random() < 0.5, "a": word(), "o": rng.choice([None, 7])} for _ in range(rng.randrange(4))]}
        return {k: got[k] for k in rng.sample(list(got), len(got)) if k != "n" or rng.random() < 0.7}

    good = [record() for _ in range(400)]
    kinds = {d.name: d.type for d in t._columns()}
    data = [cbor_bytes(r) for r in good]
    arrays, there, odd = cbor_batches.decoded(pa.array(data, pa.binary()), kinds, {"n"}, False)
    assert not odd.any()
    shape = lambda k, v: None if v is None else {n: shape(x, v.get(n)) for n, x in k.fields} if hasattr(k, "fields") else [shape(k.item, x) for x in v] if hasattr(k, "item") else shape(k.inner, v) if hasattr(k, "inner") else float(v) if k == FLOAT else v
    for name, values, has in zip(kinds, arrays, there):
        assert has.tolist() == [name in r for r in good]
        assert values.to_pylist() == [shape(kinds[name], r[name]) if name in r else None for r in good]
    # Whatever is done to the bytes, both decoders agree, or the record is left to the other one.
    broken = []
    for _ in range(3000):
        b = bytearray(rng.choice(data[:60]))
        for _ in range(rng.randrange(1, 3)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append(bytes(b[: rng.randrange(len(b) + 1)] if rng.random() < 0.3 else b))
    for flat in ({"s": STR, "n": INT}, kinds):
        for b in broken:
            try:
                arrays, there, odd = cbor_batches.decoded(pa.array([b], pa.binary()), flat, set(flat), True)
            except pa.ArrowException:
                continue
            if odd[0]:
                continue
            want = binary.cbor(b)
            for name, values, has in zip(flat, arrays, there):
                assert has[0] == (name in want) and (not has[0] or str(values[0].as_py()) == str(shape(flat[name], want[name])))
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data[:100] + broken[:300])], "id long, cbor binary").coalesce(1)
    from pyspark.sql import functions as F

    plain = df.withColumn("json", binary.json_text(F.col("cbor"), binary.cbor))
    one = t.render_cbor(df, catch=True).select("id", "out", "error_kind", "error").orderBy("id").collect()
    assert one == t.render_json(plain, catch=True).select("id", "out", "error_kind", "error").orderBy("id").collect()
    assert [r["out"] for r in one[:100]] == [t.render_dict(r if r["o"] is None else r | {"o": {k: v for k, v in r["o"].items() if k != "more"}}) for r in good[:100]]
