"""More queries: records in other encodings, faults in rows, documents of orders, and what compiling and
loading templates gives (as rows of a table)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .sources import TemplateCatalog, template_folder
from .template import Template

Query = Callable[[SparkSession, str], DataFrame]


def _source(params: list[str], body: str, more: str = "") -> str:
    declared = "params:\n" + "".join(f"  - {p}\n" for p in params) if params else "params: []\n"
    return f"---\n{more}{declared}\n---\n{body}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return add


def _values(rows: list[tuple], columns: str) -> str:
    def literal(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    listed = ",\n  ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n  {listed}\n) t({columns})"


# --- records ----------------------------------------------------------------

CUSTOMER = _source(["k = int", "s = str", "n = int := 3"], "{{ k }}:{{ s }}:{{ n }}")
CUSTOMER_SQL = "SELECT c_custkey, c_custkey || ':' || c_name || ':3' AS out FROM customer"


def _bytes(*parts: str) -> str:
    return f"unhex(concat({', '.join(parts)}))"


@_query("q_cbor", CUSTOMER_SQL)
def _(spark, sf_dir):
    """A map of two: k is an unsigned of eight bytes, s a text with its length in one byte."""
    number = "'A2616B1B', lpad(hex(c_custkey), 16, '0')"
    text = "'617378', lpad(hex(octet_length(c_name)), 2, '0'), hex(c_name)"
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_bytes(number, text)).alias("cbor"))
    return Template(CUSTOMER).render_cbor(df).select("c_custkey", "out")


CBOR_LINES_SQL = """
SELECT l_orderkey, l_linenumber, l_orderkey || ' ' || l_returnflag || ' [' || (l_quantity::bigint) || ',' || l_linenumber || '] 7 ' ||
  CASE WHEN l_linenumber % 2 = 0 THEN 'odd' ELSE l_linestatus END AS out
FROM lineitem
"""


@_query("q_cbor_lines", CBOR_LINES_SQL)
def _(spark, sf_dir):
    """A map of four with a list of numbers and an optional record in it, for each line; what is absent has its default."""
    eight = lambda e: f"'1B', lpad(hex(cast({e} as bigint)), 16, '0')"
    short = lambda e: f"'61', hex({e})"
    some = f"concat('A16173', {short('l_linestatus')})"
    parts = ["'A4616B'", eight("l_orderkey"), "'6166'", short("l_returnflag"), "'627873', '82'", eight("l_quantity"), eight("l_linenumber"), "'616F'", f"if(l_linenumber % 2 = 0, 'F6', {some})"]
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_bytes(*parts)).alias("cbor"))
    body = "{{ k }} {{ f }} [{{ xs | join(\",\") }}] {{ n }} {% match o %}{% case Some %}{{ o.s }}{% case None %}odd{% /match %}"
    t = Template(_source(["k = int", "f = str", "xs = list(int)", "n = int := 7", "o = option(struct(s = str))"], body))
    return t.render_cbor(df).select("l_orderkey", "l_linenumber", "out")


@_query("q_flexbuffers", CUSTOMER_SQL)
def _(spark, sf_dir):
    """Keys, the text, a vector of key offsets, then a map of eight-byte values: k in place, s by its offset."""

    def eight(e: str) -> str:  # little-endian
        return ", ".join(f"lpad(hex(shiftright({e}, {8 * i}) & 255), 2, '0')" for i in range(8))

    size = "octet_length(c_name)"  # the text's bytes begin at 5, its end is at 5 + size
    keys = "'6B007300'"
    text = f"lpad(hex({size}), 2, '0'), hex(c_name), '00'"
    offsets = f"'02', lpad(hex({size} + 7), 2, '0'), lpad(hex({size} + 6), 2, '0')"
    head = f"{eight('2L')}, {eight('1L')}, {eight('2L')}"  # back to the keys, their width, the number of values
    values = f"{eight('cast(c_custkey as bigint)')}, {eight(f'cast({size} + 36 as bigint)')}, '0714', '122701'"
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_bytes(keys, text, offsets, head, values)).alias("buffers"))
    return Template(CUSTOMER).render_flexbuffers(df).select("c_custkey", "out")


JSON_SQL = """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN event_id || ' d 1.5' WHEN 1 THEN event_id || ' ' || event_type || ' 2' END AS out,
  CASE event_id % 6 WHEN 2 THEN 'type_mismatch' WHEN 3 THEN 'missing_params' WHEN 4 THEN 'extra_params'
    WHEN 5 THEN 'invalid_record' END AS error_kind,
  CASE event_id % 6 WHEN 2 THEN 'type mismatch: ''t'': expected str, got int (7)'
    WHEN 3 THEN 'missing required parameters: id' WHEN 4 THEN 'extra undeclared parameters: more'
    WHEN 5 THEN 'invalid record: not JSON' END AS error
FROM events
"""


@_query("q_json_defaults", JSON_SQL)
def _(spark, sf_dir):
    """Absent keys have defaults; wrong kinds, missing and other keys, and what is not JSON are told apart."""
    record = F.expr(
        """CASE event_id % 6
             WHEN 0 THEN concat('{"id":', event_id, '}')
             WHEN 1 THEN concat('{"id":', event_id, ',"t":"', event_type, '","f":2}')
             WHEN 2 THEN concat('{"id":', event_id, ',"t":7}')
             WHEN 3 THEN '{"t":"x"}'
             WHEN 4 THEN concat('{"id":', event_id, ',"more":1}')
             ELSE '{bad' END"""
    )
    t = Template(_source(["id = int", "t = str := \"d\"", "f = float := 1.5"], "{{ id }} {{ t }} {{ f }}"))
    df = _table(spark, sf_dir, "events").select("event_id", record.alias("json"))
    return t.render_json(df, catch=True).select("event_id", "out", "error_kind", "error")


OBJECTS_SQL = """
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey || ' ' || lower(n_name) || ' ' || (n_nationkey + 0.5) || ' x,' || n_regionkey || ' Done ' || n_name
  ELSE n_nationkey || ' ' || lower(n_name) || ' 0  Open' END AS out
FROM nation
"""


@_query("q_objects", OBJECTS_SQL)
def _(spark, sf_dir):
    """Records of the host language, one for each nation: lists, structs and variants."""
    kinds = "types:\n  - S = enum(Open, Done(by = str))\n\n"
    body = "{{ id }} {{ u.n | lower }} {{ f }} {{ xs | join(\",\") }} {{ kind(s) }}{% match s case Done %} {{ s.by }}{% /match %}"
    t = Template(_source(["id = int", "u = struct(n = str)", "f = float", "xs = list(str)", "s = S"], body, kinds))

    def record(key: int, name: str, region: int) -> dict:
        even = {"f": key + 0.5, "xs": ["x", str(region)], "s": {"__kind__": "Done", "by": name}}
        return {"id": key, "u": {"n": name}} | (even if key % 2 == 0 else {"f": 0, "xs": [], "s": {"__kind__": "Open"}})

    df = t.frame(spark, [record(*r) for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return df.select("id", t.column(df).alias("out"))


# --- faults in rows ---------------------------------------------------------

def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").cast("long").alias("no"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


NULL_SQL = """
SELECT l_orderkey,
  CASE WHEN list_position(bad, true) IS NULL THEN array_to_string(items, '') END AS out,
  CASE WHEN list_position(bad, true) IS NOT NULL THEN 'type_mismatch' END AS error_kind,
  CASE WHEN list_position(bad, true) IS NOT NULL
    THEN 'type mismatch: ''lines[' || (list_position(bad, true) - 1) || '].q'': expected int, got none ()' END AS error
FROM (SELECT l_orderkey, list(l_quantity > 48 ORDER BY l_linenumber, l_quantity, l_returnflag) AS bad,
    list(l_linenumber || 'x' || l_quantity::bigint || ';' ORDER BY l_linenumber, l_quantity, l_returnflag) AS items
  FROM lineitem GROUP BY 1)
"""


@_query("q_null_in_list", NULL_SQL)
def _(spark, sf_dir):
    """A null field of an element is told with the element's index."""
    t = Template(_source(["lines = list(no = int, q = int)"], "> {% for l in lines %}{{ l.no }}x{{ l.q }};{% /for %}"))
    known = F.transform("lines", lambda x: F.struct(x["no"].alias("no"), F.when(x["q"] <= 48, x["q"].cast("long")).alias("q")))
    df = _orders(spark, sf_dir).select("l_orderkey", known.alias("lines"))
    return t.render_try(df).select("l_orderkey", "out", "error_kind", "error")


VARIANT_SQL = """
SELECT l_orderkey,
  CASE WHEN list_position(bad, true) IS NULL THEN array_to_string(items, '') END AS out,
  CASE WHEN list_position(bad, true) IS NOT NULL THEN 'type_mismatch' END AS error_kind,
  CASE WHEN list_position(bad, true) IS NOT NULL
    THEN 'type mismatch: ''flags[' || (list_position(bad, true) - 1) || ']'': expected enum(A, N), got str (R)' END AS error
FROM (SELECT l_orderkey, list(l_returnflag = 'R' ORDER BY l_linenumber, l_quantity, l_returnflag) AS bad,
    list(l_returnflag || ';' ORDER BY l_linenumber, l_quantity, l_returnflag) AS items
  FROM lineitem GROUP BY 1)
"""


@_query("q_bad_variant", VARIANT_SQL)
def _(spark, sf_dir):
    """A text in a list of an enum that is none of its variants."""
    t = Template(_source(["flags = list(Flag)"], "> {% for f in flags %}{{ f }};{% /for %}", "types:\n  - Flag = enum(A, N)\n\n"))
    df = _orders(spark, sf_dir).select("l_orderkey", F.col("lines.flag").alias("flags"))
    return t.render_try(df).select("l_orderkey", "out", "error_kind", "error")


PAYLOAD_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ' ' || o_custkey END AS out,
  CASE WHEN o_orderstatus = 'P' THEN 'type_mismatch' END AS error_kind,
  CASE WHEN o_orderstatus = 'P' THEN 'type mismatch: ''s.who'': expected int, got none ()' END AS error
FROM orders
"""


@_query("q_null_payload", PAYLOAD_SQL)
def _(spark, sf_dir):
    """A null in the fields of the variant that a row has; the other variants' fields may be null."""
    t = Template(
        _source(
            ["s = enum(F(who = int), O(who = int), P(who = int))"],
            "{{ kind(s) }} {% match s %}{% case F %}{{ s.who }}{% case O %}{{ s.who }}{% case P %}{{ s.who }}{% /match %}",
        )
    )
    who = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("long"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("__kind__"), who.alias("who")).alias("s"))
    return t.render_try(df).select("o_orderkey", "out", "error_kind", "error")


PANIC_SQL = """
SELECT o_orderkey, CASE WHEN o_totalprice <= 200000 THEN 'ok' END AS out,
  CASE WHEN o_totalprice > 200000 THEN 'panic' END AS error_kind,
  CASE WHEN o_totalprice > 200000 THEN 'template panic: order ' || o_orderkey || ' is too large' END AS error
FROM orders
"""


@_query("q_panic_rows", PANIC_SQL)
def _(spark, sf_dir):
    t = Template(_source(["k = int", "p = float"], "> {% if p > 200000 %}{% panic(\"order {{ k }} is too large\") %}{% /if %}ok"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return t.render_try(df).select("o_orderkey", "out", "error_kind", "error")


# --- documents of orders ----------------------------------------------------

_DIGITS = "(l_quantity::bigint)::varchar"


@_query(
    "q_order_loop",
    f"""SELECT l_orderkey, 'lines ' || count(*) || chr(10) || string_agg('- ' || i || '. line ' || l_linenumber || ': ' || {_DIGITS}
      || CASE WHEN l_quantity > 25 THEN ' (bulk)' ELSE '' END || chr(10), '' ORDER BY i) AS out
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem)
    GROUP BY 1""",
)
def _(spark, sf_dir):
    body = "lines {{ len(lines) }}\n\n> {% for l in lines %}\n\n- {{ idx(l) }}. line {{ l.no }}: {{ l.q }}{% if l.q > 25 %} (bulk){% /if %}\n\n> {% /for %}\n"
    df = _orders(spark, sf_dir)
    return df.select("l_orderkey", Template(_source(["lines = list(no = int, q = float)"], body)).column(df).alias("out"))


@_query(
    "q_order_include",
    """SELECT l_orderkey, string_agg('[' || i || '|' || lower(l_returnflag) || '|eu]' || chr(10), '' ORDER BY i) AS out
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem)
    GROUP BY 1""",
)
def _(spark, sf_dir):
    """An inline template for each line; it sees the environment of its file."""
    row = "> {% tmpl row %}\n---\nparams: [line = struct(flag = str)]\n---\n[{{ idx(line) }}|{{ line.flag | lower }}|{{ ZONE }}]\n\n> {% /tmpl %}\n\n"
    t = Template(_source(["lines = list(flag = str)"], row + "> {% include row for line in lines %}", "env:\n  - ZONE = str\n\n"), env={"ZONE": "eu"})
    df = _orders(spark, sf_dir)
    return df.select("l_orderkey", t.column(df).alias("out"))


@_query("q_include_env", "SELECT n_nationkey, 'us/' || n_name || '/us' AS out FROM nation")
def _(spark, sf_dir):
    """An included file reads the environment that its includer was compiled with."""
    t = Template(_source(["n = str"], "{{ E }}/{% include [zone](./zone.tmpl.md) with n=n %}", "env:\n  - E = str\n\n"), base_dir=_folder(), env={"E": "us"})
    df = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("n"))
    return df.select("n_nationkey", t.column(df).alias("out"))


RECURSION_SQL = """
SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'end' END AS out,
  CASE WHEN r_regionkey % 2 = 1 THEN 'syntax' END AS error_kind,
  CASE WHEN r_regionkey % 2 = 1 THEN 'template syntax error: maximum include depth exceeded in ''./loop.tmpl.md''' END AS error
FROM region
"""


@_query("q_recursion", RECURSION_SQL)
def _(spark, sf_dir):
    """A file that includes itself ends where its condition does, or at the depth limit."""
    t = Template(_source(["go = bool"], "> {% include [loop](./loop.tmpl.md) with go=go %}"), base_dir=_folder(), max_include_depth=8)
    df = _table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") % 2 == 1).alias("go"))
    return t.render_try(df).select("r_regionkey", "out", "error_kind", "error")


# --- large templates, templates by row, many files --------------------------

#: A template of 1000 parts, about 10 000 nodes, and the SQL of each part.
_PARTS = 1000


def _large_part(i: int) -> tuple[str, str]:
    q, f, d = "(l_quantity::bigint)", "l_returnflag", "l_discount"
    shown = f"regexp_replace({d}::varchar, '\\.0$', '')"
    kind = i % 4
    if kind == 0:
        return f"r{i} {{{{ f | lower }}}} {{{{ q | add({i}) }}}};", f"'r{i} ' || lower({f}) || ' ' || ({q} + {i}) || ';'"
    if kind == 1:
        text = f"{{% if q > {i % 50} && f == \"A\" %}}a{i}{{% elif d < 0.0{i % 9} %}}b{{{{ d }}}}{{% else %}}c{i}{{% /if %}};"
        return text, f"CASE WHEN {q} > {i % 50} AND {f} = 'A' THEN 'a{i}' WHEN {d} < 0.0{i % 9} THEN 'b' || {shown} ELSE 'c{i}' END || ';'"
    if kind == 2:
        return f"x{i} {{{{ d | fixed(2) }}}};", f"'x{i} ' || printf('%.2f', {d}) || ';'"
    return f"{{% match f %}}{{% case \"A\" | \"N\" %}}{{{{ q | sub({i}) }}}}{{% else %}}r{i}{{% /match %}};", f"CASE WHEN {f} IN ('A', 'N') THEN ({q} - {i})::varchar ELSE 'r{i}' END || ';'"


LARGE_SQL = "SELECT l_orderkey, l_linenumber, length(t)::int AS size, md5(t) AS digest FROM (SELECT l_orderkey, l_linenumber, concat('parts: ', {}) AS t FROM lineitem)"


@_query("q_large_template", LARGE_SQL.format(", ".join(_large_part(i)[1] for i in range(_PARTS))))
def _(spark, sf_dir):
    """A text of 1000 parts for each line, by several projections of generated code, once for lines of equal parameters."""
    t = Template(_source(["q = int", "d = float", "f = str"], "parts: " + "".join(_large_part(i)[0] for i in range(_PARTS))))
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("f"))
    made = {"size": F.length("out"), "digest": F.md5(F.col("out").cast("binary"))}
    return t.render_distinct(df, made).select("l_orderkey", "l_linenumber", *made)


BY_ROW_SQL = """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN '[' || k || '] ' || upper(c_name) WHEN c_nationkey % 3 = 1 THEN k || ': ' || c_name || ' in ' || lower(c_mktsegment)
  ELSE CASE WHEN c_acctbal > 5000 THEN 'rich ' || k ELSE c_name || '/' || k END END AS out
FROM (SELECT *, c_nationkey || CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'good' END AS k FROM customer)
"""


@_query("q_template_by_row", BY_ROW_SQL)
def _(spark, sf_dir):
    """Each customer names one of 50 templates, by nation and balance."""

    def own(nation: int, k: str) -> Template:
        bodies = (f"[{k}] {{{{ n | upper }}}}", f"{k}: {{{{ n }}}} in {{{{ s | lower }}}}", f"> {{% if b > 5000 %}}rich {k}{{% else %}}{{{{ n }}}}/{k}{{% /if %}}")
        return Template(_source(["n = str", "s = str", "b = float"], bodies[nation % 3] + "{# {{ n }} {{ s }} {{ b }} #}"))

    t = Template(_source(["page = tmpl(n = str, s = str, b = float)", "n = str", "s = str", "b = float"], "> {% include page with n=n, s=s, b=b %}"))
    t = t.bind(page={f"{n}{k}": own(n, f"{n}{k}") for n in range(25) for k in ("debt", "good")})
    page = F.concat(F.col("c_nationkey").cast("string"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("good"))
    df = _table(spark, sf_dir, "customer").select("c_custkey", page.alias("page"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("s"), F.col("c_acctbal").alias("b"))
    return t.render(df).select("c_custkey", "out")


FILES_SQL = """
SELECT o_orderkey, CASE WHEN o_custkey % 211 < 200 THEN 'file ' || (o_custkey % 211 * 25) || ' of ' || o_orderstatus END AS out,
  CASE WHEN o_custkey % 211 >= 200 THEN 'include_not_found' END AS error_kind,
  CASE WHEN o_custkey % 211 >= 200 THEN 'include not found: ./f' || (o_custkey % 211 * 25) || '.tmpl.md' END AS error
FROM orders
"""


@functools.cache
def _many_files() -> str:
    return template_folder({f"f{i}": _source(["s = str"], f"file {i} of {{{{ s }}}}") for i in range(5000)})


@_query("q_include_files", FILES_SQL)
def _(spark, sf_dir):
    """A path that depends on the row, among 5000 files."""
    t = Template(_source(["k = int", "s = str"], "> {% include [f](./f{{ k }}.tmpl.md) with s=s %}"), base_dir=_many_files())
    df = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 211 * 25).cast("long").alias("k"), F.col("o_orderstatus").alias("s"))
    return t.render_try(df).select("o_orderkey", "out", "error_kind", "error")


HOSTILE_SQL = """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN name || ' ok' END AS out, CASE WHEN c_acctbal < 0 THEN 'panic' END AS error_kind,
  CASE WHEN c_acctbal < 0 THEN 'template panic: debt of ' || name END AS error
FROM (SELECT *, chr(1) || chr(2) || chr(1) || 'panic' || chr(1) || c_name || chr(1) || chr(3) || chr(1) || chr(1 + (c_custkey % 31)::int) AS name FROM customer)
"""


@_query("q_render_try_hostile", HOSTILE_SQL)
def _(spark, sf_dir):
    """Names of control characters neither look like errors nor hide them."""
    t = Template(_source(["name = str", "b = float"], "{{ name }} {% if b < 0 %}{% panic(\"debt of {{ name }}\") %}{% /if %}ok"))
    c = lambda n: F.lit(chr(n))
    name = F.concat(c(1), c(2), c(1), F.lit("panic"), c(1), F.col("c_name"), c(1), c(3), c(1), F.char((1 + F.col("c_custkey") % 31).cast("long")))
    df = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.col("c_acctbal").alias("b"))
    return t.render_try(df).select("c_custkey", "out", "error_kind", "error")


NESTED_SQL = f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem),
o AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
    CASE WHEN o_totalprice > 150000 THEN '!' ELSE '' END AS mark
  FROM orders
),
t AS (
  SELECT o.o_custkey, o.i, o.mark, o.o_orderkey, coalesce(string_agg('(' || o.i || '.' || l.i || ' ' || lower(l_returnflag) || {_DIGITS} ||
    CASE WHEN l_quantity > 25 THEN '+' ELSE '' END || ')', '' ORDER BY l.i), 'empty') AS lines
  FROM o LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4
)
SELECT c_custkey, c_name || ':' || coalesce(string_agg(' ' || t.o_orderkey || mark || '=' || lines, '' ORDER BY t.i), ' no orders') AS out
FROM customer LEFT JOIN t ON o_custkey = c_custkey GROUP BY c_custkey, c_name
"""


@_query("q_customer_orders", NESTED_SQL)
def _(spark, sf_dir):
    """Three levels: each customer's orders, their lines, with indexes of both loops and what stands where a list is empty."""
    none = F.array().cast("array<struct<no:bigint,q:double,flag:string>>")
    orders = _table(spark, sf_dir, "orders").join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    order = F.struct(F.col("o_orderkey").cast("long").alias("key"), (F.col("o_totalprice") > 150000).alias("big"), F.coalesce("lines", none).alias("lines"))
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(order), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("orders"))
    df = _table(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    empty = F.array().cast("array<struct<key:bigint,big:boolean,lines:array<struct<no:bigint,q:double,flag:string>>>>")
    df = df.select("c_custkey", F.col("c_name").alias("name"), F.coalesce("orders", empty).alias("orders"))
    line = "{% for l in o.lines %}({{ idx(o) }}.{{ idx(l) }} {{ l.flag | lower }}{{ l.q }}{% if l.q > 25 %}+{% /if %}){% else %}empty{% /for %}"
    body = "{{ name }}:{% for o in orders %} {{ o.key }}{% if o.big %}!{% /if %}=" + line + "{% else %} no orders{% /for %}"
    t = Template(_source(["name = str", "orders = list(key = int, big = bool, lines = list(no = int, q = float, flag = str))"], body))
    return t.render(df).select("c_custkey", "out")


PARTS_SQL = """
SELECT (begin // 65536)::bigint AS part, min(begin)::bigint AS start, sum(strlen(t))::bigint AS bytes, md5(string_agg(t, '' ORDER BY begin)) AS digest
FROM (SELECT t, coalesce(sum(strlen(t)) OVER (ORDER BY l_orderkey, l_linenumber, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM (SELECT l_orderkey, l_linenumber, '- ' || l_orderkey || '.' || l_linenumber || ' ' || l_returnflag || ' ' || (l_quantity::bigint) || chr(10) AS t FROM lineitem))
GROUP BY 1
"""


@_query("q_document_parts", PARTS_SQL)
def _(spark, sf_dir):
    """One document of all lines, in parts of 64 KB."""
    t = Template(_source(["k = int", "n = int", "f = str", "q = int"], "- {{ k }}.{{ n }} {{ f }} {{ q }}\n"))
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("long").alias("q"))
    return t.document_parts(df, ["k", "n"], size=1 << 16).select("part", "start", "bytes", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- compiling and loading --------------------------------------------------

#: Template files of these queries.
_FILES = {
    "zone": "---\nenv:\n  - E = str\n\nparams: [n = str]\n---\n{{ n }}/{{ E }}",
    "loop": "---\nparams: [go = bool]\n---\n> {% if go %}{% include [loop](./loop.tmpl.md) with go=go %}{% else %}end{% /if %}",
    "broken": "---\nparams: [n = str]\n---\n\nline {{ n | nope }}",
}


@functools.cache
def _folder() -> str:
    return template_folder(_FILES)


_STAGE = "types:\n  - Stage = enum(Plan, Make, Ship)\n\n"

#: Faulty sources by name: source, and what compiling tells of it: kind, line, message.
FAULTS: dict[str, tuple[str, str, int | None, str]] = {
    "name taken twice": (_source(["X = int"], "{{ X }}", "consts:\n  - X = int := 1\n\n"), "syntax", None, "conflicts"),
    "undeclared, with a hint": (_source(["name = str"], "{{ name }}\n{{ nam }}"), "syntax", 7, "undeclared variable 'nam': did you mean 'name'"),
    "unused parameter": (_source(["x = str"], "no"), "syntax", None, "unused"),
    "none leaks": (_source(["o = option(struct(v = str))"], "> {% if !has(o) %}{{ o.v }}{% /if %}"), "syntax", 6, "None here"),
    "missing field": (_source(["u = struct(a = int)"], "a\n\n{{ u.b }}"), "syntax", 8, "available fields: a"),
    "list displayed": (_source(["x = list(int)"], "{{ x }}"), "syntax", 6, "cannot render"),
    "match not exhaustive": (_source(["s = Stage"], "> {% match s %}{% case Plan %}1{% /match %}", _STAGE), "syntax", 9, "{% case Make | Ship %}"),
    "label of another type": (_source(["n = int"], "> {% match n %}{% case \"4\" %}1{% else %}2{% /match %}"), "syntax", 6, "cannot match int"),
    "include lacks an argument": (_source([], "{% include [zone](./zone.tmpl.md) %}".replace("{%", "> {%", 1)), "syntax", 5, "missing required parameters: n"),
    "include's own fault": (_source(["n = str"], "> {% include [broken](./broken.tmpl.md) with n=n %}"), "unknown_filter", 5, "unknown filter: nope"),
    "include not found": (_source([], "> {% include [no](./no.tmpl.md) %}"), "include_not_found", None, "./no.tmpl.md"),
    "key of the engine": (_source(["u = struct(a = int)"], "{{ u.__kind__ }}"), "syntax", 6, "__kind__"),
    "no spaces in a tag": (_source(["x = bool"], "> {%if x %}1{% /if %}"), "syntax", 6, "must have spaces around the content"),
    "bare tag": (_source(["x = bool"], "{{ x }}\n{% if x %}1{% /if %}"), "syntax", 7, "bare statement tag"),
}


@_query("q_compile_faults", f"SELECT n_nationkey, f.* FROM nation, ({_values([(n, kind, line, 'yes') for n, (_, kind, line, _) in FAULTS.items()], 'name, error_kind, line, told')}) f")
def _(spark, sf_dir):
    """What each faulty source gives, with every nation's name in a comment: the kind of error, its line, and whether the message says what it must."""
    rows = []
    for key, nation in _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        for name, (source, _, _, words) in FAULTS.items():
            try:
                Template(f"{source}\n\n> {{# {nation} #}}\n", base_dir=_folder(), env={"E": "e"})
                rows.append((key, name, None, None, "no"))
            except errors.TemplateError as e:
                rows.append((key, name, e.kind, getattr(e, "line", None), "yes" if words in str(e) else str(e)))
    return spark.createDataFrame(rows, "n_nationkey int, name string, error_kind string, line int, told string")


def _caught(run: Callable[[], object]) -> str:
    try:
        return str(run())
    except errors.TemplateError as e:
        return f"{e.kind}: {e}"


def _cached_includes() -> str:
    """One include file, compiled once for each environment."""
    catalog = TemplateCatalog(_folder(), env={"E": "a"})
    first, again = catalog.load("zone"), catalog.load("zone")
    counts = [catalog.template_count]
    other = TemplateCatalog(_folder(), env={"E": "b"}).load("zone")
    return f"{first is again} {counts[0]} {first.render_dict({'n': 'x'})} {other.render_dict({'n': 'x'})}"


def _changed_declarations(to: str) -> str:
    t = Template(_source(["a = int", "b = str"], "{{ a }}{{ b }}"))
    return _caught(lambda: t.validate_declarations(Template(_source(["a = int", to], "{{ a }}{{ b }}"))))


def _checked_once(spark: SparkSession) -> str:
    """A schema is looked at once; another one is looked at again."""
    t = Template(_source(["a = int"], "{{ a }}"))
    seen = []
    for column in ("cast(id as int)", "id", "id"):
        df = spark.range(1).selectExpr(f"{column} as a")
        t.column(df)
        seen.append(str(len(t._checked)))
    return " ".join(seen)


API: dict[str, tuple[Callable[[SparkSession], str], str]] = {
    "render_empty": (lambda s: Template(_source(["n = int := 4", "o = option(str) := None"], "{{ n }}[{{ o }}]")).render_empty(), "4[]"),
    "render_empty needs defaults": (lambda s: _caught(Template(_source(["n = int"], "{{ n }}")).render_empty), "missing_params: missing required parameters: n"),
    "unused allowed": (lambda s: Template.from_source_allowing_unused(_source(["x = str"], "ok")).render_dict({"x": ""}), "ok"),
    "unchecked": (lambda s: _unchecked(s), "a[null]"),
    "cached render": (lambda s: _cached_includes(), "True 1 x/a x/b"),
    "checked once for a schema": (_checked_once, "1 2 2"),
    "same declarations": (lambda s: _changed_declarations("b = str"), "None"),
    "changed declarations": (
        lambda s: _changed_declarations("b = int"),
        "declarations_mutated: template parameter declarations were modified at runtime: 'b' changed from str to int",
    ),
    "equal by source": (lambda s: str(Template("---\n---\na") == Template("---\r\n---\r\na")), "True"),
    "other source": (lambda s: str(Template("---\n---\na") == Template("---\n---\nb")), "False"),
    "line and snippet": (
        lambda s: _caught(lambda: Template(_source(["x = str"], "{{ x }}\n\n  {{ y }} z"))).partition("(")[2],
        "line 8: {{ y }} z)",
    ),
    "extra refused": (lambda s: _caught(lambda: Template("---\n---\na").render_dict({"q": 1})), "extra_params: extra undeclared parameters: q"),
    "extra allowed": (lambda s: Template("---\n---\na").render_dict({"q": 1}, allow_extra=True), "a"),
}


def _unchecked(spark: SparkSession) -> str:
    """Without the guard a null renders as Spark's null does: the whole text."""
    t = Template(_source(["a = str"], "{{ a }}"))
    df = spark.sql("select 1 k, 'a' a union all select 2, null").coalesce(1)
    shown = df.select("k", F.coalesce(t.column(df.select("k", "a"), unchecked=True), F.lit("[null]")).alias("out"))
    return "".join(r["out"] for r in shown.orderBy("k").collect())


@_query("q_api", f"SELECT r_regionkey, f.* FROM region, ({_values([(name, want) for name, (_, want) in API.items()], 'name, result')}) f")
def _(spark, sf_dir):
    """Calls of the library that are no rendering of a table, and what they give, once for each region."""
    keys = [r[0] for r in _table(spark, sf_dir, "region").select("r_regionkey").collect()]
    return spark.createDataFrame([(key, name, run(spark)) for key in keys for name, (run, _) in API.items()], "r_regionkey int, name string, result string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
