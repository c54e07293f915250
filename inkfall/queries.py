"""The engine's queries: for each a DataFrame that assembles the inputs, a template, and SQL with the same rows."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import record_queries
from .sources import TemplateCatalog, catalog_df, shared_dir, template_folder
from .streaming import render_stream
from .template import Template

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _template(source: str) -> Template:
    return Template(source)


def _source(params: str, body: str, more: str = "") -> str:
    declared = "".join(f"  - {p.strip()}\n" for p in params.strip().split("\n") if p.strip())
    return f"---\n{more}params:\n{declared}\n---\n{body}" if declared else f"---\n{more}params: []\n---\n{body}"


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _rows(name: str, table: str, keys: dict[str, str], columns: dict[str, str], params: str, body: str, sql: str, more: str = "") -> None:
    """A query over one table: keys and template columns are SQL expressions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _template(_source(params, body, more))
        df = _table(spark, sf_dir, table).select(*[F.expr(e).alias(k) for k, e in keys.items()], *[F.expr(e).alias(c) for c, e in columns.items()])
        return df.select(*keys, t.column(df).alias("out"))

    listed = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    _QUERIES[name] = run
    _SQL[name] = f"SELECT {listed}, {sql} AS out FROM {table}"


def _query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


CUSTOMER, ORDER, LINE, DOC = {"c_custkey": "c_custkey"}, {"o_orderkey": "o_orderkey"}, {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}, {"doc_id": "doc_id"}
PART, EVENT = {"p_partkey": "p_partkey"}, {"event_id": "event_id"}

# --- expressions and filters ------------------------------------------------

_rows(
    "q_interp",
    "customer",
    CUSTOMER,
    {"name": "c_name", "key": "c_custkey"},
    "name = str\nkey = int",
    "Hello {{ name }} ({{ key }})!",
    "'Hello ' || c_name || ' (' || c_custkey || ')!'",
)
_rows(
    "q_literals",
    "region",
    {"r_regionkey": "r_regionkey"},
    {"name": "r_name"},
    "name = str",
    "{{ \"a\\\"b\" }}|{{ 007 }}|{{ -0.0 }}|{{ 3.14 }}|{{ true }}|{{ 'it\\'s' | upper }}|{{ name }}",
    "'a\"b|7|0|3.14|true|IT''S|' || r_name",
)
_rows("q_upper", "part", PART, {"x": "p_name"}, "x = str", "{{ x | upper }}", "upper(p_name)")
_rows("q_lower", "part", PART, {"x": "p_brand"}, "x = str", "{{ x | lower }}", "lower(p_brand)")
_rows("q_trim", "part", PART, {"x": "concat(' \\t', p_name, '\\n ')"}, "x = str", "[{{ x | trim }}]", "'[' || p_name || ']'")
_rows("q_filter_chain", "part", PART, {"x": "concat('  ', p_name)"}, "x = str", "{{ x | trim | upper }}", "upper(p_name)")
_rows(
    "q_fixed_fast",
    "lineitem",
    LINE,
    {"x": "l_quantity / 8"},
    "x = float",
    "{{ x | fixed(2) }}",
    "(floor(l_quantity / 8 * 100 + 0.5)::bigint // 100)::varchar || '.' || lpad((floor(l_quantity / 8 * 100 + 0.5)::bigint % 100)::varchar, 2, '0')",
)
_rows("q_fixed_exact", "lineitem", LINE, {"x": "l_quantity / 8"}, "x = float", "{{ x | add(0) | fixed(2) }}", "printf('%.2f', l_quantity / 8)")
_rows("q_fixed_int", "orders", ORDER, {"x": "o_custkey"}, "x = int", "{{ x | fixed(3) }}", "o_custkey || '.000'")
_rows(
    "q_add_sub",
    "orders",
    ORDER,
    {"k": "o_custkey", "x": "o_orderkey / 4"},
    "k = int\nx = float",
    "{{ k | add(7) }}/{{ k | sub(3) }}/{{ k | sub(9223372036854775807) | sub(100000000) }}/{{ x | add(0.5) | fixed(2) }}",
    (
        "(o_custkey + 7) || '/' || (o_custkey - 3) || '/' || greatest(o_custkey::hugeint - 9223372036854775807 - 100000000, "
        "-9223372036854775808) || '/' || printf('%.2f', o_orderkey / 4 + 0.5)"
    ),
)
_rows("q_display_float", "supplier", {"s_suppkey": "s_suppkey"}, {"x": "s_acctbal"}, "x = float", "{{ x }}", "regexp_replace(s_acctbal::varchar, '\\.0$', '')")
_rows("q_len_bytes", "documents", DOC, {"t": "coalesce(text, '')"}, "t = str", "{{ len(t) }}", "strlen(coalesce(text, ''))")
_rows(
    "q_string_interpolation",
    "customer",
    CUSTOMER,
    {"seg": "c_mktsegment", "key": "c_custkey"},
    "seg = str\nkey = int",
    "{% if seg == \"{{ key }}\" %}same{% elif \"x{{ seg | lower }}\" == \"xbuilding\" %}b{% else %}{{ \"[{{ seg }}-{{ key }}]\" }}{% /if %}".replace(
        "{% if",
        "> {% if",
        1,
    ),
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' ELSE '[' || c_mktsegment || '-' || c_custkey || ']' END",
)

# --- conditions -------------------------------------------------------------

_IF = "> {{% if {} %}}yes{{% else %}}no{{% /if %}}"
_YES = "CASE WHEN {} THEN 'yes' ELSE 'no' END"
_LINE = {"q": "cast(l_quantity as bigint)", "d": "l_discount", "f": "l_returnflag", "s": "l_linestatus"}
_LP = "q = int\nd = float\nf = str\ns = str"
_TAIL = "{# {{ q }} {{ d }} {{ f }} {{ s }} #}"
for _name, _cond, _sql in (
    ("q_truthy", "d", "l_discount <> 0"),
    ("q_and_or_not", "(q > 10 && f == \"A\") || !(s == \"O\")", "(l_quantity > 10 AND l_returnflag = 'A') OR NOT l_linestatus = 'O'"),
    ("q_not_comparison", "!q > 25", "NOT l_quantity > 25"),
    ("q_cmp", "q >= 25 && d < 0.05", "l_quantity >= 25 AND l_discount < 0.05"),
    ("q_cmp_int_float", "q > 24.5", "l_quantity > 24.5"),
    ("q_eq", "f == s || q != 7", "l_returnflag = l_linestatus OR l_quantity <> 7"),
    ("q_eq_int_float", "q == 7.0", "false"),
):
    _rows(_name, "lineitem", LINE, _LINE, _LP, _IF.format(_cond) + _TAIL, _YES.format(_sql))
_rows(
    "q_in_list",
    "part",
    PART,
    {"b": "p_brand"},
    "b = str",
    _IF.format("b in BRANDS"),
    _YES.format("p_brand IN ('Brand#1', 'Brand#17')"),
    more="consts:\n  - BRANDS = list(str) := [\"Brand#1\", \"Brand#17\"]\n\n",
)
_rows(
    "q_in_subset",
    "part",
    PART,
    {"w": "split(p_name, ' ')"},
    "w = list(str)",
    _IF.format("w in KNOWN"),
    _YES.format("list_has_all(['small', 'ring', 'red', 'widget'], string_split(p_name, ' '))"),
    more="consts:\n  - KNOWN = list(str) := [\"small\", \"ring\", \"red\", \"widget\"]\n\n",
)
_rows("q_in_substr", "part", PART, {"n": "p_name"}, "n = str", _IF.format("\"ed w\" in n"), _YES.format("contains(p_name, 'ed w')"))
_rows(
    "q_in_list_str",
    "events",
    EVENT,
    {"l": "array('e', 'i')", "t": "event_type"},
    "l = list(str)\nt = str",
    _IF.format("l in t"),
    _YES.format("contains(event_type, 'e') AND contains(event_type, 'i')"),
)
_rows(
    "q_in_kinds",
    "events",
    EVENT,
    {"t": "event_type"},
    "t = str",
    _IF.format("t in kinds(Kind)"),
    _YES.format("event_type IN ('click', 'view')"),
    more="types:\n  - Kind = enum(click, view, other)\n\n",
)
_rows(
    "q_if_chain",
    "customer",
    CUSTOMER,
    {"b": "c_acctbal"},
    "b = float",
    "> {% if b < 0 %}debt{% elif b < 1000 %}low{% elif b < 5000 %}mid{% else %}high{% /if %}",
    "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END",
)

# --- enums, options, matching -----------------------------------------------

_EV = "types:\n  - Kind = enum(view, signup, purchase, click, error)\n\n"
_rows("q_kind", "orders", ORDER, {"s": "o_orderstatus"}, "s = enum(O, F, P)", "{{ kind(s) }}", "o_orderstatus")
_rows(
    "q_kinds",
    "region",
    {"r_regionkey": "r_regionkey"},
    {"n": "r_name"},
    "n = str",
    "{{ n }}:{{ kinds(Kind) | join(\", \") }}:{{ kind(Kind.click) }}",
    "r_name || ':view, signup, purchase, click, error:click'",
    more=_EV,
)
_rows(
    "q_for_kinds",
    "region",
    {"r_regionkey": "r_regionkey"},
    {"n": "r_name"},
    "n = str",
    "{{ n }}{% for k in kinds(Kind) %} {{ idx(k) }}={{ k }}{% /for %}",
    "r_name || ' 0=view 1=signup 2=purchase 3=click 4=error'",
    more=_EV,
)
_rows(
    "q_has",
    "events",
    EVENT,
    {"v": "if(value > 10, value, null)"},
    "v = option(float)",
    "> {% if has(v) && v > 12 %}big {{ v | fixed(1) }}{% elif has(v) %}some{% else %}none{% /if %} {{ kind(v) }}",
    (
        "CASE WHEN value > 12 THEN 'big ' || (floor(value * 10 + 0.5)::bigint // 10)::varchar || '.' || (floor(value * 10 + "
        "0.5)::bigint % 10)::varchar WHEN value > 10 THEN 'some' ELSE 'none' END || CASE WHEN value > 10 THEN ' Some' ELSE ' "
        "None' END"
    ),
)
_rows(
    "q_match_enum",
    "events",
    EVENT,
    {"k": "event_type"},
    "k = Kind",
    (
        "> {% match k %}\n> {% case view %}\n\nseen\n\n> {% case signup %}\n\nnew\n\n> {% case purchase %}\n\npaid\n\n> {% case click "
        "%}\n\nhit\n\n> {% case error %}\n\nbad\n\n> {% /match %}"
    ),
    "CASE event_type WHEN 'view' THEN 'seen' WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'paid' WHEN 'click' THEN 'hit' ELSE 'bad' END || chr(10)",
    more=_EV,
)
_rows(
    "q_match_multi",
    "events",
    EVENT,
    {"k": "event_type"},
    "k = Kind",
    "> {% match k %}{% case view | click %}look{% case signup | purchase %}act{% else %}rest{% /match %}",
    "CASE WHEN event_type IN ('view', 'click') THEN 'look' WHEN event_type IN ('signup', 'purchase') THEN 'act' ELSE 'rest' END",
    more=_EV,
)
_rows(
    "q_match_guard",
    "events",
    EVENT,
    {"k": "event_type", "v": "value"},
    "k = Kind\nv = float",
    "> {% match k %}{% case purchase && v > 10 %}large{% case purchase | click %}small{% else %}-{% /match %}",
    "CASE WHEN event_type = 'purchase' AND value > 10 THEN 'large' WHEN event_type IN ('purchase', 'click') THEN 'small' ELSE '-' END",
    more=_EV,
)
_rows(
    "q_match_inline",
    "events",
    EVENT,
    {"k": "event_type"},
    "k = Kind",
    "<{% match k case error %}!{% /match %}>",
    "CASE WHEN event_type = 'error' THEN '<!>' ELSE '<>' END",
    more=_EV,
)
_rows(
    "q_match_condition",
    "events",
    EVENT,
    {"k": "event_type", "v": "value"},
    "k = Kind\nv = float",
    "> {% if match k case view | click && v > 5 %}yes{% else %}no{% /if %}",
    _YES.format("event_type IN ('view', 'click') AND value > 5"),
    more=_EV,
)
_rows(
    "q_match_option",
    "events",
    EVENT,
    {"v": "if(value > 10, event_type, null)"},
    "v = option(str)",
    "> {% match v %}{% case Some %}{{ v | upper }}{% case None %}nothing{% /match %}",
    "CASE WHEN value > 10 THEN upper(event_type) ELSE 'nothing' END",
)
_rows(
    "q_match_scalar",
    "part",
    PART,
    {"n": "p_size", "b": "p_brand"},
    "n = int\nb = str",
    "> {% match n %}{% case 1 | 2 %}tiny{% case 11 %}eleven{% else %}{{ n }}{% /match %}/{% match b %}{% case \"Brand#1\" %}first{% else %}other{% /match %}",
    (
        "CASE WHEN p_size IN (1, 2) THEN 'tiny' WHEN p_size = 11 THEN 'eleven' ELSE p_size::varchar END || CASE WHEN p_brand = "
        "'Brand#1' THEN '/first' ELSE '/other' END"
    ),
)
_rows(
    "q_match_paramref",
    "lineitem",
    LINE,
    {"f": "l_returnflag", "w": "if(l_quantity > 25, 'A', 'R')"},
    "f = str\nw = str",
    "> {% match f %}{% case w %}hit{% else %}miss{% /match %}",
    "CASE WHEN l_returnflag = CASE WHEN l_quantity > 25 THEN 'A' ELSE 'R' END THEN 'hit' ELSE 'miss' END",
)
_rows(
    "q_match_interp_label",
    "lineitem",
    LINE,
    {"f": "concat(l_returnflag, '_', l_linestatus)", "s": "l_linestatus"},
    "f = str\ns = str",
    "> {% match f %}{% case \"N_{{ s }}\" %}n{% case \"{{ kind(Flag.A) }}_F\" %}a{% else %}-{% /match %}",
    "CASE WHEN l_returnflag = 'N' THEN 'n' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'a' ELSE '-' END",
    more="types:\n  - Flag = enum(A, N, R)\n\n",
)
_rows(
    "q_enum_payload",
    "orders",
    ORDER,
    {
        "s": (
            "named_struct('__kind__', if(o_orderstatus = 'F', 'Done', 'Open'), 'price', if(o_orderstatus = 'F', o_totalprice, null), "
            "'days', if(o_orderstatus = 'F', null, o_custkey))"
        ),
    },
    "s = enum(Done(price = float), Open(days = int))",
    "> {% match s %}{% case Done %}done {{ s.price | fixed(0) }}{% case Open %}open {{ s.days }}{% /match %} {{ kind(s) }}",
    "CASE WHEN o_orderstatus = 'F' THEN 'done ' || floor(o_totalprice + 0.5)::bigint || ' Done' ELSE 'open ' || o_custkey || ' Open' END",
)
_rows(
    "q_panic_lazy",
    "orders",
    ORDER,
    {"p": "o_totalprice"},
    "p = float",
    "> {% if p < -1 %}{% panic(\"negative price: {{ p }}\") %}{% else %}ok{% /if %}",
    "CASE WHEN o_totalprice < -1 THEN error('x') ELSE 'ok' END",
)

# --- text -------------------------------------------------------------------

_rows(
    "q_raw_comment_ws",
    "region",
    {"r_regionkey": "r_regionkey"},
    {"n": "r_name"},
    "n = str",
    "a  {{- n -}}  \n b {# note #}c\n\n> {% raw %}\n\n{{ n }} {% if %}\n\n> {% /raw %}\n\n> quoted\n> {% if n == \"ASIA\" %}A{% /if %}\n",
    (
        "'a' || r_name || ' b c' || chr(10) || '{{ n }} {% if %}' || chr(10) || '> quoted' || chr(10) || CASE WHEN r_name = "
        "'ASIA' THEN 'A' ELSE '' END || chr(10)"
    ),
)
_rows(
    "q_blank_lines",
    "region",
    {"r_regionkey": "r_regionkey"},
    {"n": "r_name"},
    "n = str",
    "top\n\n> {% if n != \"\" %}\n\n\n{{ n }}\n\n> {% /if %}\n\n\n\nend\n",
    "'top' || chr(10) || chr(10) || r_name || chr(10) || chr(10) || chr(10) || 'end' || chr(10)",
)

# --- declarations -----------------------------------------------------------


@_query("q_defaults", "SELECT r_regionkey, r_name || ' World 3 fast 1-2- Active true' AS out FROM region")
def _(spark, sf_dir):
    t = _template(
        _source(
            (
                "name = str\nwho = str := \"World\"\ncfg = struct(n = int, label = str) := {n = 3, label = \"fast\"}\nxs = list(int) := [1, "
                "2]\nst = enum(Active, Paused) := Active\nflag = bool := true"
            ),
            "{{ name }} {{ who }} {{ cfg.n }} {{ cfg.label }} {% for x in xs %}{{ x }}-{% /for %} {{ kind(st) }} {{ flag }}",
        ),
    )
    df = _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"))
    return df.select("r_regionkey", t.column(df).alias("out"))


@_query("q_env", "SELECT r_regionkey, r_name || ' eu 5 true' AS out FROM region")
def _(spark, sf_dir):
    t = Template(
        (
            "---\nenv:\n  - REGION = str\n  - RETRIES = int := 3\n  - DEBUG = bool := true\n\nparams:\n  - name = str\n\n---\n{{ name }} {{ "
            "REGION }} {{ RETRIES }} {{ DEBUG }}"
        ),
        env={"REGION": "eu", "RETRIES": "5"},
    )
    df = _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"))
    return df.select("r_regionkey", t.column(df).alias("out"))


_rows(
    "q_consts",
    "region",
    {"r_regionkey": "r_regionkey"},
    {"n": "r_name"},
    "n = str",
    "{{ consts.MAX }} {{ RATE }} {% if MAX > 5 %}{{ n }}{% else %}never{% /if %}{% for r in ROWS %} {{ r.k }}={{ r.v }}{% /for %}",
    "'10 0.5 ' || r_name || ' a=1 b=2'",
    more="consts:\n  - MAX = int := 10\n  - RATE = float := 0.5\n  - ROWS = list(k = str, v = int) := [{k = \"a\", v = 1}, {k = \"b\", v = 2}]\n\n",
)

_FILES = {
    "lib": "---\ntypes:\n  - Stage = enum(Design, Build)\n\nconsts:\n  - DIR = str := \"parts\"\n  - NAMES = list(str) := [\"x\", \"y\"]\n\nallow_unused: true\n\n---\n",
    "row": "---\nparams:\n  - nation = struct(key = int, name = str)\n  - mark = str := \"*\"\n\n---\n{{ mark }}{{ idx(nation) }}:{{ nation.name }};",
    "plain": "---\nparams:\n  - name = str\n\n---\nplain {{ name }}",
    "fancy": "---\nparams:\n  - name = str\n\n---\n~{{ name | lower }}~",
}


@functools.cache
def _folder() -> str:
    """The template files of these queries; the driver alone reads them."""
    return template_folder(_FILES)


@_query("q_import_const", "SELECT r_regionkey, r_name || ' parts x,y Build Design/Build' AS out FROM region")
def _(spark, sf_dir):
    t = Template(
        (
            "---\nimports:\n  - \"[lib](./lib.tmpl.md)\"\n\nparams:\n  - name = str\n\n---\n{{ name }} {{ lib.DIR }} {{ lib.NAMES | join(\",\") "
            "}} {{ kind(lib.Stage.Build) }} {{ kinds(lib.Stage) | join(\"/\") }}"
        ),
        base_dir=_folder(),
    )
    df = _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"))
    return df.select("r_regionkey", t.column(df).alias("out"))


# --- lists and loops --------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with the list of their nations, in order of key."""
    nation = _table(spark, sf_dir, "nation")
    listed = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")))).alias("nations"),
    )
    region = _table(spark, sf_dir, "region")
    empty = F.array().cast("array<struct<key:bigint,name:string>>")
    return region.join(listed, "r_regionkey", "left").select("r_regionkey", F.col("r_name").alias("region"), F.coalesce("nations", empty).alias("nations"))


_NATIONS = "nations = list(key = int, name = str)"
_AGG = "FROM region LEFT JOIN (SELECT n_regionkey, {} AS t, count(*) AS n FROM nation GROUP BY 1) ON r_regionkey = n_regionkey"


def _nation_query(name: str, params: str, body: str, sql: str, make: Callable[[], Template] | None = None, more: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = make() if make else _template(_source(params, body, more))
        df = _nations(spark, sf_dir)
        return df.select("r_regionkey", t.column(df).alias("out"))

    _QUERIES[name], _SQL[name] = run, sql


FLAGSHIP = _source(
    f"region = str\n{_NATIONS}",
    (
        "# {{ region }} ({{ len(nations) }})\n\n> {% for n in nations %}\n\n- {{ idx(n) }}. **{{ n.name | lower }}** {% if n.key > 9 "
        "%}late{% else %}early{% /if %}\n\n> {% else %}\n\nnone\n\n> {% /for %}\n"
    ),
)
_nation_query(
    "q_for",
    "",
    "",
    f"SELECT r_regionkey, '# ' || r_name || ' (' || coalesce(n, 0) || ')' || chr(10) || coalesce(t, 'none' || chr(10)) AS out {_AGG.format(chr(39).join(['string_agg(', '- ', ' || i || ', '. **', ' || lower(n_name) || ', '** ', ' || CASE WHEN n_nationkey > 9 THEN ', 'late', ' ELSE ', 'early', ' END || chr(10), ', '', ' ORDER BY n_nationkey)']))}".replace(
        "FROM nation GROUP BY 1",
        "FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY 1",
    ),
    lambda: _template(FLAGSHIP),
)
_nation_query(
    "q_for_else",
    f"{_NATIONS}\nregion = str",
    "{{ region }}:{% for n in nations | limit(0) %}{{ n.name }}{% else %}nobody{% /for %}:{% for n in nations %}{{ n.name }} {% else %}nobody{% /for %}",
    f"SELECT r_regionkey, r_name || ':nobody:' || coalesce(t, 'nobody') AS out {_AGG.format('string_agg(n_name || chr(32), chr(0) ORDER BY n_nationkey)')}".replace(
        "chr(0)",
        "''",
    ),
)
_nation_query(
    "q_idx_len",
    f"{_NATIONS}\nregion = str",
    "{{ region }} {{ len(nations) }}{# {{ nations }} #}{% for n in nations %}{% if idx(n) == 0 %} first={{ n.name }}{% /if %}{% /for %}",
    f"SELECT r_regionkey, r_name || ' ' || coalesce(n, 0) || coalesce(' first=' || t, '') AS out {_AGG.format('min_by(n_name, n_nationkey)')}",
)
_nation_query(
    "q_include_for",
    "",
    "",
    f"SELECT r_regionkey, r_name || ' ' || coalesce(t, '') AS out {_AGG.format('string_agg(chr(45) || i || chr(58) || n_name || chr(59), chr(0) ORDER BY n_nationkey)')}".replace(
        "chr(0)",
        "''",
    ).replace(
        "FROM nation GROUP BY 1",
        "FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY 1",
    ),
    lambda: Template(_source(f"region = str\n{_NATIONS}", "{{ region }} {% include [row](./row.tmpl.md) for nation in nations with mark=\"-\" %}"), base_dir=_folder()),
)
_nation_query(
    "q_inline_tmpl",
    f"region = str\n{_NATIONS}",
    (
        "> {% tmpl item %}\n---\nparams: [name = str]\n---\n<{{ name }}>{{ SEP }}\n\n> {% /tmpl %}\n\n{{ region }} {% for n in nations "
        "%}{% include item with name=n.name %}{% /for %}"
    ),
    f"SELECT r_regionkey, r_name || ' ' || coalesce(t, '') AS out {_AGG.format('string_agg(chr(60) || n_name || chr(62) || chr(43) || chr(10), chr(0) ORDER BY n_nationkey)')}".replace(
        "chr(0)",
        "''",
    ),
    more="consts:\n  - SEP = str := \"+\"\n\n",
)


@_query(
    "q_nested_for",
    (
        "SELECT r_regionkey, r_name || coalesce(string_agg(' ' || n_name || '[' || coalesce(s, '-') || ']', '' ORDER BY "
        "n_nationkey), '') AS out FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, "
        "string_agg(s_suppkey::varchar, ',' ORDER BY s_suppkey) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey "
        "GROUP BY r_regionkey, r_name"
    ),
)
def _(spark, sf_dir):
    supplier = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("s"))
    nation = _table(spark, sf_dir, "nation").join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    member = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.coalesce("s", F.array().cast("array<bigint>")).alias("suppliers"))
    listed = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(member)).alias("nations"))
    empty = F.array().cast("array<struct<key:int,name:string,suppliers:array<bigint>>>")
    df = _table(spark, sf_dir, "region").join(listed, "r_regionkey", "left").select(
        "r_regionkey",
        F.col("r_name").alias("region"),
        F.coalesce("nations", empty).alias("nations"),
    )
    t = _template(
        _source(
            "region = str\nnations = list(name = str, suppliers = list(int))",
            "{{ region }}{% for n in nations %} {{ n.name }}[{% for s in n.suppliers %}{% if idx(s) > 0 %},{% /if %}{{ s }}{% else %}-{% /for %}]{% /for %}",
        ),
    )
    return df.select("r_regionkey", t.column(df).alias("out"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").cast("long").alias("no"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


@_query("q_join", "SELECT l_orderkey, string_agg(l_returnflag, ' | ' ORDER BY l_linenumber, l_returnflag, l_quantity) AS out FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    df = _orders(spark, sf_dir).select("l_orderkey", F.col("lines.flag").alias("flags"))
    return df.select("l_orderkey", _template(_source("flags = list(str)", "{{ flags | join(\" | \") }}")).column(df).alias("out"))


@_query(
    "q_limit",
    (
        "SELECT l_orderkey, array_to_string(list_slice(list(l_linenumber || ':' || l_returnflag ORDER BY l_linenumber, "
        "l_returnflag, l_quantity), 1, 2), ' ') || ' ' AS out FROM lineitem GROUP BY 1"
    ),
)
def _(spark, sf_dir):
    df = _orders(spark, sf_dir)
    return df.select(
        "l_orderkey",
        _template(_source("lines = list(no = int, flag = str)", "{% for l in lines | limit(2) %}{{ l.no }}:{{ l.flag }} {% /for %}".replace("{%", "> {%", 1))).column(
            df,
        ).alias(
            "out",
        ),
    )


@_query(
    "q_join_optional",
    (
        "SELECT l_orderkey, string_agg(CASE WHEN l_quantity > 25 THEN l_linenumber::varchar ELSE '' END, '-' ORDER BY "
        "l_linenumber, l_returnflag, l_quantity) AS out FROM lineitem GROUP BY 1"
    ),
)
def _(spark, sf_dir):
    df = _orders(spark, sf_dir).select("l_orderkey", F.transform("lines", lambda x: F.when(x["q"] > 25, x["no"])).alias("big"))
    return df.select("l_orderkey", _template(_source("big = list(option(int))", "{{ big | join(\"-\") }}")).column(df).alias("out"))


# --- composition ------------------------------------------------------------


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"))


@_query("q_include_with", "SELECT r_regionkey, '[plain ' || r_name || '] [~x-' || lower(r_name) || '~]' AS out FROM region")
def _(spark, sf_dir):
    t = Template(
        _source("name = str", "[{% include [plain](./plain.tmpl.md) with name=name %}] [{% include [fancy](./fancy.tmpl.md) with name=\"X-{{ name }}\" %}]"),
        base_dir=_folder(),
    )
    df = _regions(spark, sf_dir)
    return df.select("r_regionkey", t.column(df).alias("out"))


@_query("q_higher_order", "SELECT r_regionkey, '~' || lower(r_name) || '~/plain ' || r_name AS out FROM region")
def _(spark, sf_dir):
    layout = Template(
        _source(
            "name = str\nwidget = tmpl(name = str)\nother = tmpl(name = str)",
            "{% include widget with name=name %}/{% include other with name=name %}".replace("{%", "> {%", 1),
        ),
        templates={n: Template.from_file(os.path.join(_folder(), f"{f}.tmpl.md")) for n, f in (("widget", "fancy"), ("other", "plain"))},
    )
    df = _regions(spark, sf_dir)
    return df.select("r_regionkey", layout.column(df).alias("out"))


@_query("q_dynamic_path", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'plain ' || r_name ELSE '~' || lower(r_name) || '~' END AS out FROM region")
def _(spark, sf_dir):
    t = Template(_source("name = str\nkind_of = str", "> {% include [part](./{{ kind_of }}.tmpl.md) with name=name %}"), base_dir=_folder())
    df = _regions(spark, sf_dir).withColumn("kind_of", F.when(F.col("r_regionkey") % 2 == 0, "plain").otherwise("fancy"))
    return df.select("r_regionkey", t.column(df).alias("out"))


# --- records, errors, metadata ----------------------------------------------


@_query("q_json_context", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS out FROM events")
def _(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", "props")
    return _template(_source("k = int", "k={{ k }}")).render_json(df, "props").select("event_id", "out")


@_query("q_append", "SELECT c_custkey, c_mktsegment || ': ' || c_name AS out FROM customer")
def _(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("out"), F.col("c_name").alias("name"))
    return _template(_source("name = str", ": {{ name }}")).append(df, "out").select("c_custkey", "out")


@_query(
    "q_render_try",
    (
        "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_acctbal >= 0 THEN c_name || ' ok' END AS out, CASE WHEN c_custkey "
        "% 7 = 0 THEN 'type_mismatch' WHEN c_acctbal < 0 THEN 'panic' END AS error_kind, CASE WHEN c_custkey % 7 = 0 THEN 'type "
        "mismatch: ''name'': expected str, got none ()' WHEN c_acctbal < 0 THEN 'template panic: debt of ' || c_name END AS "
        "error FROM customer"
    ),
)
def _(spark, sf_dir):
    t = _template(_source("name = str\nb = float", "{{ name }} {% if b < 0 %}{% panic(\"debt of {{ name }}\") %}{% /if %}ok"))
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("b"))
    return t.render_try(df).select("c_custkey", "out", "error_kind", "error")


@_query("q_python_engine", _SQL["q_if_chain"])
def _(spark, sf_dir):
    t = _template(_source("b = float", "> {% if b < 0 %}debt{% elif b < 1000 %}low{% elif b < 5000 %}mid{% else %}high{% /if %}"))
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    return df.select("c_custkey", t.column(df, engine="python").alias("out"))


@_query("q_catalog", "SELECT n_name AS name, 'of nation ' || n_nationkey AS description, 'name = str, k = int' AS params, 'k' AS defaults, 'REGION' AS consts FROM nation")
def _(spark, sf_dir):
    """A catalogue with a file for each nation, and its metadata as a table."""
    files = {
        r["n_name"]: _source("name = str\nk = int := 1", "{{ name }} {{ k }} {{ REGION }}", f"description: of nation {r['n_nationkey']}\nconsts:\n  - REGION = int := {r['n_regionkey']}\n\n")
        for r in _table(spark, sf_dir, "nation").collect()
    }
    catalog = TemplateCatalog(template_folder(files))
    return catalog_df(spark, {n: catalog.load(n) for n in catalog.names()}).select("name", "description", "params", "defaults", "consts")


@_query("q_document", "SELECT string_agg('* ' || r_name || chr(10), '' ORDER BY r_regionkey) AS out FROM region")
def _(spark, sf_dir):
    return _template(_source("name = str", "* {{ name }}\n")).document(_regions(spark, sf_dir), ["r_regionkey"])


@_query(
    "q_conversation_doc",
    (
        "SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '# ' ELSE upper(role) || ': ' END || text || chr(10), '' ORDER "
        "BY turn) AS out FROM conversations GROUP BY 1"
    ),
)
def _(spark, sf_dir):
    turn = F.struct("turn", "role", "text")
    df = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    t = _template(
        _source(
            "turns = list(role = Role, text = str)",
            "> {% for t in turns %}\n> {% match t.role %}{% case system %}# {% else %}{{ kind(t.role) | upper }}: {% /match %}{{ t.text }}\n\n> {% /for %}\n",
            "types:\n  - Role = enum(user, assistant, system)\n\n",
        ),
    )
    return df.select("conv_id", t.column(df).alias("out"))


@_query("q_stream_report", "SELECT event_id, event_type || ' ' || user_id AS out FROM events")
def _(spark, sf_dir):
    """The events as a stream, rendered and read again when all is there."""
    events = _table(spark, sf_dir, "events")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    t = _template(_source("kind_of = str\nuser = int", "{{ kind_of }} {{ user }}"))
    shown = render_stream(stream.select("event_id", F.col("event_type").alias("kind_of"), F.col("user_id").alias("user")), t).select("event_id", "out")
    run = shown.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("event_id long, out string").parquet(f"{folder}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region, with its nations."""
    return _QUERIES["q_for"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return _QUERIES | record_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | record_queries.oracle_sql()
