"""Situations of the language, rendered by the plain path; the column path is held against it in test_columns."""

import pytest

from inkfall import errors
from inkfall.template import Template


def body(params, text, more=""):
    declared = "".join(f"  - {p}\n" for p in params)
    return f"---\n{more}params:\n{declared}\n---\n{text}" if params else f"---\n{more}params: []\n---\n{text}"


def render(source, values=None, **how):
    return Template(source, **how).render_dict(values or {})


STAGE = "types:\n  - Stage = enum(Plan, Make, Ship)\n\n"

OUTPUTS = {
    "interpolation": (body(["who = str"], "Dear {{ who }},\n"), {"who": "Ann"}, "Dear Ann,\n"),
    "path": (body(["u = struct(home = struct(town = str))"], "{{ u.home.town }}"), {"u": {"home": {"town": "Ulm", "zip": 1}}}, "Ulm"),
    "numbers": (body(["i = int", "f = float", "b = bool"], "{{ i }} {{ f }} {{ b }}"), {"i": -3, "f": 4.25, "b": False}, "-3 4.25 false"),
    "int as float": (body(["f = float"], "{{ f }}"), {"f": 5}, "5"),
    "float forms": (body(["x = list(float)"], "{{ x | join(\" \") }}"), {"x": [3.0, -0.0, 1e21, 1.5e-7, 0.1 + 0.2]}, "3 0 1000000000000000000000 0.00000015 0.30000000000000004"),
    "literals": (body([], "{{ 012 }}|{{ -4 }}|{{ 2.50 }}|{{ -0.0 }}|{{ 'a\"b' }}|{{ \"c\\\\d\\n\" }}|{{ false }}"), {}, "12|-4|2.5|0|a\"b|c\\d\\n|false"),
    "filters": (body(["s = str"], "[{{ s | trim | upper }}] [{{ s | lower }}]"), {"s": "\t aB "}, "[AB] [\t ab ]"),
    "join limit": (body(["x = list(str)"], "{{ x | limit(2) | join(\", \") }}"), {"x": ["p", "q", "r"]}, "p, q"),
    "join keeps place of none": (body(["x = list(option(int))"], "{{ x | join(\"-\") }}"), {"x": [1, None, 3]}, "1--3"),
    "join with a pipe": (body(["x = list(str)"], "{{ x | join(\" | \") }}"), {"x": ["a", "b"]}, "a | b"),
    "fixed alone rounds half up": (body(["x = float"], "{{ x | fixed(2) }}"), {"x": 0.125}, "0.13"),
    "fixed in a chain is exact": (body(["x = float"], "{{ x | add(0) | fixed(2) }}"), {"x": 0.125}, "0.12"),
    "fixed keeps the sign of nothing": (body(["x = float"], "{{ x | fixed(2) }}"), {"x": -0.001}, "-0.00"),
    "fixed of int": (body(["x = int"], "{{ x | fixed(1) }}/{{ x | fixed(0) }}"), {"x": 7}, "7.0/7"),
    "add saturates": (body(["x = int"], "{{ x | add(5) }} {{ x | sub(0.5) }}"), {"x": (1 << 63) - 2}, "9223372036854775807 9223372036854776000"),
    "len counts bytes": (body(["s = str", "x = list(int)"], "{{ len(s) }} {{ len(x) }}"), {"s": "hé", "x": [1, 2]}, "3 2"),
    "if chain": (body(["n = int"], "> {% if n < 0 %}neg{% elif n == 0 %}zero{% else %}pos{% /if %}"), {"n": 0}, "zero"),
    "block if": (body(["b = bool"], "\n> {% if b %}\n\nyes\n\n> {% else %}\n\nno\n\n> {% /if %}\n"), {"b": False}, "no\n"),
    "not takes the comparison": (body(["n = int"], "> {% if !n > 3 %}small{% else %}big{% /if %}"), {"n": 2}, "small"),
    "grouping": (body(["a = bool", "b = bool", "c = bool"], "> {% if (a || b) && c %}1{% else %}0{% /if %}{% if a || b && c %}1{% else %}0{% /if %}"), {"a": True, "b": False, "c": False}, "01"),
    "int never equals float": (body(["n = int"], "> {% if n == 2.0 %}eq{% else %}ne{% /if %}"), {"n": 2}, "ne"),
    "order of int and float is exact": (body(["n = int", "f = float"], "> {% if n > f %}above{% else %}not{% /if %}"), {"n": 9007199254740993, "f": 9007199254740992.0}, "above"),
    "strings have no order": (body(["a = str"], "> {% if a < \"z\" %}1{% else %}0{% /if %}"), {"a": "b"}, "0"),
    "in list": (body(["x = list(str)"], "> {% if \"b\" in x %}1{% else %}0{% /if %}{% if !(\"z\" in x) %}1{% /if %}"), {"x": ["a", "b"]}, "11"),
    "in string": (body(["s = str"], "> {% if \"ell\" in s %}1{% /if %}"), {"s": "hello"}, "1"),
    "list in list": (body(["x = list(int)", "y = list(int)"], "> {% if x in y %}1{% else %}0{% /if %}"), {"x": [3, 1], "y": [1, 2, 3]}, "1"),
    "list in string": (body(["x = list(str)"], "> {% if x in \"abc\" %}1{% else %}0{% /if %}"), {"x": ["a", "bc"]}, "1"),
    "interpolated comparison": (body(["r = str", "e = str"], "> {% if r == \"admin_{{ e | upper }}\" %}1{% else %}0{% /if %}"), {"r": "admin_X", "e": "x"}, "1"),
    "escaped quote in a condition": (body(["r = str", "e = str"], "> {% if r == \"say \\\"{{ e }}\\\"\" %}1{% else %}0{% /if %}"), {"r": 'say "x"', "e": "x"}, "1"),
    "for": (body(["x = list(k = str, n = int)"], "\n> {% for i in x %}\n\n- {{ idx(i) }} {{ i.k }}\n\n> {% /for %}\n"), {"x": [{"k": "a", "n": 1}, {"k": "b", "n": 2}]}, "- 0 a\n- 1 b\n"),
    "for over texts": (body(["x = list(str)"], "{{ len(x) }}:{% for i in x %}<{{ i }}>{% /for %}{% for i in x | limit(0) %}{{ i }}{% else %}0{% /for %}{% for i in x %}{{ i }}{% /for %}"), {"x": ["a", "", "b"]}, "3:<a><><b>0ab"),
    "for else": (body(["x = list(int)"], "> {% for i in x %}{{ i }}{% else %}none{% /for %}"), {"x": []}, "none"),
    "nested for": (body(["g = list(m = list(int))"], "> {% for a in g %}{% for b in a.m %}{{ idx(a) }}.{{ idx(b) }}={{ b }} {% /for %}{% /for %}"), {"g": [{"m": [7, 8]}, {"m": [9]}]}, "0.0=7 0.1=8 1.0=9 "),
    "kinds": (body([], "{{ kinds(Stage) | join(\"/\") }} {{ kind(Stage.Make) }}{% for s in kinds(Stage) %} {{ s }}{% /for %}", STAGE), {}, "Plan/Make/Ship Make Plan Make Ship"),
    "match": (body(["s = Stage"], "\n> {% match s %}\n> {% case Plan | Make %}\n\nearly\n\n> {% case Ship %}\n\nlate\n\n> {% /match %}\n", STAGE), {"s": "Ship"}, "late\n"),
    "match payload": (body(["o = enum(Ok(v = int), Bad(v = str, why = str))"], "> {% match o %}{% case Ok %}ok {{ o.v }}{% case Bad %}{{ o.v }}: {{ o.why }}{% /match %}"), {"o": {"__kind__": "Bad", "v": "x", "why": "no"}}, "x: no"),
    "match guard falls through": (body(["s = Stage", "n = int"], "> {% match s %}{% case Plan && n > 5 %}A{% case Plan %}B{% else %}C{% /match %}", STAGE), {"s": "Plan", "n": 1}, "B"),
    "inline match": (body(["s = Stage"], "a{% match s case Ship %}!{% /match %}", STAGE), {"s": "Ship"}, "a!"),
    "enum equality with a literal": (body(["s = Stage"], "> {% if s == Stage.Make %}1{% else %}0{% /if %}", STAGE), {"s": "Make"}, "1"),
    "match as condition": (body(["s = Stage", "n = int"], "> {% if match s case Plan | Ship && n > 0 %}1{% else %}0{% /if %}", STAGE), {"s": "Ship", "n": 1}, "1"),
    "match scalars": (body(["n = int", "s = str", "b = bool"], "> {% match n %}{% case 1 | 2 %}few{% else %}many{% /match %} {% match s %}{% case \"x\" %}X{% else %}-{% /match %} {% match b %}{% case true %}T{% else %}F{% /match %}"), {"n": 2, "s": "x", "b": False}, "few X F"),
    "match parameter label": (body(["s = str", "w = str"], "> {% match s %}{% case w %}same{% else %}other{% /match %}"), {"s": "q", "w": "q"}, "same"),
    "match interpolated label": (body(["s = str", "w = str"], "> {% match s %}{% case \"{{ w }}_done\" %}1{% else %}0{% /match %}"), {"s": "q_done", "w": "q"}, "1"),
    "option": (body(["o = option(struct(v = str))"], "> {% if has(o) %}in {{ o.v }}{% else %}out{% /if %} {{ kind(o) }}"), {"o": {"v": "x"}}, "in x Some"),
    "option none": (body(["o = option(str) := None"], "[{{ o }}] {% if has(o) && o %}1{% else %}0{% /if %} {{ kind(o) }}"), {}, "[] 0 None"),
    "negated has": (body(["o = option(struct(v = str))"], "> {% if !has(o) %}out{% else %}in {{ o.v }}{% /if %}"), {"o": {"v": "x"}}, "in x"),
    "match option": (body(["o = option(int)"], "> {% match o %}{% case Some %}{{ o | add(1) }}{% case None %}-{% /match %}"), {"o": 4}, "5"),
    "option of enum narrowed": (body(["o = option(Stage)"], "> {% if has(o) %}{% match o %}{% case Plan %}p{% else %}q{% /match %}{{ kind(o) }}{% /if %}", STAGE), {"o": "Plan"}, "pPlan"),
    "raw": (body([], "\n> {% raw %}\n\n{{ x }} {% if %}\n\n> {% /raw %}"), {}, "{{ x }} {% if %}\n"),
    "raw with its own end": (body([], "> {% raw=## %}{% raw %}x{% /raw %}{% /## %}"), {}, "{% raw %}x{% /raw %}"),
    "comment": (body(["x = str"], "a{# {{ x }} is for later #}b\n\n> {# alone #}\n\nc"), {"x": ""}, "ab\nc"),
    "trim": (body(["x = str"], "a  {{- x -}}  \n b"), {"x": "-"}, "a- b"),
    "quote stays": (body(["x = str"], "> said\n> {% if x == \"\" %}1{% /if %}\n"), {"x": ""}, "> said\n1\n"),
    "extra blank lines stay": (body(["x = bool"], "a\n\n\n> {% if x %}\n\n\nb\n\n> {% /if %}\n\n\n\nc"), {"x": True}, "a\n\n\nb\n\n\nc"),
    "defaults": (body(["a = struct(n = int, t = list(str)) := {n = 1, t = [\"x, y\", \"z\"]}", "e = enum(A(k = int), B) := A(k = 3)"], "{{ a.n }} {{ a.t | join(\"+\") }} {% match e %}{% case A %}{{ e.k }}{% case B %}-{% /match %}"), {}, "1 x, y+z 3"),
    "constants": (body([], "{{ N }} {{ consts.S | upper }}{% for r in R %} {{ r.k }}{% /for %}", "consts:\n  - N = int := 3\n  - S = str := \"s\"\n  - R = list(k = int) := [{k = 1}, {k = 2}]\n\n"), {}, "3 S 1 2"),
    "inline template": (body(["x = list(str)"], "> {% tmpl row %}\n---\nparams: [it = str]\n---\n- {{ it }}\n\n> {% /tmpl %}\n\n> {% include row for it in x %}"), {"x": ["a", "b"]}, "- a\n- b\n"),
    "inline inside inline": (body(["v = str"], "> {% tmpl a %}\n---\nparams: [v = str]\n---\n[{{ v }}]\n\n> {% /tmpl %}\n\n> {% tmpl b %}\n---\nparams: [v = str]\n---\n\n> {% include a with v=v %}\n\n> {% /tmpl %}\n\n> {% include b with v=\"<{{ v }}>\" %}"), {"v": "x"}, "[<x>]\n"),
    "option inside list": (body(["ps = list(option(Stage))"], "> {% for p in ps %}{% match p %}{% case Some %}{% match p %}{% case Plan %}p{% case Make | Ship %}m{% /match %}{% case None %}-{% /match %} {% /for %}", STAGE), {"ps": ["Plan", None, "Ship"]}, "p - m "),
    "option inside struct": (body(["u = struct(n = str, bio = option(str))"], "{{ u.n }}:{% if has(u.bio) %}{{ u.bio | upper }}{% else %}-{% /if %}"), {"u": {"n": "B", "bio": "dev"}}, "B:DEV"),
    "trimmed statements": (body(["x = list(int)"], "[X {%- for n in x -%}  {%- if n > 0 -%} {{ n }} {%- /if -%} {%- /for -%} Y]"), {"x": [-1, 2, 4]}, "[X24Y]"),
    "trim after a comment": (body(["x = str"], "a  {# note -#}  b{{ x }}"), {"x": ""}, "a  b"),
    "trim keeps the line": (body(["b = bool"], "> {% if b %}\n\nc   \n\n> {%- /if %}"), {"b": True}, "c   \n"),
    "kind compared": (body(["s = Stage"], "> {% if kind(s) == \"Make\" %}1{% else %}0{% /if %}", STAGE), {"s": "Make"}, "1"),
    "quote in single quotes": (body(["n = str"], "> {% if n == 'x\\' || y' %}1{% else %}0{% /if %}"), {"n": "x' || y"}, "1"),
    "unquoted label on text": (body(["s = str"], "> {% match s %}{% case Active %}on{% else %}off{% /match %}"), {"s": "Active"}, "on"),
    "constant rows of enums": (body([], "> {% for r in L %}\n> {% match r.s %}\n> {% case Plan %}\n\np {{ r.d }}\n\n> {% else %}\n\nq {{ r.d }}\n\n> {% /match %}\n> {% /for %}", STAGE + "consts:\n  - L = list(s = Stage, d = str) := [{s = Plan, d = \"x\"}, {s = Ship, d = \"y\"}]\n\n"), {}, "p x\nq y\n"),
    "enum field of a payload": (body(["f = enum(Hit(s = Stage, d = str), Miss)"], "> {% match f %}{% case Hit %}{{ kind(f.s) }} {{ f.d }}{% case Miss %}-{% /match %}", STAGE), {"f": {"__kind__": "Hit", "s": "Ship", "d": "z"}}, "Ship z"),
    "unit variant of a payload enum as text": (body(["f = enum(Hit(d = str), Miss)"], "> {% match f %}{% case Hit %}{{ f.d }}{% case Miss %}-{% /match %}{% if match f case Miss %}!{% /if %}"), {"f": "Miss"}, "-!"),
    "empty params": ("---\nparams:\n---\n> {% raw %}{{ a }}{% /raw %}", {}, "{{ a }}"),
    "windows lines": ("---\r\nparams: [x = str]\r\n---\r\na\r\n{{ x }}\r\n", {"x": "b"}, "a\nb\n"),
    "unused in a comment": (body(["x = str := \"q\""], "ok{# unused: {{ x }} #}"), {}, "ok"),
    "no declarations": ("---\n---\n# T", {}, "# T"),
}


@pytest.mark.parametrize("name", OUTPUTS)
def test_output(name):
    source, values, want = OUTPUTS[name]
    assert render(source, values) == want


FAULTS = {
    "unused": (body(["x = str"], "no"), "unused"),
    "undeclared": (body(["name = str"], "{{ name }} {{ nam }}"), "undeclared variable 'nam': did you mean 'name'"),
    "unclosed expression": (body(["x = str"], "{{ x "), "unclosed"),
    "unclosed block tells its line": (body(["x = bool"], "a\n\n> {% if x %}\n\nb"), "line 8"),
    "unknown filter": (body(["x = str"], "{{ x | nope }}"), "unknown filter: nope"),
    "unknown function": (body(["x = str"], "{{ str(x) }}"), "unknown function"),
    "bad numbers": (body([], "{{ 1e3 }}"), "malformed"),
    "plus": (body([], "{{ +5 }}"), "malformed number"),
    "no type": (body(["x := 1"], "{{ x }}"), "must have an explicit type"),
    "no annotation": (body(["x"], "{{ x }}"), "is missing a type annotation"),
    "list of struct": (body(["x = list(struct(a = int))"], "{{ x }}"), "list(struct("),
    "qualified default": (body(["s = Stage := Stage.Plan"], "{{ kind(s) }}", STAGE), "use the bare variant name"),
    "unquoted default": (body(["s = str := a # b"], "{{ s }}"), "must be quoted"),
    "comment cuts a quoted default": (body(["s = str := \"a # b\""], "{{ s }}"), "must be quoted"),
    "option has no truth": (body(["o = option(str)"], "> {% if o %}1{% /if %}"), "cannot evaluate truthiness of option"),
    "enum has no truth": (body(["s = Stage"], "> {% if s %}1{% /if %}", STAGE), "truthiness of enum"),
    "none leaks by else": (body(["o = option(struct(v = str))"], "> {% if has(o) %}{{ o.v }}{% else %}{{ o.v }}{% /if %}"), "None here"),
    "none leaks by not": (body(["o = option(struct(v = str))"], "> {% if !has(o) %}{{ o.v }}{% /if %}"), "None here"),
    "none leaks by case": (body(["o = option(struct(v = str))"], "> {% match o %}{% case Some %}{{ o.v }}{% case None %}{{ o.v }}{% /match %}"), "None here"),
    "not exhaustive": (body(["s = Stage"], "> {% match s %}{% case Plan %}1{% /match %}", STAGE), "{% case Make | Ship %}"),
    "unknown variant": (body(["s = Stage"], "> {% match s %}{% case Plam %}1{% else %}2{% /match %}", STAGE), "unknown variant"),
    "quoted label on enum": (body(["s = Stage"], "> {% match s %}{% case \"Plan\" %}1{% else %}2{% /match %}", STAGE), "quoted string"),
    "number label on str": (body(["s = str"], "> {% match s %}{% case 4 %}1{% else %}2{% /match %}"), "numeric literal"),
    "string label on int": (body(["n = int"], "> {% match n %}{% case \"4\" %}1{% else %}2{% /match %}"), "cannot match int"),
    "match on kind": (body(["s = Stage"], "> {% match kind(s) %}{% case \"Plan\" %}1{% else %}2{% /match %}", STAGE), "kind()"),
    "field of one variant": (body(["o = enum(A(x = int), B)"], "{{ o.x }}"), "not a field of"),
    "missing field": (body(["u = struct(a = int)"], "{{ u.b }}"), "available fields: a"),
    "render a list": (body(["x = list(int)"], "{{ x }}"), "cannot render"),
    "join structs": (body(["x = list(a = int)"], "{{ x | join(\",\") }}"), "struct"),
    "upper of a number": (body([], "{{ 42 | upper }}"), "requires a string"),
    "len of a struct": (body(["u = struct(a = int)"], "{{ len(u) }}"), "len() requires a list or string"),
    "bare enum literal": (body([], "{{ Stage.Plan }}", STAGE), "kind(Stage.Plan)"),
    "loop over enum": (body([], "> {% for s in Stage %}{{ s }}{% /for %}", STAGE), "kinds(Stage)"),
    "variant in kinds": (body([], "> {% if \"Plam\" in kinds(Stage) %}1{% /if %}", STAGE), "not a variant"),
    "internal key": (body(["u = struct(a = int)"], "{{ u.__kind__ }}"), "__kind__"),
    "reserved": (body(["option = str"], "{{ option }}"), "reserved keyword used as name: 'option'"),
    "loop shadows": (body(["a = str", "x = list(str)"], "{{ a }}{% for a in x %}{{ a }}{% /for %}"), "shadows"),
    "param and const": (body(["X = int"], "{{ X }}", "consts:\n  - X = int := 1\n\n"), "conflicts"),
    "blank line after a list": ("---\nparams:\n  - x = str\nallow_unused: true\n---\n", "blank line is required after a block list"),
    "unused alias": (body([], "x", "types:\n  - T = struct(a = int)\n\n"), "unused type alias"),
    "bare tag": (body(["x = bool"], "{% if x %}1{% /if %}"), "bare statement tag"),
    "bare comment": (body([], "{# c #}"), "blockquote prefix"),
    "no blank line": (body(["x = bool"], "a\n> {% if x %}\n\nb\n\n> {% /if %}\n"), "preceded by a blank line"),
    "not keyword": (body(["x = bool"], "> {% if not x %}1{% /if %}"), "not"),
    "open bracket": (body(["x = int"], "> {% if (x > 1 %}1{% /if %}"), "')'"),
    "dangling and": (body(["x = bool"], "> {% if x && %}1{% /if %}"), "expected an expression"),
    "empty panic": (body([], "> {% panic() %}"), "panic"),
    "case after else": (body(["s = Stage"], "> {% match s %}{% case Plan %}1{% else %}2{% case Make %}3{% /match %}", STAGE), "last arm"),
    "include argument type": (body(["x = str"], "> {% tmpl t %}\n---\nparams: [n = int]\n---\n{{ n }}\n\n> {% /tmpl %}\n\n> {% include t with n=x %}"), "type mismatch"),
    "include argument missing": (body([], "> {% tmpl t %}\n---\nparams: [n = int]\n---\n{{ n }}\n\n> {% /tmpl %}\n\n> {% include t %}"), "missing required parameters: n"),
    "env is required": ("---\nenv: [E = int]\n\nparams: []\n---\n{{ E }}", "no value provided and no default"),
    "unbalanced type": (body(["x = list(str"], "{{ x }}"), ")"),
    "angle brackets": (body(["x = list<str>"], "{{ x }}"), "parentheses"),
}


@pytest.mark.parametrize("name", FAULTS)
def test_fault(name):
    source, words = FAULTS[name]
    with pytest.raises(errors.TemplateSyntaxError) as e:
        Template(source)
    assert words in str(e.value)


def test_faults_tell_line_and_text():
    with pytest.raises(errors.TemplateSyntaxError) as e:
        Template(body(["x = bool"], "a\n\n> {% if x %}\n\nb\n\n> {% /if %}\n\n\nc {{ oops }} d\n"))
    assert (e.value.line, e.value.snippet) == (15, "c {{ oops }} d")
    with pytest.raises(errors.TemplateSyntaxError) as e:
        Template(body(["x = bool"], "{{ x }}\n{% if x %}1{% /if %}"))
    assert (e.value.line, e.value.snippet) == (7, "{% if x %}1{% /if %}")


def test_render_faults():
    t = Template(body(["n = int", "s = Stage"], "{{ n }}{{ kind(s) }}", STAGE))
    with pytest.raises(errors.MissingParams, match="missing required parameters: s"):
        t.render_dict({"n": 1})
    with pytest.raises(errors.TypeMismatch, match="type mismatch for 'n': expected int, got str"):
        t.render_dict({"n": "1", "s": "Plan"})
    with pytest.raises(errors.TypeMismatch, match="expected enum"):
        t.render_dict({"n": 1, "s": "Nope"})
    with pytest.raises(errors.ExtraParams, match="z"):
        t.render_dict({"n": 1, "s": "Plan", "z": 0})
    assert t.render_dict({"n": 1, "s": "Plan", "z": 0}, allow_extra=True) == "1Plan"
    with pytest.raises(errors.TypeMismatch, match=r"rows\[1\].k"):
        Template(body(["rows = list(k = int)"], "{% for r in rows %}{{ r.k }}{% /for %}".replace("{%", "> {%", 1))).render_dict({"rows": [{"k": 1}, {"k": "x"}]})


def test_panic():
    t = Template(body(["n = int", "why = str"], "> {% if n > 1 %}{% panic(\"no {{ n }}\") %}{% elif n == 1 %}{% panic(why) %}{% /if %}ok"))
    assert t.render_dict({"n": 0, "why": "w"}) == "ok"
    with pytest.raises(errors.Panic, match="template panic: no 2"):
        t.render_dict({"n": 2, "why": "w"})
    with pytest.raises(errors.Panic, match="template panic: w"):
        t.render_dict({"n": 1, "why": "w"})


def test_env():
    source = "---\nenv:\n  - DIR = str\n  - N = int := 3\n  - B = bool := false\n\nparams: []\n---\n{{ DIR }} {{ N }} {{ B }}"
    assert render(source, env={"DIR": "d"}) == "d 3 false"
    assert render(source, env={"DIR": "d", "N": "4", "B": True}) == "d 4 true"
    with pytest.raises(errors.TemplateSyntaxError):
        Template(source, env={"DIR": "d", "N": "x"})


@pytest.fixture
def files(tmp_path):
    def write(**texts):
        for name, text in texts.items():
            path = tmp_path / f"{name.replace('__', '/')}.tmpl.md"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        return str(tmp_path)

    return write


def test_includes(files):
    base = files(hi="---\nparams:\n  - name = str\n  - greet = str := \"Hi\"\n\n---\n{{ greet }} {{ name }}!", sub__deep="---\nimports:\n  - \"[cfg](../cfg.tmpl.md)\"\n\nparams: [m = str]\n---\n{{ m }}@{{ cfg.V }}", cfg="---\nconsts: [V = str := \"1.0\", DIR = str := \".\"]\n---\n", row="---\nparams: [n = int]\n---\n{{ idx(n) }}={{ n }};")
    assert render(body(["x = str"], "> {% include [hi](./hi.tmpl.md) with name=x %}"), {"x": "A"}, base_dir=base) == "Hi A!"
    assert render(body(["x = str"], "> {% include [hi](./hi.tmpl.md) with name=x | upper, greet=\"Yo, you\" %}"), {"x": "a"}, base_dir=base) == "Yo, you A!"
    assert render(body(["x = str"], "> {% include [deep](./sub/deep.tmpl.md) with m=x %}"), {"x": "A"}, base_dir=base) == "A@1.0"
    assert render(body(["x = list(int)"], "> {% include [row](./row.tmpl.md) for n in x %}"), {"x": [5, 6]}, base_dir=base) == "0=5;1=6;"
    assert render("---\nimports:\n  - \"[cfg](./cfg.tmpl.md)\"\n  - \"[hi]({{ cfg.DIR }}/hi.tmpl.md)\"\n\nparams: [x = str]\n---\n> {% include [hi]({{ cfg.DIR }}/hi.tmpl.md) with name=x %}", {"x": "B"}, base_dir=base) == "Hi B!"
    for d in (".", "./sub"):
        files(sub__hi="---\nparams: [name = str]\n---\nSub {{ name }}")
        want = "Hi B!" if d == "." else "Sub B"
        assert render(body(["x = str", "d = str"], "> {% include [hi]({{ d }}/hi.tmpl.md) with name=x %}"), {"x": "B", "d": d}, base_dir=base) == want
    with pytest.raises(errors.IncludeNotFound):
        render(body(["x = str", "d = str"], "> {% include [hi]({{ d }}/hi.tmpl.md) with name=x %}"), {"x": "B", "d": "./none"}, base_dir=base)
    with pytest.raises(errors.IncludeNotFound):
        Template(body([], "> {% include [no](./no.tmpl.md) %}"), base_dir=base)
    with pytest.raises(errors.TemplateSyntaxError, match="must start with"):
        Template(body([], "> {% include [hi](hi.tmpl.md) %}"), base_dir=base)
    with pytest.raises(errors.TemplateSyntaxError, match="unresolvable"):
        Template("---\nimports:\n  - \"[hi]({{ NOPE }}/hi.tmpl.md)\"\n\nparams: []\n---\n", base_dir=base)
    with pytest.raises(errors.TemplateSyntaxError, match="does not match file name"):
        Template("---\nimports:\n  - \"[ho](./hi.tmpl.md)\"\n\nparams: []\n---\n", base_dir=base)


def test_recursion_ends(files):
    base = files(loop="---\nparams: [n = int]\n---\n{{ n }}{% include [loop](./loop.tmpl.md) with n=n %}")
    with pytest.raises(errors.TemplateSyntaxError, match="maximum include depth"):
        render(body(["n = int"], "> {% include [loop](./loop.tmpl.md) with n=n %}"), {"n": 1}, base_dir=base)


def test_mutual_imports(files):
    base = files(a="---\nimports:\n  - \"[b](./b.tmpl.md)\"\n\nconsts: [A = int := 1]\n---\n{{ b.B }}{{ A }}", b="---\nimports:\n  - \"[a](./a.tmpl.md)\"\n\nconsts: [B = int := 2]\n---\n{{ a.A }}")
    assert Template.from_file(f"{base}/a.tmpl.md").render_empty() == "21"


def test_higher_order():
    hello = Template(body(["name = str", "mark = str := \"!\""], "Hello {{ name }}{{ mark }}"))
    layout = body(["w = tmpl(name = str)"], "> {% include w with name=\"World\" %}")
    assert render(layout, templates={"w": hello}) == "Hello World!"
    with pytest.raises(errors.TemplateSyntaxError, match="does not match"):
        Template(layout, templates={"w": Template(body(["age = int"], "{{ age }}"))})
    outer = Template(body(["t = tmpl(x = str)"], "> {% include t with x=\"hi\" %}"))
    inner = Template(body(["x = str"], "in={{ x }}"))
    both = body(["a = tmpl(t = tmpl(x = str))", "b = tmpl(x = str)"], "> {% include a with t=b %}")
    assert render(both, templates={"a": outer, "b": inner}) == "in=hi"
    with pytest.raises(errors.MissingParams):
        Template(layout).render_dict({})


def test_metadata():
    t = Template("---\nname: t\ndescription: About it\nconsts: [C = int := 1]\n\nparams:\n  - a = list(k = str)\n  - b = option(int) := None\n\n---\n{{ len(a) }}{{ b }}{{ C }}")
    assert (t.name, t.description, t.declarations(), t.defaults(), t.consts()) == ("t", "About it", [("a", "list(k = str)"), ("b", "option(int)")], {"b": None}, {"C": 1})
    assert t == Template(t.source) and t.source_hash == Template(t.source).source_hash
    t.validate_declarations(Template(t.source.replace("{{ C }}", "!{{ C }}")))
    with pytest.raises(errors.DeclarationsMutated, match="'b' changed"):
        t.validate_declarations(Template(t.source.replace("option(int)", "option(str)")))
    assert {type(e()) if e in (errors.TemplateError,) else e for e in (errors.Panic, errors.MissingParams)} and errors.Panic("x").kind == "panic"


def test_catalog(files, tmp_path):
    from inkfall.sources import TemplateCatalog

    base = files(a="---\nparams: [x = str]\n---\nA{{ x }}", b="---\nparams: [x = str]\n---\n> {% include [a](./a.tmpl.md) with x=x %}")
    catalog = TemplateCatalog(base, max_entries=2)
    first = catalog.load("b")
    assert catalog.load("b") is first and first.render_dict({"x": "1"}) == "A1"
    assert (catalog.template_count, catalog.include_count, catalog.names()) == (1, 1, ["a", "b"])
    path = tmp_path / "b.tmpl.md"
    import os

    os.utime(path, ns=(1, 1))
    assert catalog.load("b") is first  # touched, not changed
    path.write_text("---\nparams: [x = str]\n---\nB{{ x }}")
    assert catalog.load("b").render_dict({"x": "1"}) == "B1"
    with pytest.raises(errors.IncludeNotFound):
        catalog.load("none")
    catalog.clear()
    assert catalog.template_count == 0


@pytest.mark.parametrize("tag", ["{%if x %}", "{% if x%}", "{%-if x -%}", "{# a#}", "{#a #}", "{%if x%}"])
def test_tags_need_spaces(tag):
    text = f"> {tag}\n\na\n\n> {{% /if %}}\n" if "if" in tag else f"> {tag}\n\n{{{{ x }}}}\n"
    with pytest.raises(errors.TemplateSyntaxError, match="must have spaces around the content") as e:
        Template(body(["x = bool"], text))
    assert e.value.line == 6


def test_lines_by_their_form():
    from inkfall.plans.syntax import join_lines, line_of

    forms = {"": "blank", " \t": "blank", "> {% if x %}": "tag", "  >{% if x %} ": "tag", "> {# a #} {# b #}": "tag", "> {% if x %}y": "lead", "> {% if x %}{% /if %}": "lead", "{% if x %}": "bare", " {# a #}": "bare", "> said": "text", "a {% if x %}": "text", "---": "text"}
    assert {s: line_of(s).form for s in forms} == forms
    cases = {  # N blank lines beside a tag give N - 1; between tags and at the end none
        "a\n\n> {% t %}\n\nb": "a\n{% t %}b",
        "a\n\n\n\n> {% t %}\n\n\nb\n": "a\n\n\n{% t %}\nb\n",
        "> {% t %}\n\n\n> {% u %}\n\n": "{% t %}{% u %}",
        "\n> {% t %}": "{% t %}",
        "\n\n> {% t %}\n> {% u %}\n\nb\n\n\nc": "\n{% t %}{% u %}b\n\n\nc",
        "a\n> {% t %}b\n\nc": "a\n{% t %}b\n\nc",
        "\n\na": "\n\na",
    }
    for text, want in cases.items():
        out, begins = join_lines([line_of(x) for x in text.split("\n")])
        assert out == want and len(begins) == text.count("\n") + 1 and begins == sorted(begins)


def test_a_broken_file_is_told_where_a_row_names_it(tmp_path):
    (tmp_path / "good.tmpl.md").write_text("---\nparams: [n = str]\n---\n<{{ n }}>")
    (tmp_path / "bad.tmpl.md").write_text("---\nparams: [n = str]\n---\n{{ n | nope }}")
    (tmp_path / "other.tmpl.md").write_text("---\nparams: [q = str]\n---\n{{ q }}")
    t = Template(body(["n = str", "f = str"], "{% include [part](./{{ f }}.tmpl.md) with n=n %}".replace("{%", "> {%", 1)), base_dir=str(tmp_path))
    assert t.render_dict({"n": "x", "f": "good"}) == "<x>"
    for name, kind, text in (("bad", "syntax", "unknown filter: nope"), ("other", "syntax", "n"), ("gone", "include_not_found", "gone")):
        with pytest.raises(errors.TemplateError, match=text) as e:
            t.render_dict({"n": "x", "f": name})
        assert e.value.kind == kind
