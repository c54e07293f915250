"""From syntax to the typed tree.

One pass resolves names, checks types and the flow of optional values, inlines includes, folds
what constants decide, and reports the first fault."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

from ..errors import IncludeNotFound, TemplateSyntaxError
from . import syntax as S
from . import tree as N
from .frontmatter import Header, interpolate_path, parse, split_source, strict_path
from .types import BOOL, FLOAT, INT, NUMBERS, RESERVED, STR, Enum, List, Option, Scalar, Struct, Tmpl, VarType

MAX_DEPTH = 16
MAX_NODES = 200_000
NEAR = 2
PREFIXES = ("consts", "opts", "options", "params")
ABSENT = "absent"


@dataclass
class Unit:
    """A template's source in parts: its header and body, and where its files are."""

    head: Header
    body: S.Body
    base_dir: str | None
    env: dict
    parent: "Unit | None" = None
    inline: dict[str, "Unit"] = field(default_factory=dict)

    @classmethod
    def of(cls, source: str, base_dir: str | None, env: dict | None, parent: "Unit | None" = None, before: int = 0) -> "Unit":
        """before: lines of the file before an inline template."""
        front, text, line = split_source(source)
        line += before
        head = parse(front, base_dir, env, parent.head if parent else None)
        unit = cls(head, S.parse_body(text, line + 1, bare=parent is not None), base_dir, env or {}, parent)
        unit.inline = {n: cls.of(src.lstrip("\n"), base_dir, env, unit, at) for n, (src, at) in unit.body.inline.items()}
        names = {d.name for d in (*head.params, *head.consts, *head.env)} | set(head.types) | set(head.imports)
        for n in unit.inline:
            if n in RESERVED:
                raise TemplateSyntaxError(f"reserved keyword used as name: '{n}'")
            if n in names:
                raise TemplateSyntaxError(f"inline template name '{n}' conflicts with a declared name")
        return unit

    def inline_of(self, name: str) -> "Unit | None":
        if name in self.inline:
            return self.inline[name]
        return self.parent.inline_of(name) if self.parent else None


@dataclass
class Scope:
    unit: Unit
    names: dict[str, N.Node]
    templates: dict[str, "Unit | None"]
    flow: dict[str, object] = field(default_factory=dict)  # path -> narrowed type, variant names, or ABSENT
    loops: dict[str, int] = field(default_factory=dict)
    depth: int = 0

    def within(self, **more) -> "Scope":
        return replace(self, **more)


@dataclass(frozen=True)
class OneOf:
    """An enum known to be one of these variants."""

    names: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Routed:
    """A template that a row chooses: the parameter is a text, the name of one of these."""

    name: str
    units: dict[str, Unit]


def _units(given) -> list[Unit]:
    """The templates that a value of a template parameter can be."""
    if given is None:
        return []
    return list(given.units.values() if isinstance(given, Routed) else given.values() if isinstance(given, dict) else [given])


class Compiler:
    def __init__(self, load=None, max_depth: int = MAX_DEPTH):
        self.load, self.max_depth = load, max_depth
        self.loop = 0
        self.used: set[str] = set()
        self.nodes = 0
        self.shadow: TemplateSyntaxError | None = None

    # --- templates ----------------------------------------------------------

    def compile(self, unit: Unit, templates: dict[str, Unit], allow_unused: bool = False) -> N.Node:
        head = unit.head
        names = {d.name: N.Param(d.name, d.type) for d in head.params if not _is_tmpl(d.type)}
        given = {}
        for d in head.params:
            if _is_tmpl(d.type):
                given[d.name] = templates.get(d.name)
                for u in _units(given[d.name]):
                    self.signature(d.name, d.type, u)
                if isinstance(given[d.name], dict):
                    given[d.name] = Routed(d.name, given[d.name])
        got = self.block(unit.body.nodes, Scope(unit, names, given))
        if not (allow_unused or head.allow_unused):
            free = [d.name for d in head.params if d.name not in self.used | self.mentioned(unit)]
            if free:
                raise TemplateSyntaxError(f"unused parameter '{free[0]}': use it, or mention it in a comment")
        if self.shadow is not None:
            raise self.shadow
        return got

    def mentioned(self, unit: Unit) -> set[str]:
        return unit.body.mentioned

    def signature(self, name: str, kind: VarType, unit: Unit) -> None:
        kind = kind.inner if isinstance(kind, Option) else kind
        have = {d.name: d for d in unit.head.params}
        for n, t in kind.fields:
            if n not in have or have[n].type != t:
                raise TemplateSyntaxError(f"template for '{name}' does not match {kind}: parameter '{n}' must be {t}")
        for d in unit.head.params:
            if d.required and d.name not in dict(kind.fields):
                raise TemplateSyntaxError(f"template for '{name}' does not match {kind}: parameter '{d.name}' has no default")

    # --- statements ---------------------------------------------------------

    def block(self, nodes: list, scope: Scope) -> N.Node:
        return text_of([self.node(n, scope) for n in nodes])

    def node(self, n, scope: Scope) -> N.Node:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise TemplateSyntaxError("the template grows too large when its includes are written out")
        if isinstance(n, S.Text):
            return N.Const(n.text, STR)
        try:
            return getattr(self, "n_" + type(n).__name__.lower())(n, scope)
        except TemplateSyntaxError as e:
            if e.line is None:
                raise type(e)(e.message, n.line, type(n).__name__.lower()) from None
            raise

    def n_show(self, n: S.Show, scope: Scope) -> N.Node:
        return self.shown(self.value(n.expr, scope), str(getattr(n.expr, "names", "") and n.expr))

    def n_panic(self, n: S.Panic, scope: Scope) -> N.Node:
        return N.Stop(self.shown(self.value(n.expr, scope), "panic"), "panic")

    def n_if(self, n: S.If, scope: Scope) -> N.Node:
        branches, carried = [], dict(scope.flow)
        for cond, body in n.branches:
            here = scope.within(flow=dict(carried))
            test, yes, no = self.test(cond, here)
            branches.append((test, self.block(body, scope.within(flow=carried | yes))))
            carried |= no
        other = self.block(n.other, scope.within(flow=carried)) if n.other is not None else N.Const("", STR)
        return choice(branches, other)

    def n_for(self, n: S.For, scope: Scope) -> N.Node:
        over = self.iterable(n.over, scope)
        self.binding(n.name, scope)
        number = self.loop = self.loop + 1
        item = N.Item(number, over.type.item)
        flow = {k: v for k, v in scope.flow.items() if k.split(".")[0] != n.name}
        inner = scope.within(names=scope.names | {n.name: item}, loops=scope.loops | {n.name: number}, flow=flow)
        body = self.block(n.body, inner)
        other = self.block(n.other, scope) if n.other is not None else None
        return N.Loop(number, over, body, other)

    def binding(self, name: str, scope: Scope) -> None:
        head = scope.unit.head
        taken = {d.name for d in (*head.params, *head.consts, *head.env)} | set(head.imports) | set(scope.unit.inline)
        if name in taken and self.shadow is None:  # told after parameters that nothing uses
            self.shadow = TemplateSyntaxError(f"loop variable '{name}' shadows a declared name")
        if name in RESERVED:
            raise TemplateSyntaxError(f"reserved keyword used as name: '{name}'")

    def iterable(self, expr, scope: Scope) -> N.Node:
        if isinstance(expr, S.Path) and isinstance(self.named_type(expr.names, scope), Enum):
            raise TemplateSyntaxError(f"cannot iterate over enum type '{expr}': use kinds({expr})")
        over = self.value(expr, scope)
        if not isinstance(over.type, List):
            raise TemplateSyntaxError(f"for needs a list, '{expr}' is {over.type}")
        return over

    def n_match(self, n: S.Match, scope: Scope) -> N.Node:
        if isinstance(n.expr, S.Call) and n.expr.name == "kind":
            raise TemplateSyntaxError(f"match on kind() loses the enum: write match {n.expr.arg}")
        subject = self.value(n.expr, scope, whole=True)
        path = str(n.expr) if isinstance(n.expr, S.Path) else None
        branches, seen = [], []
        for arm in n.arms:
            test, names = self.labels(subject, arm.labels, scope)
            flow = dict(scope.flow)
            if path and names:
                flow |= self.narrowed(subject.type, path, names)
            inner = scope.within(flow=flow)
            if arm.guard is not None:
                guard, yes, _ = self.test(arm.guard, inner)
                test = both("and", test, guard)
                inner = inner.within(flow=flow | yes)
            branches.append((test, self.block(arm.body, inner)))
            seen += names
        if isinstance(subject.type, (Enum, Option)) and n.other is None and not n.inline:
            missing = [v for v in _variants(subject.type) if v not in seen]
            if missing:
                arms = "{% case " + " | ".join(missing) + " %}"
                raise TemplateSyntaxError(f"match on '{n.expr}' is not exhaustive: missing {', '.join(missing)}; add arms or combined arm: {arms}")
        flow = dict(scope.flow)
        if path and n.other is not None and isinstance(subject.type, (Enum, Option)):
            rest = [v for v in _variants(subject.type) if v not in seen]
            flow |= self.narrowed(subject.type, path, rest) if rest else {}
        other = self.block(n.other, scope.within(flow=flow)) if n.other is not None else N.Const("", STR)
        return choice(branches, other)

    def narrowed(self, kind: VarType, path: str, names: list[str]) -> dict[str, object]:
        if isinstance(kind, Option):
            return {path: kind.inner} if names == ["Some"] else {path: ABSENT} if names == ["None"] else {}
        return {path: OneOf(tuple(names))}

    def labels(self, subject: N.Node, labels: list, scope: Scope) -> tuple[N.Node, list[str]]:
        """The test of an arm, and the variants it names."""
        kind, tests, names = subject.type, [], []
        for label in labels:
            if isinstance(kind, (Enum, Option)):
                variants = _variants(kind)
                if not isinstance(label, S.Path) or len(label.names) > 1:
                    quoted = isinstance(label, (S.Literal, S.Template)) and isinstance(getattr(label, "value", ""), str)
                    raise TemplateSyntaxError(f"case label on {kind} must be a variant name" + (", not a quoted string: remove the quotes" if quoted else ""))
                if str(label) not in variants:
                    raise TemplateSyntaxError(f"unknown variant '{label}' in case: {kind} has {', '.join(variants)}")
                names.append(str(label))
                continue
            if not isinstance(kind, Scalar):
                raise TemplateSyntaxError(f"cannot match on {kind}")
            if isinstance(label, S.Path):
                known = self.lookup(label.names[0], scope) is not None
                got = self.value(label, scope) if known else N.Const(str(label), STR)
                if got.type != kind:  # compared as text
                    tests.append(N.Test("eq", (self.shown(subject, "match"), self.shown(got, "case"))))
                    continue
            else:
                got = self.value(label, scope)
                if got.type != kind and not (kind == FLOAT and got.type == INT):
                    hint = {STR: "quote it", INT: "write a whole number", FLOAT: "write a number", BOOL: "write true or false"}[kind]
                    what = {STR: "quoted string", INT: "numeric literal", FLOAT: "float literal", BOOL: "bool literal"}[got.type]
                    raise TemplateSyntaxError(f"cannot match {kind} with a {what}: {hint}")
                if got.type != kind:
                    got = N.Const(float(got.value), FLOAT)
            tests.append(N.Test("eq", (subject, got)))
        if names:
            return N.Test("has", (subject,)) if names == ["Some"] else N.Test("not", (N.Test("has", (subject,)),)) if names == ["None"] else is_variant(subject, names), names
        got = tests[0]
        for t in tests[1:]:
            got = both("or", got, t)
        return got, []

    # --- includes -----------------------------------------------------------

    def n_include(self, n: S.Include, scope: Scope) -> N.Node:
        if n.loop is None:
            return self.included(n, scope)
        name, expr = n.loop
        over = self.iterable(expr, scope)
        number = self.loop = self.loop + 1
        item = N.Item(number, over.type.item)
        inner = scope.within(names=scope.names | {name: item}, loops=scope.loops | {name: number})
        return N.Loop(number, over, self.included(n, inner, {name: item}, {name: number}), None)

    def included(self, n: S.Include, scope: Scope, items: dict | None = None, loops: dict | None = None) -> N.Node:
        given = {}
        templates = {}
        for name, expr in n.given:
            found = self.template_named(expr, scope)
            if found is not None:
                templates[name] = found[0]
            else:
                given[name] = self.value(expr, scope)
        given |= items or {}
        if n.path is not None:
            return self.by_path(n, scope, given, templates, loops or {})
        unit = scope.unit.inline_of(n.name)
        if unit is None and n.name in scope.templates:
            self.used.add(n.name) if scope.depth == 0 else None
            unit = scope.templates[n.name]
            if unit is None:
                declared = next((d.type for d in scope.unit.head.params if d.name == n.name), None)
                if isinstance(declared, Option):
                    return N.Stop(N.Const(f"template '{n.name}' is None", STR), "type_mismatch")
                return N.Stop(N.Const(f"template '{n.name}' was not given", STR), "missing_params")
        if unit is None:
            if n.name in scope.names:
                raise TemplateSyntaxError(f"'{n.name}' is not a template")
            unit = self.file(f"./{n.name}.tmpl.md", scope)
        if isinstance(unit, Routed):
            key = N.Param(unit.name, STR)
            cases = tuple((name, self.child(u, n.name, scope, given, templates, loops or {})) for name, u in sorted(unit.units.items()))
            return N.Switch(key, cases, N.Stop(key, "include_not_found"))
        return self.child(unit, n.name, scope, given, templates, loops or {})

    def template_named(self, expr, scope: Scope):
        """A template that an argument names: a tuple of it, or None."""
        if isinstance(expr, S.Path) and len(expr.names) == 1:
            name = expr.names[0]
            if name in scope.templates:
                self.used.add(name) if scope.depth == 0 else None
                return (scope.templates[name],)
            if name not in scope.names and scope.unit.inline_of(name):
                return (scope.unit.inline_of(name),)
        return None

    def by_path(self, n: S.Include, scope: Scope, given: dict, templates: dict, loops: dict) -> N.Node:
        open_parts = []

        def fixed(inner: str):
            got = self.value(S.expression(inner, n.line), scope)
            if isinstance(got, N.Const):
                return got.value
            open_parts.append(got)
            return "\0"

        path = interpolate_path(n.path, fixed, "include path")
        if not open_parts:
            strict_path(path, "include path")
            return self.child(self.file(path, scope), path, scope, given, templates, loops)
        # The path depends on the row: one case for each file that it can name.
        strict_path(path, "include path") if not path.startswith("\0") else None
        pieces = path.split("\0")
        whole = text_of([x for pair in zip([N.Const(p, STR) for p in pieces], [*[self.shown(o, "path") for o in open_parts], N.Const("", STR)]) for x in pair])
        base = scope.unit.base_dir or "."
        pattern = re.compile(".*".join(map(re.escape, pieces)))
        cases = []
        for name in (n for n in _files(base) if pattern.fullmatch(n)):
            try:
                body = self.child(self.file(name, scope), name, scope, given, templates, loops)
            except TemplateSyntaxError as e:  # the fault of a file is that of the rows that name it
                body = N.Stop(N.Const(f"in include '{name}': {e.message}", STR), "syntax")
            cases.append((name, body))
        return N.Switch(whole, tuple(cases), N.Stop(whole, "include_not_found"))

    def file(self, path: str, scope: Scope) -> Unit:
        full = os.path.realpath(os.path.join(scope.unit.base_dir or ".", path))
        if self.load is None or not os.path.exists(full):
            raise IncludeNotFound(path)
        try:
            return self.load(full, scope.unit.env)
        except TemplateSyntaxError as e:
            e.file = e.file or path  # its line is one of that file
            raise

    def child(self, unit: Unit, name: str, scope: Scope, given: dict, templates: dict, loops: dict) -> N.Node:
        if scope.depth + 1 > self.max_depth:
            return N.Stop(N.Const(f"maximum include depth exceeded in '{name}'", STR), "syntax")
        head = unit.head
        declared = {d.name: d for d in head.params}
        more = [g for g in (*given, *templates) if g not in declared]
        if more:
            raise TemplateSyntaxError(f"in include '{name}': extra undeclared parameters: {', '.join(more)}")
        names, subs = {}, {}
        for d in head.params:
            if _is_tmpl(d.type):
                if d.name not in templates and d.required and not isinstance(d.type, Option):
                    raise TemplateSyntaxError(f"in include '{name}': missing required parameters: {d.name}")
                subs[d.name] = templates.get(d.name)
                for u in _units(subs[d.name]):
                    self.signature(d.name, d.type, u)
            elif d.name in given:
                got = given[d.name]
                if not fits(d.type, got):
                    raise TemplateSyntaxError(f"in include '{name}': type mismatch for '{d.name}': expected {d.type}, got {got.type}")
                names[d.name] = cast(got, d.type)
            elif d.required:
                raise TemplateSyntaxError(f"in include '{name}': missing required parameters: {d.name}")
            else:
                names[d.name] = N.Const(d.default, d.type)
        inner = Scope(unit, names, subs, {}, dict(loops), scope.depth + 1)
        try:
            return self.block(unit.body.nodes, inner)
        except TemplateSyntaxError as e:
            if e.message.startswith("in include"):
                raise
            told = type(e)(f"in include '{name}': {e.message}", e.line, e.snippet)
            told.file = e.file or (name if name.endswith(".tmpl.md") else None)
            raise told from None

    # --- names --------------------------------------------------------------

    def lookup(self, name: str, scope: Scope) -> N.Node | None:
        unit = scope.unit
        while unit:
            values = unit.head.values()
            if name in values:
                return N.Const(*values[name])
            unit = unit.parent
        if name in scope.names:
            if scope.depth == 0 and isinstance(scope.names[name], N.Param):
                self.used.add(name)
            return scope.names[name]
        return None

    def types_of(self, scope: Scope) -> dict[str, VarType]:
        found, unit = {}, scope.unit
        while unit:
            found = (unit.head.all_types() if unit is scope.unit else unit.head.types) | found
            unit = unit.parent
        return found

    def named_type(self, names: tuple[str, ...], scope: Scope) -> VarType | None:
        """The type that a path names, if it is no value."""
        if self.lookup(names[0], scope) is not None and names[0] in scope.names:
            if len(names) == 1 and names[0] in scope.unit.head.types:
                return scope.unit.head.types[names[0]]
            return None
        if len(names) == 1:
            return self.types_of(scope).get(names[0])
        if len(names) == 2 and names[0] in scope.unit.head.imports:
            return scope.unit.head.imports[names[0]].all_types().get(names[1])
        return None

    def path(self, p: S.Path, scope: Scope, whole: bool = False) -> N.Node:
        names = p.names
        if "__kind__" in names:
            raise TemplateSyntaxError("'__kind__' is internal: use kind()")
        if names[0] in PREFIXES and len(names) > 1 and self.lookup(names[0], scope) is None:
            names = names[1:]
        got = self.lookup(names[0], scope)
        at = 1
        if got is None and names[0] in scope.unit.head.imports:
            stem = scope.unit.head.imports[names[0]]
            values = stem.values()
            if len(names) > 1 and names[1] in values:
                got, at = N.Const(*values[names[1]]), 2
            elif len(names) > 1 and names[1] in stem.all_types():
                raise TemplateSyntaxError(f"'{p}' is an enum literal: write kind({p})")
            else:
                raise TemplateSyntaxError(f"undeclared variable '{p}': import '{names[0]}' has {sorted(values)}")
        if got is None:
            if names[0] in scope.templates:
                raise TemplateSyntaxError(f"'{p}' is a template: use include")
            if names[0] in self.types_of(scope) and len(names) > 1:
                raise TemplateSyntaxError(f"'{p}' is an enum literal: write kind({p})")
            known = [*scope.names, *(d.name for d in (*scope.unit.head.consts, *scope.unit.head.env))]
            near = min(known, key=lambda k: distance(k, names[0]), default=None)
            hint = f": did you mean '{near}'?" if near is not None and distance(near, names[0]) <= NEAR else ""
            raise TemplateSyntaxError(f"undeclared variable '{names[0]}'{hint}")
        key = ".".join(names[:at])
        got = self.flowed(got, key, scope, last=at == len(names) and whole)
        for i in range(at, len(names)):
            got = self.member(got, names[i], key, scope)
            key += "." + names[i]
            got = self.flowed(got, key, scope, last=i == len(names) - 1 and whole)
        return got

    def flowed(self, got: N.Node, key: str, scope: Scope, last: bool) -> N.Node:
        known = scope.flow.get(key)
        if isinstance(known, VarType) and isinstance(got.type, Option):
            return cast(got, known)
        return got

    def member(self, base: N.Node, name: str, key: str, scope: Scope) -> N.Node:
        kind = base.type
        if isinstance(kind, Option):
            raise TemplateSyntaxError(f"'{key}' is {kind} and may be None here: guard it with has({key})" if scope.flow.get(key) != ABSENT else f"'{key}' is None here")
        if isinstance(kind, Struct):
            found = kind.get(name)
            if found is None:
                raise TemplateSyntaxError(f"undefined variable: {key}.{name} (available fields: {', '.join(n for n, _ in kind.fields)})")
            return fold(N.Member(base, name, name, found))
        if isinstance(kind, Enum):
            known = scope.flow.get(key)
            variants = known.names if isinstance(known, OneOf) else tuple(kind.names)
            types = {dict(kind.fields_of(v)).get(name) for v in variants}
            if len(types) != 1 or None in types:
                raise TemplateSyntaxError(f"undefined variable: {key}.{name}: not a field of {' and '.join(variants)}; use match to narrow '{key}'")
            return fold(N.Member(base, name, kind.column_of(variants[0], name), types.pop()))
        raise TemplateSyntaxError(f"undefined variable: {key}.{name}: '{key}' is {kind} and has no fields")

    # --- values -------------------------------------------------------------

    def value(self, e, scope: Scope, whole: bool = False) -> N.Node:
        if isinstance(e, S.Literal):
            v = e.value
            return N.Const(v, {str: STR, bool: BOOL, int: INT, float: FLOAT}[type(v)])
        if isinstance(e, S.Template):
            return text_of([self.shown(self.value(p, scope), "string") for p in e.parts])
        if isinstance(e, S.Path):
            return self.path(e, scope, whole)
        if isinstance(e, S.Call):
            return self.call(e, scope)
        got = self.value(e.base, scope)
        for i, (name, arg) in enumerate(e.filters):
            alone = len(e.filters) == 1 and isinstance(e.base, S.Path)
            got = self.filter(got, name, arg, alone)
        return got

    def filter(self, base: N.Node, name: str, arg, alone: bool) -> N.Node:
        kind = base.type

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise TemplateSyntaxError(f"filter {name} requires a {what}, got {kind}")

        if name in ("upper", "lower", "trim"):
            need(kind == STR, "string")
            return fold(N.Apply(name, base, None, STR))
        if name == "fixed":
            need(kind in NUMBERS, "number")
            return fold(N.Apply("fixed_fast" if alone else "fixed", base, arg, STR))
        if name == "join":
            need(isinstance(kind, List), "list")
            inner = kind.item.inner if isinstance(kind.item, Option) else kind.item
            if not isinstance(inner, Scalar) and not (isinstance(inner, Enum) and inner.plain):
                raise TemplateSyntaxError(f"filter join requires a list of scalars, not of struct, list or tmpl: got {kind}")
            return fold(N.Apply("join", base, arg, STR))
        if name == "limit":
            need(isinstance(kind, List), "list")
            return fold(N.Apply("limit", base, arg, kind))
        need(kind in NUMBERS, "number")
        return fold(N.Apply(name, base, arg, FLOAT if kind == FLOAT or isinstance(arg, float) else INT))

    def call(self, e: S.Call, scope: Scope) -> N.Node:
        names = e.arg.names
        if e.name == "idx":
            if scope.depth == 0 and len(names) == 1 and names[0] in scope.names and names[0] not in scope.loops and isinstance(scope.names[names[0]], N.Param):
                # A template for iterated includes, by itself: an error only if it is rendered.
                self.used.add(names[0])
                return N.Join((N.Stop(N.Const(f"idx({names[0]}) outside of a loop", STR), "undefined_variable"),), INT)
            if len(names) != 1 or names[0] not in scope.loops:
                raise TemplateSyntaxError(f"idx() needs a loop variable, '{e.arg}' is none")
            return N.Index(scope.loops[names[0]], INT)
        if e.name == "kinds":
            kind = self.named_type(names, scope)
            if kind is None and self.lookup(names[0], scope) is not None:
                kind = self.path(e.arg, scope).type
            if not isinstance(kind, Enum):
                raise TemplateSyntaxError(f"kinds() requires an enum type, '{e.arg}' is none")
            return N.Const(kind.names, List(STR))
        if e.name == "kind":
            for cut in (1, 2):
                kind = self.named_type(names[:-1], scope) if len(names) == cut + 1 else None
                if kind is not None:
                    if not isinstance(kind, Enum) or names[-1] not in kind.names:
                        raise TemplateSyntaxError(f"unknown variant '{names[-1]}' of {'.'.join(names[:-1])}")
                    return N.Const(names[-1], STR)
            got = self.path(e.arg, scope, whole=True)
            if not isinstance(got.type, (Enum, Option)):
                raise TemplateSyntaxError(f"kind() requires an enum or option, '{e.arg}' is {got.type}")
            return fold(N.Apply("kind", got, None, STR))
        if e.name == "len":
            got = self.path(e.arg, scope)
            if got.type != STR and not isinstance(got.type, List):
                raise TemplateSyntaxError(f"len() requires a list or string, '{e.arg}' is {got.type}")
            return fold(N.Apply("len", got, None, INT))
        return N.Apply("test", self.test(S.Op("truth", (e,)), scope)[0], None, BOOL)

    def shown(self, got: N.Node, what: str) -> N.Node:
        """As text."""
        kind = got.type.inner if isinstance(got.type, Option) else got.type
        if not isinstance(kind, Scalar) and not (isinstance(kind, Enum) and kind.plain):
            raise TemplateSyntaxError(f"cannot render {got.type} directly" + (f" ('{what}')" if what else ""))
        return got if got.type == STR else fold(N.Apply("text", got, None, STR))

    # --- conditions ---------------------------------------------------------

    def test(self, e: S.Op, scope: Scope) -> tuple[N.Node, dict, dict]:
        """The test, and what holds where it is true and where it is false."""
        if e.name == "not":
            t, yes, no = self.test(e.args[0], scope)
            return negated(t), no, yes
        if e.name in ("and", "or"):
            a, yes, no = self.test(e.args[0], scope)
            known = yes if e.name == "and" else no
            b, yes2, no2 = self.test(e.args[1], scope.within(flow=scope.flow | known))
            got = both(e.name, a, b)
            return (got, yes | yes2, {}) if e.name == "and" else (got, {}, no | no2)
        if e.name == "match":
            if isinstance(e.args[0], S.Call) and e.args[0].name == "kind":
                raise TemplateSyntaxError(f"match on kind() loses the enum: write match {e.args[0].arg}")
            return self.labels(self.value(e.args[0], scope, whole=True), list(e.args[1]), scope)[0], {}, {}
        if e.name == "truth":
            return self.truth(e.args[0], scope)
        if e.name in ("==", "!="):
            got = self.enum_equal(e, scope)
            if got is not None:
                return got, {}, {}
        a, b = self.value(e.args[0], scope), self.value(e.args[1], scope)
        if e.name in ("==", "!="):
            return self.equal(e, a, b), {}, {}
        if e.name == "in":
            return self.inside(e, a, b), {}, {}
        if not (a.type in NUMBERS and b.type in NUMBERS):
            return N.Test("const", (False,)), {}, {}
        a, b = (b, a) if e.name in (">", ">=") else (a, b)
        return fold_test(N.Test("less" if e.name in "<>" else "le", (a, b))), {}, {}

    def truth(self, x, scope: Scope) -> tuple[N.Node, dict, dict]:
        if isinstance(x, S.Call) and x.name == "has":
            got = self.path(x.arg, scope, whole=True)
            key = str(x.arg)
            if not isinstance(got.type, Option):
                if isinstance(scope.flow.get(key), VarType):  # known to be there already
                    return N.Test("const", (True,)), {}, {key: ABSENT}
                raise TemplateSyntaxError(f"has() requires an option, '{key}' is {got.type}")
            return fold_test(N.Test("has", (got,))), {key: got.type.inner}, {key: ABSENT}
        got = self.value(x, scope)
        if isinstance(got.type, (Option, Struct, Enum, Tmpl)):
            kind = type(got.type).__name__.lower()
            raise TemplateSyntaxError(f"cannot evaluate truthiness of {kind}" + (f": use has({x})" if kind == "option" else ""))
        return fold_test(N.Test("truth", (got,))), {}, {}

    def enum_equal(self, e: S.Op, scope: Scope) -> N.Node | None:
        """``value == Type.Variant``, either way round."""
        for x, literal in (e.args, e.args[::-1]):
            kind = self.named_type(literal.names[:-1], scope) if isinstance(literal, S.Path) and len(literal.names) > 1 and self.lookup(literal.names[0], scope) is None else None
            if isinstance(kind, Enum) and literal.names[-1] in kind.names:
                got = self.value(x, scope, whole=True)
                if got.type == kind:
                    same = is_variant(got, [literal.names[-1]])
                    return negated(same) if e.name == "!=" else same
        return None

    def equal(self, e: S.Op, a: N.Node, b: N.Node) -> N.Node:
        inner = [t.inner if isinstance(t, Option) else t for t in (a.type, b.type)]
        if any(isinstance(t, Enum) for t in inner):
            raise TemplateSyntaxError("enum values cannot be compared with == or !=: use match")
        same = N.Test("const", (False,)) if inner[0] != inner[1] else fold_test(N.Test("eq", (a, b)))
        return negated(same) if e.name == "!=" else same

    def inside(self, e: S.Op, a: N.Node, b: N.Node) -> N.Node:
        plain = lambda t: STR if isinstance(t, Enum) and t.plain else t
        kinds = isinstance(e.args[1], S.Call) and e.args[1].name == "kinds"
        if kinds and isinstance(a, N.Const) and a.value not in b.value:
            raise TemplateSyntaxError(f"'{a.value}' is not a variant of {e.args[1].arg}: {', '.join(b.value)}")
        if isinstance(b.type, List):
            item = plain(b.type.item.inner if isinstance(b.type.item, Option) else b.type.item)
            if isinstance(a.type, List):
                return N.Test("subset", (a, b)) if plain(a.type.item) == item else N.Test("const", (False,))
            return fold_test(N.Test("contains", (b, a))) if plain(a.type) == item else N.Test("const", (False,))
        if b.type == STR and a.type == STR:
            return fold_test(N.Test("within", (a, b)))
        if b.type == STR and isinstance(a.type, List) and a.type.item == STR:
            return N.Test("all_within", (a, b))
        raise TemplateSyntaxError(f"cannot test {a.type} in {b.type}")


def distance(a: str, b: str) -> int:
    """Edits from one word to the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _files(base: str) -> list[str]:
    """Template files at or below a directory, as ``./`` paths."""
    found = []
    for folder, _, names in sorted(os.walk(base)):
        found += [os.path.join(".", os.path.relpath(os.path.join(folder, n), base)) for n in sorted(names) if n.endswith(".tmpl.md")]
    return found


# --- building and folding ---------------------------------------------------


def _is_tmpl(kind: VarType) -> bool:
    return isinstance(kind, Tmpl) or (isinstance(kind, Option) and isinstance(kind.inner, Tmpl))


def _variants(kind: VarType) -> list[str]:
    return ["Some", "None"] if isinstance(kind, Option) else kind.names


def fits(want: VarType, got: N.Node) -> bool:
    """The value can be passed where ``want`` is declared; structs may have more fields."""
    return _fits(want, got.type)


def _fits(want: VarType, have: VarType) -> bool:
    if want == have or (want == FLOAT and have == INT):
        return True
    if isinstance(want, Option):
        return _fits(want.inner, have.inner if isinstance(have, Option) else have)
    if isinstance(want, List):
        return isinstance(have, List) and _fits(want.item, have.item)
    if isinstance(want, Struct):
        return isinstance(have, Struct) and all(have.get(n) is not None and _fits(t, have.get(n)) for n, t in want.fields)
    if isinstance(want, Enum) and want.plain:
        return have == STR
    return False


def cast(got: N.Node, kind: VarType) -> N.Node:
    """The same value, known as another type."""
    if got.type == kind:
        return got
    if isinstance(got, N.Const):
        return N.Const(float(got.value) if kind == FLOAT and got.value is not None else got.value, kind)
    if kind == FLOAT and got.type == INT:
        return N.Apply("float", got, None, FLOAT)
    return replace(got, type=kind)


def text_of(parts: list[N.Node]) -> N.Node:
    """One text; constants side by side become one."""
    flat: list[N.Node] = []
    for p in (q for p in parts for q in (p.parts if isinstance(p, N.Join) else (p,))):
        if isinstance(p, N.Const) and p.value == "":
            continue
        if isinstance(p, N.Const) and flat and isinstance(flat[-1], N.Const):
            flat[-1] = N.Const(flat[-1].value + p.value, STR)
        else:
            flat.append(p)
    return N.Const("", STR) if not flat else flat[0] if len(flat) == 1 else N.Join(tuple(flat), STR)


def choice(branches: list[tuple[N.Node, N.Node]], other: N.Node) -> N.Node:
    """Branches that constants decide vanish."""
    kept = []
    for test, body in branches:
        if isinstance(test, N.Test) and test.op == "const":
            if test.args[0]:
                other = body
                break
            continue
        kept.append((test, body))
    return N.Choice(tuple(kept), other) if kept else other


def both(name: str, a: N.Node, b: N.Node) -> N.Node:
    for x, y in ((a, b), (b, a)):
        if x.op == "const":
            return y if x.args[0] == (name == "and") else x if x is a or y.op == "const" else N.Test(name, (a, b))
    return N.Test(name, (a, b))


def negated(t: N.Node) -> N.Node:
    if t.op == "const":
        return N.Test("const", (not t.args[0],))
    return t.args[0] if t.op == "not" else N.Test("not", (t,))


def is_variant(subject: N.Node, names: list[str]) -> N.Node:
    return fold_test(N.Test("is", (subject, tuple(names))))


def fold(node: N.Node) -> N.Node:
    from .interp import value_of

    if isinstance(node.base, N.Const):
        return N.Const(value_of(node, {}), node.type)
    return node


def fold_test(t: N.Node) -> N.Node:
    from .interp import holds

    if all(isinstance(a, N.Const) or not isinstance(a, N.Node) for a in t.args):
        return N.Test("const", (holds(t, {}),))
    return t

