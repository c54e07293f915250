"""The typed tree as one Spark column.

Everything is built from expressions of the catalogue, so Catalyst sees which input columns and
nested fields are read, folds constants, and generates code for templates without loops.

Errors are a channel of their own.  A text that stops raises an error; with ``catch`` it goes on with an empty text, and ``fault`` is a
second column beside it: kind and message of the first stop that the row's path through the tree reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_exact, fixed_fast, less, same_float, saturated, show_float, trim_space
from ..plans import tree as N
from ..plans.types import BOOL, FLOAT, INT, KIND, STR, Enum, List, Option, Struct, VarType, to_spark

#: Nodes up to which a tree becomes one column.
BUDGET = 2000
#: Elements up to which a loop is written out, and nodes that this may add to a column.
SHORT, UNROLLED = 4, 160
PREFIX = {"undefined_variable": "undefined variable: ", "panic": "template panic: ", "include_not_found": "include not found: ", "missing_params": "missing required parameters: ", "type_mismatch": "type mismatch: ", "extra_params": "extra undeclared parameters: ", "invalid_record": "invalid record: ", "syntax": "template syntax error: "}


def constant(value, kind: VarType) -> Column:
    if isinstance(kind, Option):
        return F.lit(None).cast(to_spark(kind.inner)) if value is None else constant(value, kind.inner)
    if isinstance(kind, List):
        return F.array(*[constant(v, kind.item) for v in value]).cast(to_spark(kind)) if value else F.array().cast(to_spark(kind))
    if isinstance(kind, Struct):
        return F.struct(*[constant(value[n], t).alias(n) for n, t in kind.fields])
    if isinstance(kind, Enum) and not kind.plain:
        columns = {kind.column_of(v, n): (v, n, t) for v, fields in kind.variants for n, t in fields}
        mine = {kind.column_of(value[KIND], n): n for n, _ in kind.fields_of(value[KIND])}
        return F.struct(F.lit(value[KIND]).alias(KIND), *[(constant(value[mine[c]], t) if c in mine else F.lit(None).cast(to_spark(t))).alias(c) for c, (_, _, t) in columns.items()])
    return F.lit(value).cast(to_spark(kind)) if kind in (INT, FLOAT) else F.lit(value)


class Lowering:
    def __init__(self, column: Callable[[str], Column], catch: bool):
        self.column, self.catch = column, catch
        self.items: dict[int, tuple[Column, Column]] = {}
        self.bound: dict[N.Node, Column] = {}  # values that are columns already
        self.unrolled = 0

    # --- values -------------------------------------------------------------

    def value(self, n: N.Node) -> Column:
        if isinstance(n, N.Const):
            return constant(n.value, n.type)
        if isinstance(n, N.Param):
            return self.column(n.name)
        if isinstance(n, N.Item):
            return self.items[n.loop][0]
        if isinstance(n, N.Index):
            return self.items[n.loop][1].cast("long")
        if isinstance(n, N.Member):
            return self.value(n.base).getField(n.column)
        if isinstance(n, N.Join):
            return F.concat(*[self.text(p) for p in n.parts])
        if not isinstance(n, N.Apply):
            return self.text(n)
        return self.apply(n)

    def apply(self, n: N.Apply) -> Column:
        if self.bound and n in self.bound:
            return self.bound[n]
        op = n.op
        if op == "test":
            return self.test(n.base)
        x, kind = self.value(n.base), n.base.type
        if op == "text":
            return self.shown(x, kind)
        if op == "kind":
            if isinstance(kind, Option):
                return F.when(x.isNull(), "None").otherwise("Some")
            return x if kind.plain else x.getField(KIND)
        if op == "float":
            return x.cast("double")
        if op in ("upper", "lower"):
            return getattr(F, op)(x)
        if op == "trim":
            return trim_space(x)
        if op in ("fixed", "fixed_fast"):
            if kind == INT:
                return F.concat(x.cast("string"), F.lit("." + "0" * n.arg if n.arg else ""))
            return (fixed_fast if op == "fixed_fast" else fixed_exact)(x, n.arg)
        if op == "join":
            return F.array_join(F.transform(x, lambda v: self.shown(v, kind.item)), n.arg, "")
        if op == "limit":
            return F.slice(x, 1, n.arg)
        if op == "len":
            return (F.octet_length(x) if kind == STR else F.size(x)).cast("long")
        if n.type == FLOAT:
            y = F.lit(float(n.arg))
            return x.cast("double") + y if op == "add" else x.cast("double") - y
        return saturated(x, n.arg, op == "sub")

    def shown(self, x: Column, kind: VarType) -> Column:
        inner = kind.inner if isinstance(kind, Option) else kind
        got = show_float(x) if inner == FLOAT else x if inner == STR or isinstance(inner, Enum) else x.cast("string")
        return F.coalesce(got, F.lit("")) if isinstance(kind, Option) else got

    # --- conditions ---------------------------------------------------------

    def test(self, t: N.Test) -> Column:
        op, args = t.op, t.args
        if op == "const":
            return F.lit(args[0])
        if op == "and":  # in this order, as the right side may stop
            return F.when(self.test(args[0]), self.test(args[1])).otherwise(False) if self.stops(args[1]) else self.test(args[0]) & self.test(args[1])
        if op == "or":
            return F.when(self.test(args[0]), True).otherwise(self.test(args[1])) if self.stops(args[1]) else self.test(args[0]) | self.test(args[1])
        if op == "not":
            return ~self.test(args[0])
        a, kind = self.value(args[0]), args[0].type
        if op == "has":
            return a.isNotNull()
        if op == "truth":
            got = a if kind == BOOL else a != "" if kind == STR else F.size(a) > 0 if isinstance(kind, List) else a != 0
            return F.coalesce(got, F.lit(False))
        if op == "is":
            name = a if kind.plain else a.getField(KIND)
            got = name.isin(list(args[1])) if len(args[1]) > 1 else name == args[1][0]
            return F.coalesce(got, F.lit(False))
        b, other = self.value(args[1]), args[1].type
        if op == "eq":
            inner = kind.inner if isinstance(kind, Option) else kind
            return same_float(a, b) if inner == FLOAT else a.eqNullSafe(b)
        if op in ("less", "le"):
            return less(a, b, (kind == INT, other == INT), op == "le")
        if op == "contains":
            return F.coalesce(F.array_contains(a, b), F.lit(False))
        if op == "subset":
            return F.coalesce(F.forall(a, lambda x: F.coalesce(F.array_contains(b, x), F.lit(False))), F.lit(False))
        if op == "within":
            return F.coalesce(F.contains(b, a), F.lit(False))
        return F.coalesce(F.forall(a, lambda x: F.contains(b, x)), F.lit(False))

    @staticmethod
    def stops(n) -> bool:
        return any(isinstance(x, N.Stop) for x in N.walk(n))

    # --- texts --------------------------------------------------------------

    def text(self, n: N.Node) -> Column:
        if isinstance(n, N.Const):
            return F.lit(n.value)
        if isinstance(n, N.Join):
            return F.concat(*[self.text(p) for p in n.parts])
        if isinstance(n, N.Choice):
            got = None
            for test, body in n.branches:
                got = F.when(self.test(test), self.text(body)) if got is None else got.when(self.test(test), self.text(body))
            return got.otherwise(self.text(n.other))
        if isinstance(n, N.Switch):
            key, other = self.value(n.key), self.text(n.other)
            return searched(key, [(name, self.text(body)) for name, body in n.cases], other)
        if isinstance(n, N.Loop):
            return self.loop(n)
        if isinstance(n, N.Stop):
            return F.lit("") if self.catch else F.raise_error(self.said(n)).cast("string")
        got = self.value(n)
        return got

    def said(self, n: N.Stop) -> Column:
        return F.concat(F.lit(PREFIX[n.kind]), self.text(n.message))

    # --- faults -------------------------------------------------------------

    def fault(self, n: N.Node) -> Column | None:
        """The first stop that is reached, in the order in which texts are made; null if none is, None if there is none."""
        if not self.stops(n):
            return None
        if isinstance(n, N.Stop):
            return _first(self.fault(n.message), F.struct(F.lit(n.kind).alias("kind"), self.said(n).alias("message")))
        if isinstance(n, N.Choice):
            got = self.fault(n.other)
            for test, body in reversed(n.branches):
                inside = self.fault(body)
                chosen = NO_FAULT() if inside is None else inside
                got = _first(self.fault(test), F.when(self.test(test), chosen).otherwise(NO_FAULT() if got is None else got))
            return got
        if isinstance(n, N.Switch):
            key, names = self.value(n.key), [name for name, _ in n.cases]
            cases = [(name, found) for name, body in n.cases for found in [self.fault(body)] if found is not None]
            inside, other = searched(key, cases, NO_FAULT()) if cases else NO_FAULT(), self.fault(n.other)
            told = F.when(key.isin(names), inside).otherwise(other) if names and other is not None else inside if other is None else other
            return _first(self.fault(n.key), told)
        if isinstance(n, N.Loop):
            over, found = self.value(n.over), [self.fault(n.over)]
            if self.stops(n.body):

                def body(x: Column, i: Column) -> Column:
                    self.items[n.number] = (x, i)
                    return self.fault(n.body)

                found.append(F.get(F.filter(F.transform(over, body), lambda f: f.isNotNull()), F.lit(0)))
            if n.other is not None and self.stops(n.other):
                found.append(F.when(F.size(over) == 0, self.fault(n.other)))
            return _first(*found)
        if isinstance(n, N.Test) and n.op in ("and", "or"):
            a, b = n.args
            other = self.fault(b)
            reached = self.test(a) if n.op == "and" else ~self.test(a)
            return _first(self.fault(a), None if other is None else F.when(reached, other))
        return _first(*map(self.fault, N.children(n)))

    def loop(self, n: N.Loop) -> Column:
        over = self.value(n.over)
        around = self.around(n)
        if around is not None:  # no lambda: stays in generated code
            before, after = around
            joined = F.concat(F.lit(before), F.array_join(over, after + before), F.lit(after))
            return F.when(F.size(over) > 0, joined).otherwise(F.lit("") if n.other is None else self.text(n.other))

        def body(x: Column, i: Column) -> Column:
            self.items[n.number] = (x, i)
            return self.text(n.body)

        got = F.array_join(F.transform(over, body), "", "")
        if self.unrolls(n):
            # Short lists by generated code, element by element; lambdas are interpreted.
            size = F.size(over)
            each = [F.when(size > k, F.coalesce(body(F.get(over, F.lit(k)), F.lit(k)), F.lit(""))).otherwise("") for k in range(SHORT)]
            got = F.when(size <= SHORT, F.concat(*each)).otherwise(got)
        return got if n.other is None else F.when(F.size(over) == 0, self.text(n.other)).otherwise(got)

    def unrolls(self, n: N.Loop) -> bool:
        """Small bodies without loops, as long as the column stays small."""
        nodes = N.size(n.body)
        if any(isinstance(x, N.Loop) for x in N.walk(n.body)) or self.unrolled + SHORT * nodes > UNROLLED:
            return False
        self.unrolled += SHORT * nodes
        return True

    @staticmethod
    def around(n: N.Loop) -> tuple[str, str] | None:
        """The constants before and after the element, if that is all of a body over texts."""
        parts = n.body.parts if isinstance(n.body, N.Join) else (n.body,)
        items = [i for i, p in enumerate(parts) if isinstance(p, N.Item) and p.loop == n.number and p.type == STR]
        if len(items) != 1 or not all(isinstance(p, N.Const) for i, p in enumerate(parts) if i != items[0]):
            return None
        if not isinstance(n.over.type, List) or n.over.type.item != STR:
            return None
        return "".join(p.value for p in parts[: items[0]]), "".join(p.value for p in parts[items[0] + 1 :])


def searched(key: Column, cases: list[tuple[str, Column]], other: Column) -> Column:
    """The column of the case that ``key`` names, by halves: texts are in the order of their bytes."""
    cases = sorted(cases, key=lambda c: c[0].encode("utf-8"))

    def between(lo: int, hi: int) -> Column:
        if hi - lo <= 4:
            got = None
            for name, made in cases[lo:hi]:
                got = F.when(key == name, made) if got is None else got.when(key == name, made)
            return other if got is None else got.otherwise(other)
        mid = (lo + hi) // 2
        return F.when(key < cases[mid][0], between(lo, mid)).otherwise(between(mid, hi))

    return between(0, len(cases))


def NO_FAULT() -> Column:
    return F.lit(None).cast("struct<kind:string,message:string>")


def _first(*faults: Column | None) -> Column | None:
    found = [f for f in faults if f is not None]
    return F.coalesce(*found) if found else None


def lower(node: N.Node, column: Callable[[str], Column]) -> Column:
    return Lowering(column, False).text(node).cast("string")


def lower_caught(node: N.Node, column: Callable[[str], Column]) -> tuple[Column, Column | None]:
    """The text, to be used where there is no fault, and the fault."""
    made = Lowering(column, True)
    return made.text(node).cast("string"), made.fault(node)
