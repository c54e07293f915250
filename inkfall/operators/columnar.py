"""Rendering of Arrow batches by columns, loops of any depth included.

A loop's elements are the children of its list column: they are laid out once for the batch, its body is made
for all elements of all rows at once, and as a row's elements lie side by side, so do their texts: the row's text is the same
bytes under fewer offsets.  What does not depend on a loop is made outside of it and repeated by index.

All branches are made and then chosen from.  A stop notes the rows that reach it; those, and batches with an operation that has no form by
columns (``Plain``), are rendered row by row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans import interp
from ..plans import tree as N
from ..plans.types import BOOL, FLOAT, INT, KIND, STR, Enum, List, Option, VarType

ARROW = {INT: pa.int64(), FLOAT: pa.float64(), STR: pa.string()}


class Plain(Exception):
    """There is no form by columns."""


@dataclass(eq=False)
class Level:
    """The rows of the batch, or the elements of a loop: ``up`` is each one's place in the level around."""

    n: int
    around: Level | None = None
    up: np.ndarray | None = None
    loop: int = 0
    items: pa.Array | None = None
    index: np.ndarray | None = None

    def chain(self) -> list[Level]:
        return [self] + (self.around.chain() if self.around else [])


class Columnar:
    def __init__(self, params: dict[str, pa.Array], n: int):
        self.params, self.root = params, Level(n)
        self.stopped = np.zeros(n, bool)
        self.made: dict[tuple[N.Node, int], pa.Array] = {}
        self.loops: dict[N.Node, frozenset] = {}

    def render(self, node: N.Node) -> pa.Array:
        return self.full(self.text(node, self.root, None), self.root)

    # --- levels -------------------------------------------------------------

    def full(self, x, level: Level) -> pa.Array:
        return pa.repeat(x, level.n) if isinstance(x, pa.Scalar) else x

    def places(self, level: Level, home: Level) -> np.ndarray:
        """For each of ``level`` its place in ``home``, a level around it."""
        at = np.arange(level.n)
        while level is not home:
            at, level = level.up[at], level.around
        return at

    def home(self, n: N.Node, level: Level) -> Level:
        """The outermost level where all that ``n`` reads is known."""
        if n not in self.loops:
            self.loops[n] = frozenset(x.loop for x in N.walk(n) if isinstance(x, (N.Item, N.Index)))
        return next(x for x in level.chain() if x.around is None or x.loop in self.loops[n])

    # --- values -------------------------------------------------------------

    def value(self, n: N.Node, level: Level):
        if isinstance(n, N.Const):
            if isinstance(n.value, (list, dict)):
                raise Plain
            return pa.scalar(n.value, ARROW.get(n.type))
        home = self.home(n, level)
        if home is not level:
            if (n, id(level)) not in self.made:
                self.made[n, id(level)] = self.full(self.value(n, home), home).take(pa.array(self.places(level, home)))
            return self.made[n, id(level)]
        if (n, id(level)) not in self.made:
            self.made[n, id(level)] = self.at_home(n, level)
        return self.made[n, id(level)]

    def at_home(self, n: N.Node, level: Level):
        if isinstance(n, N.Param):
            return self.plain_type(self.params[n.name], n.type)
        if isinstance(n, N.Item):
            return self.plain_type(level.items, n.type)
        if isinstance(n, N.Index):
            return pa.array(level.index)
        if isinstance(n, N.Member):
            return self.plain_type(pc.struct_field(self.full(self.value(n.base, level), level), [n.column]), n.type)
        if isinstance(n, N.Apply):
            return self.apply(n, level)
        return self.text(n, level, None)

    @staticmethod
    def plain_type(x: pa.Array, kind: VarType) -> pa.Array:
        want = ARROW.get(kind.inner if isinstance(kind, Option) else kind)
        return x.cast(want) if want is not None and x.type != want else x

    @staticmethod
    def mapped(x: pa.Array, run: Callable) -> pa.Array:
        """``run`` once for each different value."""
        coded = x.dictionary_encode()
        made = pa.array([run(v) for v in coded.dictionary.to_pylist()], pa.string())
        return made.take(coded.indices)

    def apply(self, n: N.Apply, level: Level):
        op = n.op
        if op == "test":
            return pa.array(self.test(n.base, level))
        x, kind = self.full(self.value(n.base, level), level), n.base.type
        if op == "text":
            return self.shown(x, kind)
        if op == "kind":
            if isinstance(kind, Option):
                return pc.if_else(x.is_valid(), "Some", "None")
            return x if kind.plain else pc.struct_field(x, [KIND])
        if op == "float":
            return x.cast(pa.float64())
        if op in ("upper", "lower", "trim"):
            if pc.all(pc.string_is_ascii(x)).as_py() is not False:
                return {"upper": pc.ascii_upper, "lower": pc.ascii_lower, "trim": lambda v: pc.ascii_trim(v, " \t\n\r\x0b\x0c")}[op](x)
            return self.mapped(x, {"upper": str.upper, "lower": str.lower, "trim": lambda v: v.strip(interp.SPACE)}[op])
        if op in ("fixed", "fixed_fast"):
            if kind == INT:
                return pc.binary_join_element_wise(x.cast(pa.string()), "." + "0" * n.arg if n.arg else "", "")
            run = interp.fixed_fast if op == "fixed_fast" else interp.fixed_exact
            return self.mapped(x, lambda v: run(v, n.arg))
        if op == "len":
            return (pc.binary_length(x) if kind == STR else pc.list_value_length(x)).cast(pa.int64())
        if op == "limit":
            return pc.list_slice(x, 0, n.arg)
        if op == "join":
            sub = self.elements(x, level, 0)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.ends(x), pa.int32()), self.shown(self.plain_type(sub.items, kind.item), kind.item)), n.arg)
        if n.type == FLOAT:
            y = x.cast(pa.float64())
            return pc.add(y, float(n.arg)) if op == "add" else pc.subtract(y, float(n.arg))
        if op in ("add", "sub") and x.null_count == 0:
            by = n.arg if op == "add" else -n.arg
            v = x.to_numpy(zero_copy_only=False)
            if abs(by) > interp.MAX:
                raise Plain
            near = v > interp.MAX - by if by >= 0 else v < interp.MIN - by
            return pa.array(np.where(near, interp.MAX if by >= 0 else interp.MIN, np.where(near, 0, v) + by))
        raise Plain

    def shown(self, x: pa.Array, kind: VarType):
        inner = kind.inner if isinstance(kind, Option) else kind
        if inner == BOOL:
            x = pc.if_else(x, "true", "false")
        elif inner == INT:
            x = x.cast(pa.string())
        elif inner == FLOAT:
            x = self.mapped(x, interp.show_float)
        elif isinstance(inner, Enum) and not inner.plain:
            x = pc.struct_field(x, [KIND])
        return x.fill_null("") if isinstance(kind, Option) else x

    # --- conditions ---------------------------------------------------------

    def test(self, t: N.Test, level: Level) -> np.ndarray:
        op, args = t.op, t.args
        if op == "const":
            return np.full(level.n, args[0])
        if any(isinstance(x, N.Stop) for x in N.walk(t)):
            raise Plain
        if op == "and":
            return self.test(args[0], level) & self.test(args[1], level)
        if op == "or":
            return self.test(args[0], level) | self.test(args[1], level)
        if op == "not":
            return ~self.test(args[0], level)
        a, kind = self.full(self.value(args[0], level), level), args[0].type
        if op == "has":
            return self.known(a.is_valid())
        if op == "truth":
            if kind == BOOL:
                return self.known(a)
            if kind == STR:
                return self.known(pc.not_equal(pc.binary_length(a), 0))
            return self.known(pc.not_equal(pc.list_value_length(a) if isinstance(kind, List) else a, 0))
        if op == "is":
            return self.known(pc.is_in(a if kind.plain else pc.struct_field(a, [KIND]), pa.array(list(args[1]), pa.string())))
        b, other = self.full(self.value(args[1], level), level), args[1].type
        inner = kind.inner if isinstance(kind, Option) else kind
        if op == "eq" and inner in (INT, STR, BOOL) or op == "eq" and isinstance(inner, Enum) and inner.plain:
            return self.known(pc.equal(a, b)) | self.known(pc.and_(a.is_null(), b.is_null()))
        if op in ("less", "le") and kind in (INT, FLOAT) and other in (INT, FLOAT):
            if kind != other:
                a, b = self.exact(a), self.exact(b)
            return self.known(pc.less(a, b) if op == "less" else pc.less_equal(a, b))
        raise Plain

    @staticmethod
    def exact(x: pa.Array) -> pa.Array:
        """Whole numbers as doubles, if those are exact."""
        if x.type == pa.int64() and len(x) and any(abs(v or 0) > 1 << 53 for v in pc.min_max(x).as_py().values()):
            raise Plain
        return x.cast(pa.float64())

    @staticmethod
    def known(x: pa.Array) -> np.ndarray:
        return x.fill_null(False).to_numpy(zero_copy_only=False)

    # --- texts --------------------------------------------------------------

    def text(self, n: N.Node, level: Level, mask: np.ndarray | None):
        """The text for each of the level; ``mask`` are those whose path leads here, None is all."""
        if isinstance(n, N.Const):
            return pa.scalar(interp.show(n.value))
        if isinstance(n, N.Join):
            made = [self.text(p, level, mask) for p in n.parts]
            if all(isinstance(m, pa.Scalar) for m in made):
                return pa.scalar("".join(m.as_py() for m in made))
            return pc.binary_join_element_wise(*made, "")
        if isinstance(n, N.Choice):
            rest = np.ones(level.n, bool) if mask is None else mask.copy()
            tests, bodies = [], []
            for test, body in n.branches:
                tests.append(self.test(test, level))
                bodies.append(self.text(body, level, rest & tests[-1]))
                rest &= ~tests[-1]
            other = self.text(n.other, level, rest)
            made = pc.case_when(pc.make_struct(*map(pa.array, tests), field_names=[str(i) for i in range(len(tests))]), *bodies, other)
            return self.full(made, level)
        if isinstance(n, N.Loop):
            return self.loop(n, level, mask)
        if isinstance(n, N.Stop):
            at = self.places(level, self.root)
            self.stopped[at if mask is None else at[mask]] = True
            return pa.scalar("")
        if isinstance(n, N.Switch):
            raise Plain
        return self.value(n, level)

    @staticmethod
    def ends(over: pa.Array) -> np.ndarray:
        return np.append(0, np.cumsum(pc.list_value_length(over).fill_null(0).to_numpy(zero_copy_only=False)))

    def elements(self, over: pa.Array, level: Level, number: int) -> Level:
        ends = self.ends(over)
        counts = np.diff(ends)
        up = np.repeat(np.arange(level.n), counts)
        return Level(int(ends[-1]), level, up, number, over.flatten(), np.arange(int(ends[-1])) - np.repeat(ends[:-1], counts))

    def loop(self, n: N.Loop, level: Level, mask: np.ndarray | None):
        over = self.full(self.value(n.over, level), level)
        sub = self.elements(over, level, n.number)
        body = self.full(self.text(n.body, sub, None if mask is None else mask[sub.up]), sub)
        body = pa.concat_arrays([body.cast(pa.string()).fill_null("")])
        if body.offset:
            body = body.take(pa.array(np.arange(len(body))))
        _, offsets, data = body.buffers() if len(body) else (None, None, pa.py_buffer(b""))
        own = np.frombuffer(offsets, np.int32, len(body) + 1) if len(body) else np.zeros(1, np.int32)
        joined = pa.StringArray.from_buffers(level.n, pa.py_buffer(own[self.ends(over)].tobytes()), data or pa.py_buffer(b""))
        if n.other is None:
            return joined
        empty = np.diff(self.ends(over)) == 0
        return pc.if_else(pa.array(empty), self.text(n.other, level, empty if mask is None else mask & empty), joined)


def nested(node: N.Node) -> bool:
    """There is a loop in a loop: by lambdas those are slow."""
    return any(isinstance(x, N.Loop) and any(isinstance(y, N.Loop) for y in N.walk(x.body)) for x in N.walk(node))


def supported(node: N.Node) -> bool:
    """All of the tree has a form by columns, but for numbers too large to compare."""
    for x in N.walk(node):
        if isinstance(x, N.Switch) or isinstance(x, N.Const) and isinstance(x.value, (list, dict)):
            return False
        if isinstance(x, N.Test) and x.op != "const":
            kind = getattr(x.args[0], "type", None)
            inner = kind.inner if isinstance(kind, Option) else kind
            if x.op not in ("and", "or", "not", "has", "truth", "is", "eq", "less", "le") or any(isinstance(y, N.Stop) for y in N.walk(x)):
                return False
            if x.op == "eq" and inner not in (INT, STR, BOOL) and not (isinstance(inner, Enum) and inner.plain):
                return False
    return True


def render(node: N.Node, rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts of a struct array of parameters, and which rows stopped (their texts mean nothing)."""
    names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
    made = Columnar({n: pc.struct_field(rows, [n]) for n in names}, len(rows))
    return made.render(node), made.stopped
