"""Large trees as several projections, so that a text of any size is made by generated code.

One column of thousands of nodes is a method that the JVM refuses, and interpreting it is slow.  Here
a tree is cut into pieces of PIECE nodes, each a column of its own (and a method of its own in the generated code), and the text
is put together of them afterwards.  The branches of a large choice are chosen once, as a number in an earlier projection;
the pieces of a branch are made only for rows that have its number, so a stop is reached by the rows whose path leads there.
Loops are not cut: their bodies are lambdas.  Values that are shown more than once are made once, in the first projection.

A projection must not be merged with the one before it, which the optimizer does unless that would repeat work: the first piece of each projection is
named twice by the next."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import tree as N
from ..plans.types import FLOAT
from .lower import Lowering, searched

#: Nodes of a piece: its method is small enough for the JVM to compile.
PIECE = 40
#: Small branches of a choice that share a column.
CASES = 32
#: Values that are made of their operand by a search, a format or a list.
COSTLY = {"trim", "fixed", "fixed_fast", "join"}


@dataclass
class Level:
    """The columns of one projection."""

    columns: dict[str, Column] = field(default_factory=dict)


class Staging:
    def __init__(self, lowering: Lowering, prefix: str):
        self.lowering, self.prefix = lowering, prefix
        self.levels: list[Level] = []
        self.count = 0
        self.sizes: dict[int, int] = {}

    def size(self, n: N.Node) -> int:
        key = id(n)
        if key not in self.sizes:
            self.sizes[key] = 1 + sum(map(self.size, N.children(n)))
        return self.sizes[key]

    def bind(self, node: N.Node) -> None:
        """Columns for the values that occur more than once and cost something, outside of loops."""
        seen: Counter = Counter(x for x in N.walk(node) if isinstance(x, N.Apply) and (x.op in COSTLY or (x.op == "text" and x.base.type == FLOAT)))
        for value, times in seen.items():
            if times > 1 and not any(isinstance(x, (N.Item, N.Index, N.Stop)) for x in N.walk(value)):
                self.lowering.bound[value] = self.put(0, self.lowering.value(value))

    def put(self, level: int, made: Column) -> Column:
        """A column of the level's projection, as later ones name it."""
        while len(self.levels) <= level:
            self.levels.append(Level())
        name = f"{self.prefix}{self.count}"
        self.count += 1
        self.levels[level].columns[name] = made
        return F.col(name)

    def text(self, n: N.Node, level: int, guard: Column | None) -> Column:
        """The text of ``n`` from columns of projections from ``level`` on, made for rows that ``guard`` lets through."""
        if self.size(n) <= PIECE or not isinstance(n, (N.Join, N.Choice, N.Switch)):
            return self.piece(n, level, guard)
        if isinstance(n, N.Join):
            made, run = [], []
            for part in (*n.parts, None):
                if part is not None and self.size(part) <= PIECE and sum(map(self.size, run)) + self.size(part) <= PIECE:
                    run.append(part)
                    continue
                if run:
                    made.append(self.piece(N.Join(tuple(run), n.type), level, guard))
                run = [part] if part is not None and self.size(part) <= PIECE else []
                if part is not None and not run:
                    made.append(self.text(part, level, guard))
            return F.concat(*made)
        if isinstance(n, N.Switch):
            bodies = [*(b for _, b in n.cases), n.other]
            chosen = searched(self.lowering.value(n.key), [(name, F.lit(i)) for i, (name, _) in enumerate(n.cases)], F.lit(len(n.cases)))
        else:
            bodies, chosen = [*(b for _, b in n.branches), n.other], None
            for i, (test, _) in enumerate(n.branches):
                holds = self.lowering.test(test)
                chosen = F.when(holds, i) if chosen is None else chosen.when(holds, i)
            chosen = chosen.otherwise(len(n.branches))
        at = self.put(level, chosen if guard is None else F.when(guard, chosen))
        got, few = None, []
        for i, body in enumerate([*bodies, None]):
            small = body is not None and self.size(body) <= PIECE
            if small:
                few.append((i, body))
            if few and (len(few) == CASES or not small):
                # Small bodies share a column: a row has one of them.
                made = None
                for k, b in few:
                    text = self.lowering.text(b).cast("string")
                    made = F.when(at == k, text) if made is None else made.when(at == k, text)
                inside = (at >= few[0][0]) & (at <= few[-1][0])
                made = self.put(level + 1, F.when(inside, made))
                got = F.when(inside, made) if got is None else got.when(inside, made)
                few = []
            if body is not None and not small:
                made = self.text(body, level + 1, at == i)
                got = F.when(at == i, made) if got is None else got.when(at == i, made)
        return got

    def piece(self, n: N.Node, level: int, guard: Column | None) -> Column:
        if isinstance(n, N.Const):
            return F.lit(n.value)
        made = self.lowering.text(n).cast("string")
        return self.put(level, made if guard is None else F.when(guard, made))


def with_text(df: DataFrame, node: N.Node, lowering: Lowering, out: str, prefix: str, guard: Column | None = None) -> DataFrame:
    """``df`` with the text of ``node`` as ``out``, for rows that ``guard`` lets through.  Columns that start with ``prefix`` come and go."""
    staging = Staging(lowering, prefix)
    if guard is not None:
        guard = staging.put(0, guard)
    staging.bind(node)
    text = staging.text(node, len(staging.levels), guard)
    names: list[str] = []
    for level in staging.levels:
        df = df.withColumns(level.columns | ({f"{prefix}same{len(names)}": _twice(names[-1])} if names else {}))
        names += [n for n in df.columns if n.startswith(prefix) and n not in names and n not in level.columns] + list(level.columns)
    if names:
        text = F.when(_twice(names[-1]), text)
    return df.withColumn(out, text).drop(*names)


def _twice(name: str) -> Column:
    """True, and names the column two times, so that the optimizer does not write the column's expression out in its place."""
    return F.col(name).isNull() | (F.length(F.col(name).cast("string")) >= 0)
