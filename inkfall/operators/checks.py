"""Checks of column values against declared types, as columns.

``Columns`` checks native columns: a value that is no option is not null, names a variant of its enum,
and so do its fields and elements, at any depth.  What Spark's schema rules out already is not looked at.
``Records`` does the same for the variants of parsed records, whose kinds must fit as well, and
takes the values out of them.

A check has two parts: ``bad``, a cheap test for every row (None where nothing can be wrong), and ``what``, text
for rows that fail it: where inside of the value, what was expected, and what is there."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.types import BOOL, FLOAT, INT, KIND, STR, Enum, List, Option, Scalar, Struct, VarType, to_spark

Found = list[tuple[Column, Column]]


def _mismatch(where: str, kind: VarType, actual: Column) -> Column:
    return F.concat(F.lit(f"{where}': expected {kind}, got "), actual)


def _any(tests) -> Column | None:
    tests = [t for t in tests if t is not None]
    return reduce(or_, tests) if tests else None


def _first(found: Found) -> Column:
    """The text of the first test that holds."""
    return F.coalesce(*[F.when(test, text) for test, text in found])


def _at(where: str, items: Column, bad, what) -> Column:
    """The text of the first bad element, with its index."""
    told = F.transform(items, lambda x, i: F.when(bad(x), F.concat(F.lit(f"{where}["), i.cast("string"), F.lit("]"), what(x))))
    return F.get(F.filter(told, lambda m: m.isNotNull()), F.lit(0))


class Columns:
    """Native columns, with what Spark knows of them: type and whether they can be null."""

    def found(self, kind: VarType, x: Column, have: T.DataType, nullable: bool, where: str = "") -> Found:
        """The tests that a value can fail, with their texts."""
        if isinstance(kind, Option):
            return [(x.isNotNull() & test, text) for test, text in self.found(kind.inner, x, have, False, where)]
        out: Found = [(x.isNull(), _mismatch(where, kind, F.lit("none ()")))] if nullable else []
        if isinstance(kind, Enum):
            out += self.variant(kind, x, have, where)
        elif isinstance(kind, Struct) and isinstance(have, T.StructType):
            for name, t in kind.fields:
                out += self.found(t, x.getField(name), have[name].dataType, have[name].nullable, f"{where}.{name}")
        elif isinstance(kind, List) and isinstance(have, T.ArrayType):
            def inner(e: Column) -> Found:
                return self.found(kind.item, e, have.elementType, have.containsNull)

            if inner(x):
                out.append((F.exists(x, lambda e: _any(t for t, _ in inner(e))), _at(where, x, lambda e: _any(t for t, _ in inner(e)), lambda e: _first(inner(e)))))
        return out

    def variant(self, kind: Enum, x: Column, have: T.DataType, where: str) -> Found:
        name = x if kind.plain else x.getField(KIND)
        shown = F.concat(F.lit("str ("), F.coalesce(name, F.lit("")), F.lit(")"))
        out: Found = [(~F.coalesce(name.isin(kind.names), F.lit(False)), _mismatch(where, kind, shown))]
        if not kind.plain and isinstance(have, T.StructType):
            for variant, fields in kind.variants:
                for n, t in fields:
                    c = kind.column_of(variant, n)
                    out += [((name == variant) & test, text) for test, text in self.found(t, x.getField(c), have[c].dataType, have[c].nullable, f"{where}.{n}")]
        return out


class Records:
    """Variants, as ``parse_json`` gives them."""

    ITEMS, MEMBERS = "array<variant>", "map<string,variant>"

    def found(self, kind: VarType, v: Column, where: str = "", shape: Column | None = None) -> Found:
        """``shape``: the schema of ``v``, where it is at hand."""
        if isinstance(kind, Option):
            return [(v.isNotNull() & ~F.is_variant_null(v) & test, text) for test, text in self.found(kind.inner, v, where, shape)]
        out: Found = [(v.isNull(), F.lit(f"{where}': expected {kind}, got missing ()"))]
        shape = F.schema_of_variant(v) if shape is None else shape
        wrong = _mismatch(where, kind, self.shown(v, shape))
        if isinstance(kind, Scalar):
            out.append((~self.fits(kind, shape), wrong))
        elif isinstance(kind, List):
            items = v.try_cast(self.ITEMS)
            inner = lambda e: self.found(kind.item, e)
            out.append((items.isNull(), wrong))
            out.append((F.exists(items, lambda e: _any(t for t, _ in inner(e))), _at(where, items, lambda e: _any(t for t, _ in inner(e)), lambda e: _first(inner(e)))))
        elif isinstance(kind, Struct):
            members = v.try_cast(self.MEMBERS)
            out.append((members.isNull(), wrong))
            for n, t in kind.fields:
                out += self.found(t, F.try_element_at(members, F.lit(n)), f"{where}.{n}")
        elif isinstance(kind, Enum):
            members, name = self.named(v)
            unit = [n for n, fields in kind.variants if not fields]
            out.append((~F.coalesce(name.isin(kind.names), F.lit(False)) | (members.isNull() & ~F.coalesce(name.isin(unit), F.lit(False))), wrong))
            for variant, fields in kind.variants:
                for n, t in fields:
                    out += [((name == variant) & test, text) for test, text in self.found(t, F.try_element_at(members, F.lit(n)), f"{where}.{n}")]
        return out

    def named(self, v: Column) -> tuple[Column, Column]:
        """Members, and the name of the variant: the value itself or its ``__kind__``."""
        members = v.try_cast(self.MEMBERS)
        own = F.coalesce(F.try_element_at(members, F.lit(KIND)), v)
        return members, F.when(F.schema_of_variant(own) == "STRING", own.try_cast("string"))

    @staticmethod
    def fits(kind: Scalar, shape: Column) -> Column:
        if kind == FLOAT:
            return shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
        return shape == {STR: "STRING", INT: "BIGINT", BOOL: "BOOLEAN"}[kind]

    @staticmethod
    def shown(v: Column, shape: Column) -> Column:
        name = F.when(shape == "STRING", "str").when(shape == "BIGINT", "int").when(shape == "BOOLEAN", "bool").when(shape == "VOID", "none")
        name = name.when(shape.startswith("ARRAY"), "list").when(shape.startswith("OBJECT"), "struct").otherwise("float")
        value = F.when(shape == "STRING", v.try_cast("string")).when(shape == "VOID", "").otherwise(F.to_json(v))
        return F.concat(name, F.lit(" ("), value, F.lit(")"))

    def value(self, kind: VarType, v: Column) -> Column:
        """The value, in which nothing has been found wrong, as the type's column."""
        if isinstance(kind, Option):
            return F.when(~F.is_variant_null(v), self.value(kind.inner, v))
        if isinstance(kind, Scalar):
            return v.try_cast(to_spark(kind))
        if isinstance(kind, List):
            return F.transform(v.try_cast(self.ITEMS), lambda e: self.value(kind.item, e))
        members, name = self.named(v)
        if isinstance(kind, Struct):
            made = F.struct(*[self.value(t, F.try_element_at(members, F.lit(n))).alias(n) for n, t in kind.fields])
            return F.when(members.isNotNull(), made)
        if kind.plain:
            return name
        fields = {kind.column_of(variant, n): [] for variant, fs in kind.variants for n, _ in fs}
        kinds = {}
        for variant, fs in kind.variants:
            for n, t in fs:
                kinds[kind.column_of(variant, n)] = t
                fields[kind.column_of(variant, n)].append((variant, n))
        columns = []
        for c, owners in fields.items():
            own = F.when(name.isin([variant for variant, _ in owners]), F.try_element_at(members, F.lit(owners[0][1])))
            columns.append(self.value(kinds[c], own).alias(c))
        return F.when(name.isNotNull(), F.struct(name.alias(KIND), *columns))
