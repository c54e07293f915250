"""Types of parameters, their text form, Spark form, and checks of Python values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import TemplateSyntaxError, TypeMismatch

#: Names that mean something in the language.
BUILTIN_TYPES = ("str", "bool", "int", "float", "list", "struct", "enum", "tmpl", "option", "params")
RESERVED = (*BUILTIN_TYPES, "true", "false", "Some", "None", "_", "__kind__", "__variants__", "__self", "__Self", "__super", "__crate")
KIND = "__kind__"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class VarType:
    scalar = False


@dataclass(frozen=True)
class Scalar(VarType):
    name: str
    scalar = True

    def __str__(self):
        return self.name


STR, BOOL, INT, FLOAT = (Scalar(n) for n in ("str", "bool", "int", "float"))
SCALARS = {t.name: t for t in (STR, BOOL, INT, FLOAT)}
NUMBERS = (INT, FLOAT)


@dataclass(frozen=True)
class Struct(VarType):
    fields: tuple[tuple[str, VarType], ...]

    def get(self, name: str) -> VarType | None:
        return dict(self.fields).get(name)

    def __str__(self):
        return f"struct({_fields(self.fields)})"


@dataclass(frozen=True)
class List(VarType):
    item: VarType

    def __str__(self):
        return f"list({_fields(self.item.fields)})" if isinstance(self.item, Struct) else f"list({self.item})"


@dataclass(frozen=True)
class Enum(VarType):
    variants: tuple[tuple[str, tuple[tuple[str, VarType], ...]], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.variants]

    @property
    def plain(self) -> bool:
        """No variant has fields."""
        return not any(f for _, f in self.variants)

    def fields_of(self, variant: str) -> tuple[tuple[str, VarType], ...]:
        return dict(self.variants)[variant]

    def column_of(self, variant: str, name: str) -> str:
        """The struct field that holds a variant's field; variants that disagree on a type have one each."""
        kinds = {t for _, fields in self.variants for n, t in fields if n == name}
        return name if len(kinds) == 1 else f"{variant}__{name}"

    def __str__(self):
        return "enum(" + ", ".join(n + (f"({_fields(f)})" if f else "") for n, f in self.variants) + ")"


@dataclass(frozen=True)
class Option(VarType):
    inner: VarType

    def __str__(self):
        return f"option({self.inner})"


@dataclass(frozen=True)
class Tmpl(VarType):
    fields: tuple[tuple[str, VarType], ...] = field(default=())

    def __str__(self):
        return f"tmpl({_fields(self.fields)})"


def _fields(fields) -> str:
    return ", ".join(f"{n} = {t}" for n, t in fields)


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("_"))


# --- text -------------------------------------------------------------------


def split_top(text: str, separator: str = ",") -> list[str]:
    """Split outside of quotes and brackets; empty text has no pieces."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'" and not (c == "'" and i and text[i - 1].isalnum()):
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and text.startswith(separator, i):
            out.append(text[last:i])
            i += len(separator)
            last = i
            continue
        i += 1
    if depth:
        raise TemplateSyntaxError(f"unbalanced brackets: expected ')' in '{text}'")
    out.append(text[last:])
    pieces = [p.strip() for p in out]
    return [] if pieces == [""] else pieces


def parse_type(text: str, aliases) -> VarType:
    """aliases: a function from a name (``Alias``, ``stem.Type``) to a type, or None."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1].strip()
    if text in SCALARS:
        return SCALARS[text]
    m = re.match(r"(list|struct|enum|option|tmpl)\s*\((.*)\)\Z", text, re.S)
    if not m:
        if re.match(r"(list|struct|enum|option|tmpl)\s*([<(].*)?\Z", text, re.S):
            raise TemplateSyntaxError(f"compound type must be written with parentheses: '{text}'")
        found = aliases(text)
        if found is None:
            raise TemplateSyntaxError(f"unknown type '{text}'")
        return found
    kind, inner = m[1], m[2].strip()
    if kind == "option":
        return Option(parse_type(inner, aliases))
    if kind == "enum":
        return _parse_enum(inner, aliases)
    parts = split_top(inner)
    named = [_named(p) for p in parts]
    if kind == "list" and len(parts) == 1 and named[0] is None:
        if re.match(r"struct\s*\(", parts[0]):
            raise TemplateSyntaxError("list(struct(...)) is redundant: write list(field = type, ...)")
        return List(parse_type(parts[0], aliases))
    if kind == "list" and not parts:
        raise TemplateSyntaxError("list() needs an element type")
    if any(n is None for n in named):
        raise TemplateSyntaxError(f"expected 'field = type' in '{text}'")
    fields = tuple((n, parse_type(t, aliases)) for n, t in named)
    for n, _ in fields:
        if n in RESERVED and n.startswith("__"):
            raise TemplateSyntaxError(f"reserved keyword used as name: '{n}'")
    twice = {n for n, _ in fields if [m for m, _ in fields].count(n) > 1}
    if twice:
        raise TemplateSyntaxError(f"duplicate field '{sorted(twice)[0]}' in '{text}'")
    return {"struct": Struct, "tmpl": Tmpl}[kind](fields) if kind != "list" else List(Struct(fields))


def _named(part: str) -> tuple[str, str] | None:
    m = re.match(r"([A-Za-z_]\w*)\s*=\s*(?!=)(.+)\Z", part, re.S)
    return (m[1], m[2].strip()) if m else None


def _parse_enum(inner: str, aliases) -> Enum:
    variants = []
    for part in split_top(inner):
        m = re.match(r"([A-Za-z_]\w*)\s*(?:\((.*)\))?\Z", part, re.S)
        if not m:
            raise TemplateSyntaxError(f"malformed enum variant '{part}'")
        named = [_named(p) for p in split_top(m[2] or "")]
        if None in named:
            raise TemplateSyntaxError(f"expected 'field = type' in enum variant '{part}'")
        variants.append((m[1], tuple((n, parse_type(t, aliases)) for n, t in named)))
    if not variants:
        raise TemplateSyntaxError("enum() needs at least one variant")
    if len({n for n, _ in variants}) < len(variants):
        raise TemplateSyntaxError(f"duplicate enum variant in 'enum({inner})'")
    return Enum(tuple(variants))


# --- Spark ------------------------------------------------------------------


def to_spark(kind: VarType) -> T.DataType:
    if isinstance(kind, Scalar):
        return {"str": T.StringType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType()}[kind.name]
    if isinstance(kind, Option):
        return to_spark(kind.inner)
    if isinstance(kind, List):
        return T.ArrayType(to_spark(kind.item), isinstance(kind.item, Option))
    if isinstance(kind, Struct):
        return T.StructType([T.StructField(n, to_spark(t), isinstance(t, Option)) for n, t in kind.fields])
    if isinstance(kind, Enum):
        if kind.plain:
            return T.StringType()
        columns = {kind.column_of(v, n): t for v, fields in kind.variants for n, t in fields}
        return T.StructType([T.StructField(KIND, T.StringType(), False)] + [T.StructField(n, to_spark(t), True) for n, t in columns.items()])
    raise TemplateSyntaxError(f"{kind} has no column form: pass a template")


_WIDER = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "str": (T.StringType,),
    "bool": (T.BooleanType,),
}


def check_spark(kind: VarType, have: T.DataType, path: str) -> None:
    """The column can serve as this type; more struct fields than declared are fine."""
    if isinstance(kind, Option):
        return None if isinstance(have, T.NullType) else check_spark(kind.inner, have, path)
    if isinstance(kind, Scalar):
        if not isinstance(have, _WIDER[kind.name]):
            raise TypeMismatch(path, str(kind), have.simpleString())
    elif isinstance(kind, List):
        if not isinstance(have, T.ArrayType):
            raise TypeMismatch(path, str(kind), have.simpleString())
        check_spark(kind.item, have.elementType, f"{path}[]")
    elif isinstance(kind, Enum) and kind.plain:
        if isinstance(have, T.StructType) and KIND in have.names:
            raise TypeMismatch(path, str(kind), have.simpleString())
        check_spark(STR, have, path)
    elif isinstance(kind, (Struct, Enum)):
        if not isinstance(have, T.StructType):
            raise TypeMismatch(path, str(kind), have.simpleString())
        want = kind.fields if isinstance(kind, Struct) else [(KIND, STR)] + [(kind.column_of(v, n), t) for v, fields in kind.variants for n, t in fields]
        for name, t in want:
            if name not in have.names:
                raise TypeMismatch(f"{path}.{name}", str(t), "missing")
            check_spark(t, have[name].dataType, f"{path}.{name}")
    return None


# --- Python values ----------------------------------------------------------


def type_name(value: object) -> str:
    names = {bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "struct", type(None): "none"}
    return names.get(type(value), type(value).__name__)


def check_value(kind: VarType, value: object, path: str) -> object:
    """The value as the type has it (an int as a float where one is declared), or TypeMismatch."""

    def wrong():
        return TypeMismatch(path, str(kind), type_name(value), "()" if value is None else value)

    if isinstance(kind, Option):
        return None if value is None else check_value(kind.inner, value, path)
    if isinstance(kind, Scalar):
        if kind == FLOAT and type(value) is int:
            return float(value)
        if {"str": str, "bool": bool, "int": int, "float": float}[kind.name] is not type(value):
            raise wrong()
        if kind == INT and not -(1 << 63) <= value < 1 << 63:
            raise wrong()
        return value
    if isinstance(kind, List):
        if not isinstance(value, (list, tuple)):
            raise wrong()
        return [check_value(kind.item, v, f"{path}[{i}]") for i, v in enumerate(value)]
    if isinstance(kind, Struct):
        value = value.asDict() if hasattr(value, "asDict") else value
        if not isinstance(value, dict):
            raise wrong()
        return {n: check_value(t, _member(value, n, t, path), f"{path}.{n}") for n, t in kind.fields}
    if isinstance(kind, Enum):
        value = value.asDict() if hasattr(value, "asDict") else value
        name = value.get(KIND) if isinstance(value, dict) else value
        if not isinstance(name, str) or name not in kind.names:
            raise wrong()
        fields = kind.fields_of(name)
        if fields and not isinstance(value, dict):
            raise wrong()
        got = {n: check_value(t, _member(value, kind.column_of(name, n) if kind.column_of(name, n) in value else n, t, path), f"{path}.{n}") for n, t in fields}
        return {KIND: name, **got} if not kind.plain else name
    return value


def _member(value: dict, name: str, kind: VarType, path: str):
    if name not in value:
        if isinstance(kind, Option):
            return None
        raise TypeMismatch(f"{path}.{name}", str(kind), "missing")
    return value[name]
