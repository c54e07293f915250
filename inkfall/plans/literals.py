"""Literals of expressions and defaults."""

from __future__ import annotations

import re

from ..errors import TemplateSyntaxError
from .types import BOOL, FLOAT, INT, KIND, STR, Enum, List, Option, Scalar, Struct, VarType, split_top

NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?\Z")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\\"'])", r"\1", text)


def is_quoted(text: str) -> bool:
    """One string literal and nothing more."""
    return bool(re.match(r"\"(\\.|[^\"\\])*\"\Z|'(\\.|[^'\\])*'\Z", text, re.S))


def scalar(text: str) -> tuple[object, Scalar] | None:
    """Value and type of a literal without interpolation, or None."""
    if is_quoted(text):
        return unescape(text[1:-1]), STR
    if text in ("true", "false"):
        return text == "true", BOOL
    if NUMBER.match(text):
        return (float(text), FLOAT) if "." in text else (int(text), INT)
    return None


def default(text: str, kind: VarType, constants, where: str):
    """A default's value; constants: a function from a name to (value, type), or None."""
    text = text.strip()

    def wrong(more: str = "") -> TemplateSyntaxError:
        return TemplateSyntaxError(f"default of '{where}': '{text}' is not a {kind}{more}")

    if isinstance(kind, Option):
        return None if text == "None" else default(text, kind.inner, constants, where)
    found = constants(text) if re.match(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*\Z", text) else None
    if isinstance(kind, Enum):
        if is_quoted(text) and text[1:-1] in kind.names:  # quotes are let pass
            text = text[1:-1]
        m = re.match(r"([A-Za-z_]\w*)\s*(?:\((.*)\))?\Z", text, re.S)
        if m and m[1] in kind.names:
            fields = dict(kind.fields_of(m[1]))
            given = _assigned(m[2] or "", wrong)
            _same_names(fields, given, wrong)
            got = {n: default(given[n], t, constants, f"{where}.{n}") for n, t in fields.items() if n in given or not isinstance(t, Option)}
            got |= {n: None for n in fields if n not in got}
            return {KIND: m[1], **got} if not kind.plain else m[1]
        if found is None and re.match(r"\w+\.\w+\Z", text) and text.split(".")[1] in kind.names:
            raise wrong(": use the bare variant name")
    if found is not None:
        if found[1] != kind:
            raise wrong(f": the constant is a {found[1]}")
        return found[0]
    if isinstance(kind, Scalar):
        got = scalar(text)
        if got and (got[1] == kind or (kind == FLOAT and got[1] == INT)):
            return float(got[0]) if kind == FLOAT else got[0]
        raise wrong(": a string must be quoted" if kind == STR else "")
    if isinstance(kind, List) and text[:1] == "[" and text[-1:] == "]":
        return [default(p, kind.item, constants, f"{where}[{i}]") for i, p in enumerate(split_top(text[1:-1]))]
    if isinstance(kind, List) and re.match(r"kinds\(", text):
        found = constants(text)
        if found is not None and found[1] == kind:
            return found[0]
    if isinstance(kind, Struct) and text[:1] == "{" and text[-1:] == "}":
        given = _assigned(text[1:-1], wrong)
        _same_names(dict(kind.fields), given, wrong)
        return {n: default(given[n], t, constants, f"{where}.{n}") if n in given else None for n, t in kind.fields}
    raise wrong()


def _assigned(text: str, wrong) -> dict[str, str]:
    out = {}
    for part in split_top(text):
        name, sign, value = part.partition("=")
        if not sign:
            raise wrong(": expected 'name = value'")
        out[name.strip()] = value.strip()
    return out


def _same_names(fields: dict, given: dict, wrong) -> None:
    missing = [n for n, t in fields.items() if n not in given and not isinstance(t, Option)]
    more = [n for n in given if n not in fields]
    if missing or more:
        raise wrong(f": missing {missing}" if missing else f": unknown field {more}")
