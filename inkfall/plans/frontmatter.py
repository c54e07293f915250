"""Front matter: the declarations between the ``---`` lines."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from ..errors import TemplateIOError, TemplateSyntaxError, TypeMismatch
from . import literals
from .types import NAME, RESERVED, Enum, List, STR, Scalar, Tmpl, VarType, check_value, parse_type, pascal, split_top

BLOCKS = ("params", "env", "consts", "types", "imports")
NONE = object()


@dataclass
class Decl:
    name: str
    type: VarType
    default: object = NONE
    alias: str | None = None  # the text of the type, where it is a name

    @property
    def required(self) -> bool:
        return self.default is NONE


@dataclass
class Header:
    name: str | None = None
    description: str | None = None
    allow_unused: bool = False
    params: list[Decl] = field(default_factory=list)
    env: list[Decl] = field(default_factory=list)
    consts: list[Decl] = field(default_factory=list)
    types: dict[str, VarType] = field(default_factory=dict)
    used_types: set[str] = field(default_factory=set)
    imports: dict[str, "Header"] = field(default_factory=dict)

    def values(self) -> dict[str, tuple[object, VarType]]:
        """Constants and environment values by name."""
        return {d.name: (d.default, d.type) for d in (*self.env, *self.consts)}

    def all_types(self) -> dict[str, VarType]:
        """Declared types, and those of compound parameters and constants under their names."""
        implicit = {}
        for d in (*self.params, *self.consts, *self.env):
            if not isinstance(d.type, (Scalar, Tmpl)):
                implicit[d.name] = implicit[pascal(d.name)] = d.type
        return implicit | self.types


def split_source(source: str) -> tuple[str, str, int]:
    """Front matter, body, and the number of lines before the body."""
    source = source.replace("\r\n", "\n")
    m = re.match(r"\s*---[ \t]*\n(?:(.*?)\n)??---[ \t]*(?:\n|\Z)", source, re.S)
    if not m:
        raise TemplateSyntaxError("front matter must stand between --- lines")
    return m[1] or "", source[m.end() :], source[: m.end()].count("\n")


def entries(text: str) -> dict[str, str | list[str]]:
    """Keys with a scalar, or with the items of an inline or block list."""
    out: dict[str, str | list[str]] = {}
    key, in_list, blank = None, False, False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            blank = blank or not bare
            continue
        top = re.match(r"([A-Za-z_]\w*):(?:\s+(.*)|)\Z", line)
        if top and not line[0].isspace():
            if in_list and not blank:
                raise TemplateSyntaxError(f"a blank line is required after a block list, before '{top[1]}:'")
            key, value = top[1], (top[2] or "").strip()
            if key in out:
                raise TemplateSyntaxError(f"duplicate key '{key}'")
            if key not in (*BLOCKS, "name", "description", "allow_unused"):
                raise TemplateSyntaxError(f"unknown key '{key}' in front matter")
            in_list = False
            if key not in BLOCKS:
                out[key] = _bare(value)
            elif value.startswith("["):
                out[key] = [value]
            elif value and not value.startswith("#"):
                raise TemplateSyntaxError(f"'{key}' must be a list")
            else:
                out[key] = []
        elif key is None:
            raise TemplateSyntaxError(f"expected 'key:' but found '{bare}'")
        elif bare == "-" or bare.startswith("- "):
            if key not in BLOCKS:
                raise TemplateSyntaxError(f"'{key}' is not a list")
            out[key].append(bare[1:].strip())
            in_list = True
        elif line[0].isspace() and out.get(key):
            if isinstance(out[key], list):
                out[key][-1] += " " + bare
            else:
                out[key] += " " + bare
        else:
            raise TemplateSyntaxError(f"unexpected line '{bare}' in front matter")
        blank = False
    for key in BLOCKS:
        items = out.get(key)
        if isinstance(items, list) and len(items) == 1 and items[0].startswith("[") and (key != "imports" or items[0].endswith("]")):
            if not items[0].endswith("]"):
                raise TemplateSyntaxError(f"unclosed '[' after '{key}:'")
            out[key] = split_top(items[0][1:-1])
        if isinstance(out.get(key), list):
            out[key] = [_bare(_uncommented(x)) for x in out[key]]
    return out


def _uncommented(item: str) -> str:
    """Without a comment: as in YAML one begins at white space and ``#``, unless the whole item is quoted."""
    return item if literals.is_quoted(item) else re.split(r"\s#", item, maxsplit=1)[0].strip()


def _bare(text: str) -> str:
    return literals.unescape(text[1:-1]) if literals.is_quoted(text) else text


def parse(source_header: str, base_dir: str | None, env: dict | None, parent: Header | None = None, seen: tuple[str, ...] = (), shallow: bool = False) -> Header:
    """parent: the header whose types and constants an inline template inherits.  shallow: an imported file, whose own imports stay closed."""
    raw = entries(source_header)
    head = Header(name=raw.get("name"), description=raw.get("description"), allow_unused=raw.get("allow_unused") == "true")
    if raw.get("allow_unused") not in (None, "true", "false"):
        raise TemplateSyntaxError("allow_unused must be true or false")
    outer_types = dict(parent.types) if parent else {}
    if parent:
        head.imports = dict(parent.imports)

    def alias(name: str) -> VarType | None:
        if name in head.types:
            head.used_types.add(name)
            return head.types[name]
        if "." in name:
            stem, _, member = name.partition(".")
            return head.imports[stem].all_types().get(member) if stem in head.imports else None
        return outer_types.get(name)

    def constant(name: str):
        m = re.match(r"kinds\((.*)\)\Z", name)
        if m:
            kind = alias(m[1].strip())
            return (kind.names, List(STR)) if isinstance(kind, Enum) else None
        known = (parent.values() if parent else {}) | {d.name: (d.default, d.type) for d in (*head.env, *head.consts) if not d.required}
        if name in known:
            return known[name]
        stem, _, member = name.partition(".")
        if stem in ("consts",) and member in known:
            return known[member]
        return head.imports[stem].values().get(member) if stem in head.imports else None

    # Types come first, but those that name imports wait for them.
    late = [x for x in raw.get("types", []) if re.search(r"\b[a-z_]\w*\.\w", x)]
    _types(head, [x for x in raw.get("types", []) if x not in late], alias)
    for d in _decls(raw.get("env", []), alias, constant, "env"):
        given = (env or {}).get(d.name, NONE)
        if given is not NONE:
            d.default = _from_env(d, given)
        elif d.required and not shallow:
            raise TemplateSyntaxError(f"env variable '{d.name}' is required but not provided: no value provided and no default")
        head.env.append(d)
    pending = list(raw.get("consts", []))
    for _ in range(2):  # constants that need imports are read after them
        left = []
        for item in pending:
            try:
                head.consts += _decls([item], alias, constant, "consts")
            except TemplateSyntaxError:
                left.append(item)
        pending = left
        if not head.imports and raw.get("imports") and not shallow:
            _imports(head, raw["imports"], base_dir, env, constant, seen)
            _types(head, late, alias)
            late = []
    if late and not shallow:
        _types(head, late, alias)
    head.consts += _decls(pending, alias, constant, "consts") if not shallow else []
    names = [re.match(r"\w*", x)[0] for x in raw.get("consts", [])]
    head.consts.sort(key=lambda d: names.index(d.name))
    for d in head.consts:
        if d.required:
            raise TemplateSyntaxError(f"constant '{d.name}' needs a value")
    for item in raw.get("params", []):
        try:
            head.params += _decls([item], alias, constant, "params")
        except TemplateSyntaxError:
            if not shallow:
                raise
    if not shallow:
        _collisions(head, raw)
    return head


def _types(head: Header, items: list[str], alias) -> None:
    for item in items:
        m = re.match(r"([A-Za-z_]\w*)\s*=\s*(.+)\Z", item, re.S)
        if not m:
            raise TemplateSyntaxError(f"expected 'Name = type' in types, found '{item}'")
        if m[1] in RESERVED:
            raise TemplateSyntaxError(f"reserved keyword used as name: '{m[1]}'")
        if m[1] in head.types:
            raise TemplateSyntaxError(f"duplicate type '{m[1]}'")
        head.types[m[1]] = parse_type(m[2], alias)


def _decls(items: list[str], alias, constant, block: str) -> list[Decl]:
    out = []
    for item in items:
        left, sign, value = _assignment(item)
        name, eq, kind = left.partition("=")
        name, kind = name.strip(), kind.strip()
        if not eq:
            raise TemplateSyntaxError(f"'{name}' must have an explicit type: write '{name} = type := {value.strip()}'" if sign else f"'{name}' is missing a type annotation")
        if not NAME.match(name):
            raise TemplateSyntaxError(f"'{name}' is not a name")
        if name in RESERVED:
            raise TemplateSyntaxError(f"reserved keyword used as name: '{name}'")
        parsed = parse_type(kind, alias)
        got = literals.default(value, parsed, constant, name) if sign else NONE
        out.append(Decl(name, parsed, got, kind))
    return out


def _assignment(item: str) -> tuple[str, str, str]:
    pieces = split_top(item, ":=")
    if len(pieces) == 1:
        return pieces[0] if pieces else "", "", ""
    return pieces[0], ":=", ":=".join(pieces[1:])


def _from_env(d: Decl, value: object):
    """A caller's value; text is read as the declared type."""
    if isinstance(value, str) and isinstance(d.type, Scalar) and d.type != STR:
        got = literals.scalar(value)
        value = got[0] if got else value
    try:
        return check_value(d.type, value, d.name)
    except TypeMismatch as e:
        raise TemplateSyntaxError(f"env variable: {e}") from None


def interpolate_path(path: str, value, what: str) -> str:
    """``{{ name }}`` in a path, by a function from an expression to its text or None."""
    if re.search(r"\{\{(?!.*?\}\})", path, re.S):
        raise TemplateSyntaxError(f"unclosed '{{{{' in {what} '{path}'")

    def one(m: re.Match) -> str:
        inner = m[1].strip()
        if not inner:
            raise TemplateSyntaxError(f"empty expression '{{{{}}}}' in {what} '{path}'")
        got = value(inner)
        if got is None:
            raise TemplateSyntaxError(f"unresolvable expression '{m[0]}' in {what} '{path}'")
        return str(got)

    return re.sub(r"\{\{(.*?)\}\}", one, path, flags=re.S)


def strict_path(path: str, what: str) -> str:
    if not path.startswith(("./", "../", "/")):
        raise TemplateSyntaxError(f"{what} '{path}' must start with './' or '../'")
    return path


def _imports(head: Header, items: list[str], base_dir: str | None, env: dict | None, constant, seen: tuple[str, ...]) -> None:
    known: set[str] = set()
    for item in items:
        m = re.match(r"\[([^\]]*)\]\((.*)\)\Z", item, re.S)
        if not m:
            raise TemplateSyntaxError(f"expected '[stem](./path.tmpl.md)' in imports, found '{item}'")
        path = strict_path(interpolate_path(m[2], lambda e: (constant(e) or (None,))[0], "import path"), "import path")
        stem = os.path.basename(path).removesuffix(".tmpl.md")
        if stem != m[1]:
            raise TemplateSyntaxError(f"import stem '{m[1]}' does not match file name '{stem}'")
        full = os.path.realpath(os.path.join(base_dir or ".", path))
        if full in known or m[1] in head.imports:
            raise TemplateSyntaxError(f"circular or duplicate import '{m[1]}'")
        known.add(full)
        try:
            with open(full, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            raise TemplateIOError(f"failed to load template: {e}") from None
        head.imports[m[1]] = parse(split_source(text)[0], os.path.dirname(full), env, None, (*seen, full), shallow=True)


def _collisions(head: Header, raw: dict) -> None:
    for block, decls in (("params", head.params), ("consts", head.consts), ("env", head.env)):
        names = [d.name for d in decls]
        for n in names:
            if names.count(n) > 1:
                raise TemplateSyntaxError(f"duplicate name '{n}' in {block}")
    spaces = {"param": {d.name for d in head.params}, "const": {d.name for d in head.consts}, "env": {d.name for d in head.env}, "type": set(head.types), "import": set(head.imports)}
    kinds = list(spaces)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            both = spaces[a] & spaces[b]
            if both:
                raise TemplateSyntaxError(f"{a} name '{sorted(both)[0]}' conflicts with {b} of the same name")
    for d in (*head.params, *head.consts, *head.env):
        p = pascal(d.name)
        if p in head.imports and p != d.name:
            raise TemplateSyntaxError(f"name '{d.name}' conflicts with import '{p}'")
        if p in head.types and p != d.name and d.alias != p:
            raise TemplateSyntaxError(f"'{d.name}' conflicts with type '{p}': its type must be {p}")
    if not head.allow_unused:
        free = [n for n, t in head.types.items() if n not in head.used_types and not isinstance(t, Enum)]
        if free:
            raise TemplateSyntaxError(f"unused type alias '{free[0]}'")
