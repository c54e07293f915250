"""Body text to a tree of statements; types are not known yet."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from ..errors import TemplateSyntaxError, UnknownFilter
from . import literals
from .types import split_top

FILTERS = ("upper", "lower", "trim", "fixed", "join", "limit", "add", "sub")
FUNCTIONS = ("idx", "len", "kind", "kinds", "has")


# --- expressions ------------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Template:
    """A quoted string with expressions in it."""

    parts: tuple


@dataclass(frozen=True)
class Path:
    names: tuple[str, ...]

    def __str__(self):
        return ".".join(self.names)


@dataclass(frozen=True)
class Call:
    name: str
    arg: Path


@dataclass(frozen=True)
class Piped:
    base: object
    filters: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Op:
    """and, or, not, truth, ==, !=, <, >, <=, >=, in, match."""

    name: str
    args: tuple


# --- statements -------------------------------------------------------------


@dataclass
class Text:
    text: str


@dataclass
class Show:
    expr: object
    line: int


@dataclass
class If:
    branches: list[tuple[object, list]]
    other: list | None
    line: int


@dataclass
class For:
    name: str
    over: object
    body: list
    other: list | None
    line: int


@dataclass
class Arm:
    labels: list[object]
    guard: object
    body: list


@dataclass
class Match:
    expr: object
    arms: list[Arm]
    other: list | None
    inline: bool
    line: int


@dataclass
class Include:
    name: str
    path: str | None
    given: list[tuple[str, object]]
    loop: tuple[str, object] | None
    line: int


@dataclass
class Panic:
    expr: object
    line: int


@dataclass
class Body:
    nodes: list
    inline: dict[str, tuple[str, int]] = field(default_factory=dict)
    mentioned: set[str] = field(default_factory=set)


# --- lines ------------------------------------------------------------------
#
# Each line has one of five forms, seen once:
#   blank  white space only
#   tag    ``>`` and one statement tag, or comments from end to end
#   lead   ``>``, a tag or comment, and more behind it
#   bare   a tag or comment without ``>``
#   text   anything else, quotes among it

_LINE = re.compile(r"\s*(?:(?P<quote>>)[ ]?)?(?P<rest>\s*\{[%#].*)\Z", re.S)
_WHOLE = re.compile(r"\s*(?:\{#.*#\}|\{%(?:(?!%\}).)*%\})\s*\Z", re.S)
_RAW = re.compile(r"\{%-?\s*raw(?:=(?P<word>\S+))?\s*-?%\}")


@dataclass(frozen=True)
class Line:
    form: str
    source: str
    text: str  # without the ``>`` that is not part of the output


def line_of(source: str) -> Line:
    m = _LINE.match(source)
    if not m:
        return Line("text" if source.strip() else "blank", source, source)
    if not m["quote"]:
        return Line("bare", source, source)
    return Line("tag" if _WHOLE.match(m["rest"]) else "lead", source, m["rest"])


def _without_raw(lines: list[Line]) -> list[Line | None]:
    """The lines, None in place of those that open a raw block or lie within one."""
    out: list[Line | None] = []
    end = None
    for line in lines:
        if end is None:
            opened = _RAW.search(line.source) if line.form in ("tag", "lead") else None
            if opened:
                close = re.compile(r"\{%-?\s*/" + re.escape(opened["word"] or "raw") + r"\s*-?%\}")
                end = None if close.search(line.source, opened.end()) else close
            out.append(None if opened else line)
        else:
            end = None if end.search(line.source) else end
            out.append(None if end or line.form == "bare" else line)
    return out


def check_lines(lines: list[Line], first_line: int = 1) -> None:
    """No bare tags, and nothing but blank lines, other tags and the declarations' rule beside a tag."""
    seen = _without_raw(lines)
    for i, line in enumerate(seen):
        if line is not None and line.form == "bare":
            start = line.source.strip()[:60]
            if start.startswith("{#"):
                raise TemplateSyntaxError("a comment at the beginning of a line must have a blockquote prefix: '> {# ... #}'", first_line + i, start)
            raise TemplateSyntaxError(f"a bare statement tag at the beginning of a line: write '> {start}'", first_line + i, start)
    for i, pair in enumerate(zip(lines, lines[1:])):
        for at, other, word in ((0, 1, "followed"), (1, 0, "preceded")):
            if seen[i + at] is not None and pair[at].form == "tag" and pair[other].form in ("text", "bare") and pair[other].source.strip() != "---":
                tag = pair[at].source.strip()
                raise TemplateSyntaxError(f"standalone tag '{tag}' must be {word} by a blank line or another tag line", first_line + i + at, tag[:60])


def _between(before: str, gap: list[str], after: str) -> str:
    """What stands between two neighbours (a form, or ``edge``), given the blank lines there."""
    if before == "tag":  # one blank line is Markdown's, and all of them before another tag or the end
        return "\n" * (len(gap) - 1) if after == "text" else ""
    if after == "tag" and gap and not gap[-1]:
        gap = gap[:-1]
    lead = "" if before == "edge" else "\n"
    return lead + "".join(g + "\n" for g in gap) if after != "edge" else "".join(lead + g for g in gap) if lead else "\n".join(gap)


def join_lines(lines: list[Line]) -> tuple[str, list[int]]:
    """The text without the ``>`` of tags, and without the blank lines that stand around tags for Markdown's sake.

    Also where each line begins in it (or would, where it is left out)."""
    out, begins, gap, before = "", [], [], "edge"
    for line in [*lines, None]:
        form = "edge" if line is None else "tag" if line.form == "tag" else "blank" if line.form == "blank" else "text"
        if form == "blank":
            gap.append(line.text)
            continue
        between = _between(before, gap, form)
        # Blank lines that are kept begin where they stand; the others at the end of what is kept.
        at = len(out) + (before == "text")
        for g in gap:
            begins.append(min(at, len(out) + len(between)))
            at += len(g) + 1
        out += between
        if line is not None:
            begins.append(len(out))
            out += line.text
        before, gap = form, []
    return out, begins


# --- tokens -----------------------------------------------------------------


@dataclass
class Token:
    kind: str  # text, show, stmt
    text: str
    line: int


def _close(text: str, start: int, end: str) -> int:
    """Where ``end`` stands outside of quotes, or anywhere if quotes don't pair up; -1 if nowhere."""
    quote, i = "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif text.startswith(end, i):
            return i
        elif c in "\"'":
            quote = c
        i += 1
    return text.find(end, start)


def tokens(text: str, body: Body, first_line: int, begins: list[int]) -> list[Token]:
    out: list[Token] = []
    at, eat = 0, False

    def literal(piece: str, trim_end: bool) -> None:
        nonlocal eat
        if eat:
            piece = re.sub(r"\A[ \t]*\n?", "", piece)
        eat = False
        if trim_end:
            bare = piece.rstrip(" \t")
            piece = bare if bare.endswith("\n") else piece.rstrip()
        if piece:
            out.append(Token("text", piece, 0))

    while True:
        m = re.compile(r"\{\{|\{%|\{#").search(text, at)
        if not m:
            literal(text[at:], False)
            return out
        line, kind = first_line + bisect.bisect_right(begins, m.start()) - 1, m[0]
        end = {"{{": "}}", "{%": "%}", "{#": "#}"}[kind]
        stop = text.find(end, m.end()) if kind == "{#" else _close(text, m.end(), end)
        if stop < 0:
            raise TemplateSyntaxError(f"unclosed '{kind}'", line, text[m.start() :].split("\n")[0][:60])
        inner = text[m.end() : stop]
        before, after = inner.startswith("-") and not re.match(r"-\d", inner), inner.endswith("-")
        inner = inner[1 if before else 0 : -1 if after else None]
        if kind != "{{" and inner and not (inner[0].isspace() and inner[-1].isspace()):
            what = "statement tags" if kind == "{%" else "comments"
            raise TemplateSyntaxError(f"{what} must have spaces around the content: '{kind} {inner.strip()} {end}'", line, f"{kind}{inner}{end}".split("\n")[0][:60])
        inner = inner.strip()
        literal(text[at : m.start()], before)
        at, eat = stop + 2, after
        if kind == "{#":
            body.mentioned.update(re.findall(r"\{\{\s*([A-Za-z_]\w*)", inner))
        elif kind == "{{":
            if not inner:
                raise TemplateSyntaxError("empty expression '{{}}'", line, "{{ }}")
            out.append(Token("show", inner, line))
        elif re.match(r"raw(=\S+)?\Z", inner):
            word = re.escape(inner.partition("=")[2] or "raw")
            close = re.compile(r"\{%(-?)\s*/" + word + r"\s*(-?)%\}").search(text, at)
            if not close:
                raise TemplateSyntaxError("unclosed raw block", line, "{% raw %}")
            literal(text[at : close.start()], bool(close[1]))
            at, eat = close.end(), bool(close[2])
        elif re.match(r"tmpl\b", inner):
            name = inner[4:].strip()
            if not re.match(r"[A-Za-z_]\w*\Z", name):
                raise TemplateSyntaxError(f"inline template needs a name: '{inner}'", line, inner)
            close = re.compile(r"\{%-?\s*/tmpl\s*-?%\}").search(text, at)
            if not close:
                raise TemplateSyntaxError(f"unclosed inline template '{name}'", line, inner)
            if name in body.inline:
                raise TemplateSyntaxError(f"duplicate inline template '{name}'", line, inner)
            body.inline[name] = (text[at : close.start()], line)
            at = close.end()
        else:
            out.append(Token("stmt", inner, line))


# --- statements -------------------------------------------------------------


class _Parser:
    def __init__(self, found: list[Token]):
        self.tokens, self.at = found, 0
        self.open: list[Token] = []

    def block(self, ends: tuple[str, ...]) -> list:
        """Nodes up to a statement that begins with one of ``ends`` (not taken)."""
        out = []
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            if t.kind == "text":
                out.append(Text(t.text))
            elif t.kind == "show":
                out.append(Show(expression(t.text, t.line), t.line))
            else:
                word = re.match(r"/?\s*[\w#]*", t.text)[0]
                if word in ends:
                    return out
                self.at += 1
                out.append(self.statement(word, t))
                continue
            self.at += 1
        if ends:
            t = self.open[-1]
            raise TemplateSyntaxError(f"unclosed block: expected {{% {ends[-1]} %}}", t.line, t.text)
        return out

    def word(self) -> Token:
        t = self.tokens[self.at]
        self.at += 1
        return t

    def statement(self, word: str, t: Token):
        rest = t.text[len(word) :].strip()
        make = {"if": self.if_, "for": self.for_, "match": self.match, "include": self.include, "panic": self.panic}.get(word)
        if make is None:
            raise TemplateSyntaxError(f"unexpected statement '{t.text}'", t.line, t.text)
        self.open.append(t)
        got = make(rest, t)
        self.open.pop()
        return got

    def if_(self, rest: str, t: Token):
        branches, other = [(condition(rest, t.line), self.block(("elif", "else", "/if")))], None
        while True:
            end = self.word()
            if end.text.startswith("elif"):
                branches.append((condition(end.text[4:].strip(), end.line), self.block(("elif", "else", "/if"))))
            elif end.text.startswith("else"):
                other = self.block(("/if",))
                self.word()
                break
            else:
                break
        return If(branches, other, t.line)

    def for_(self, rest: str, t: Token):
        m = re.match(r"([A-Za-z_]\w*)\s+in\s+(.+)\Z", rest, re.S)
        if not m:
            raise TemplateSyntaxError(f"malformed for: expected 'for name in list', found 'for {rest}'", t.line, t.text)
        body, other = self.block(("else", "/for")), None
        if self.word().text.startswith("else"):
            other = self.block(("/for",))
            self.word()
        return For(m[1], expression(m[2], t.line), body, other, t.line)

    def match(self, rest: str, t: Token):
        m = re.match(r"(.+?)\s+case\s+(.+)\Z", rest, re.S)
        if m:
            labels, guard = _case(m[2], t.line)
            arms, other = [Arm(labels, guard, self.block(("else", "case", "/match")))], None
            inline = True
        else:
            if not rest or rest.startswith("case"):
                raise TemplateSyntaxError("match needs an expression", t.line, t.text)
            arms, other, inline = [], None, False
            lead = self.block(("case", "else", "/match"))
            if any(not isinstance(n, Text) or n.text.strip() for n in lead):
                raise TemplateSyntaxError("content before the first case of a match", t.line, t.text)
        while True:
            end = self.word()
            if end.text.startswith("/match"):
                break
            if other is not None:
                raise TemplateSyntaxError("a match's else must be its last arm", end.line, end.text)
            if end.text.startswith("else"):
                other = self.block(("case", "else", "/match"))
            else:
                labels, guard = _case(end.text[4:].strip(), end.line)
                arms.append(Arm(labels, guard, self.block(("case", "else", "/match"))))
        wild = [i for i, a in enumerate(arms) if a.labels == [Path(("_",))] and a.guard is None]
        if wild and other is None:
            if wild[0] != len(arms) - 1:
                raise TemplateSyntaxError("a match's catch-all must be its last arm", t.line, t.text)
            other = arms.pop().body
        if not arms and not wild:
            raise TemplateSyntaxError("match without any case", t.line, t.text)
        return Match(expression(m[1] if m else rest, t.line), arms, other, inline, t.line)

    def include(self, rest: str, t: Token):
        m = re.match(r"\[([^\]]*)\]\(((?:\{\{.*?\}\}|[^)])*)\)|([A-Za-z_]\w*)", rest, re.S)
        if not m:
            raise TemplateSyntaxError(f"malformed include '{rest}'", t.line, t.text)
        tail, loop, given = rest[m.end() :].strip(), None, []
        f = re.match(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+?)(?:\s+(?=with\s)|\Z)", tail, re.S)
        if f:
            loop, tail = (f[1], expression(f[2], t.line)), tail[f.end() :].strip()
        w = re.match(r"with\s+(.+)\Z", tail, re.S)
        if w:
            for part in split_top(w[1]):
                name, sign, value = part.partition("=")
                if not sign or not re.match(r"[A-Za-z_]\w*\Z", name.strip()) or not value.strip():
                    raise TemplateSyntaxError(f"malformed include argument '{part}'", t.line, t.text)
                given.append((name.strip(), expression(value.strip(), t.line)))
        elif tail:
            raise TemplateSyntaxError(f"malformed include '{rest}'", t.line, t.text)
        return Include(m[3] or m[1], m[2], given, loop, t.line)

    def panic(self, rest: str, t: Token):
        m = re.match(r"\((.*)\)\Z", rest, re.S)
        if not m or not m[1].strip():
            raise TemplateSyntaxError("panic needs a message: panic(\"...\")", t.line, t.text)
        return Panic(expression(m[1].strip(), t.line), t.line)


def _case(text: str, line: int) -> tuple[list, object]:
    head, *more = split_top(text, "&&")
    labels = split_top(head, "|")
    if not labels or "" in labels:
        raise TemplateSyntaxError("case without a variant name", line, text)
    return [expression(x, line, label=True) for x in labels], condition(" && ".join(more), line) if more else None


def parse_body(text: str, first_line: int = 1, bare: bool = False) -> Body:
    """bare: the body of an inline template, whose lines were joined with those of its file."""
    body = Body([])
    if bare:
        begins = [0, *(m.end() for m in re.finditer("\n", text))]
    else:
        lines = [line_of(x) for x in text.split("\n")]
        check_lines(lines, first_line)
        text, begins = join_lines(lines)
    parser = _Parser(tokens(text, body, first_line, begins))
    body.nodes = parser.block(())
    return body


# --- expressions ------------------------------------------------------------


def expression(text: str, line: int, label: bool = False):
    base, *pipes = split_top(text, "|")
    got = _primary(base, line)
    if not pipes:
        return got
    filters = []
    for p in pipes:
        m = re.match(r"([A-Za-z_]\w*)\s*(?:\((.*)\))?\Z", p, re.S)
        if not m:
            raise TemplateSyntaxError(f"malformed filter '{p}'", line, text)
        if m[1] not in FILTERS:
            raise UnknownFilter(f"unknown filter: {m[1]}", line, text)
        filters.append((m[1], _filter_argument(m[1], (m[2] or "").strip(), line)))
    return Piped(got, tuple(filters))


def _filter_argument(name: str, text: str, line: int):
    if name in ("fixed", "limit"):
        if not re.match(r"[0-9]+\Z", text):
            raise TemplateSyntaxError(f"{name}() needs a whole number, found '{text}'", line, text)
        return int(text)
    if name in ("add", "sub"):
        got = literals.scalar(text)
        if not got or isinstance(got[0], (bool, str)):
            raise TemplateSyntaxError(f"{name}() needs a number, found '{text}'", line, text)
        return got[0]
    if name == "join":
        if text and not literals.is_quoted(text):
            raise TemplateSyntaxError(f"join() needs a quoted separator, found '{text}'", line, text)
        return literals.unescape(text[1:-1]) if text else ""
    if text:
        raise TemplateSyntaxError(f"{name} takes no argument", line, text)
    return None


def interpolated(text: str, line: int):
    """A decoded string literal, with ``{{ }}`` in it."""
    if "{{" not in text:
        return Literal(text)
    parts, at = [], 0
    while (start := text.find("{{", at)) >= 0:
        stop = text.find("}}", start)
        if stop < 0:
            raise TemplateSyntaxError("unclosed '{{' in a string", line, text)
        inner = text[start + 2 : stop].strip()
        if not inner:
            raise TemplateSyntaxError("empty expression '{{}}' in a string", line, text)
        parts += [Literal(text[at:start])] * (start > at) + [expression(inner, line)]
        at = stop + 2
    return Template((*parts, *[Literal(text[at:])] * (at < len(text))))


def _primary(text: str, line: int):
    text = text.strip()
    if not text:
        raise TemplateSyntaxError("empty expression", line, text)
    if literals.is_quoted(text):
        return interpolated(literals.unescape(text[1:-1]), line)
    got = literals.scalar(text)
    if got:
        return Literal(got[0])
    m = re.match(r"([A-Za-z_]\w*)\s*\((.*)\)\Z", text, re.S)
    if m:
        if m[1] not in FUNCTIONS:
            raise TemplateSyntaxError(f"unknown function '{m[1]}'", line, text)
        arg = _primary(m[2], line)
        if not isinstance(arg, Path):
            raise TemplateSyntaxError(f"{m[1]}() takes a name, found '{m[2]}'", line, text)
        return Call(m[1], arg)
    if re.match(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*\Z", text):
        return Path(tuple(text.split(".")))
    what = "number" if re.match(r"[-+.]?\d", text) else "expression"
    raise TemplateSyntaxError(f"malformed {what} '{text}'", line, text)


_OPERATORS = ("==", "!=", "<=", ">=", "<", ">")


def _pieces(text: str, line: int) -> list[str]:
    """Operators, brackets of groups, and operands with their calls and pipes."""
    out, i, operand = [], 0, ""

    def flush() -> None:
        nonlocal operand
        if operand.strip():
            out.append(operand.strip())
        operand = ""

    while i < len(text):
        c = text[i]
        if c in "\"'":
            m = re.compile(r"\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'", re.S).match(text, i)
            if not m:
                raise TemplateSyntaxError("unclosed string in condition", line, text)
            operand += m[0]
            i = m.end()
        elif text[i : i + 2] in ("&&", "||", "==", "!=", "<=", ">="):
            flush()
            out.append(text[i : i + 2])
            i += 2
        elif c in "<>!":
            flush()
            out.append(c)
            i += 1
        elif c == "(":
            if operand.strip():  # a call or a filter's argument
                depth, j, quote = 0, i, ""
                while j < len(text):
                    d = text[j]
                    if quote:
                        quote = "" if d == quote else quote
                    elif d in "\"'":
                        quote = d
                    else:
                        depth += (d == "(") - (d == ")")
                        if not depth:
                            break
                    j += 1
                else:
                    raise TemplateSyntaxError("unclosed '(': expected ')'", line, text)
                operand += text[i : j + 1]
                i = j + 1
            else:
                flush()
                out.append("(")
                i += 1
        elif c == ")":
            flush()
            out.append(")")
            i += 1
        elif (m := re.compile(r"(in|case|match)(?=[\s\"'(])").match(text, i)) and (i == 0 or text[i - 1].isspace() or text[i - 1] in "\"')("):
            flush()
            out.append(m[1])
            i = m.end()
        else:
            operand += c
            i += 1
    flush()
    return out


class _Condition:
    def __init__(self, text: str, line: int):
        self.text, self.line = text, line
        self.parts, self.at = _pieces(text, line), 0

    def fail(self, what: str):
        raise TemplateSyntaxError(f"malformed condition '{self.text}': {what}", self.line, self.text)

    def peek(self) -> str | None:
        return self.parts[self.at] if self.at < len(self.parts) else None

    def take(self) -> str:
        if self.peek() is None:
            self.fail("expected an expression")
        self.at += 1
        return self.parts[self.at - 1]

    def whole(self):
        got = self.chain("||", "or", lambda: self.chain("&&", "and", self.unary))
        if self.peek() is not None:
            self.fail(f"unexpected '{self.peek()}'")
        return got

    def chain(self, sign: str, name: str, part):
        got = part()
        while self.peek() == sign:
            self.take()
            got = Op(name, (got, part()))
        return got

    def unary(self):
        if self.peek() == "!":  # takes the comparison that follows, as existing templates expect
            self.take()
            return Op("not", (self.unary(),))
        if self.peek() == "(":
            self.take()
            got = self.chain("||", "or", lambda: self.chain("&&", "and", self.unary))
            if self.peek() != ")":
                self.fail("unclosed '(': expected ')'")
            self.take()
            return got
        if self.peek() == "match":
            self.take()
            subject = self.operand()
            if self.peek() != "case":
                self.fail("expected 'case' after 'match'")
            self.take()
            labels = split_top(self.take(), "|")
            return Op("match", (subject, tuple(expression(x, self.line) for x in labels)))
        left = self.operand()
        if self.peek() in (*_OPERATORS, "in"):
            return Op(self.take(), (left, self.operand()))
        return Op("truth", (left,))

    def operand(self):
        text = self.take()
        if text in (*_OPERATORS, "&&", "||", "in", "case", ")", "!", "("):
            self.fail(f"expected an expression, found '{text}'")
        if re.match(r"not\s", text):
            self.fail("'not' is not supported, use '!'")
        return expression(text, self.line)


def condition(text: str, line: int):
    if not text.strip():
        raise TemplateSyntaxError("empty condition: expected an expression", line, text)
    return _Condition(text, line).whole()
