"""Errors of templates; ``kind`` is a stable name for tables and logs."""

from __future__ import annotations


class TemplateError(Exception):
    kind = "template"


class TemplateSyntaxError(TemplateError):
    """The template's text, declarations or types are wrong.  ``line`` counts from 1 in the whole source, or in the included ``file``."""

    kind = "syntax"
    file: str | None = None

    def __init__(self, message: str, line: int | None = None, snippet: str | None = None):
        self.message, self.line, self.snippet = message, line, snippet
        super().__init__(message)

    def __str__(self) -> str:
        place = f" (line {self.line}{f' of {self.file}' if self.file else ''}: {self.snippet})" if self.line else ""
        return f"template syntax error: {self.message}{place}"


class UndefinedVariable(TemplateError):
    kind = "undefined_variable"


class UnknownFilter(TemplateSyntaxError):
    kind = "unknown_filter"


class MissingParams(TemplateError):
    kind = "missing_params"

    def __init__(self, names: list[str]):
        self.names = names
        super().__init__(f"missing required parameters: {', '.join(names)}")


class ExtraParams(TemplateError):
    kind = "extra_params"

    def __init__(self, names: list[str]):
        self.names = names
        super().__init__(f"extra undeclared parameters: {', '.join(names)}")


class TypeMismatch(TemplateError):
    kind = "type_mismatch"

    def __init__(self, name: str, expected: str, actual: str, value: object = ""):
        self.name, self.expected, self.actual = name, expected, actual
        super().__init__(f"type mismatch for '{name}': expected {expected}, got {actual} ({value})")


class IncludeNotFound(TemplateError):
    kind = "include_not_found"

    def __init__(self, path: str):
        super().__init__(f"include not found: {path}")


class DeclarationsMutated(TemplateError):
    kind = "declarations_mutated"

    def __init__(self, details: str):
        super().__init__(f"template parameter declarations were modified at runtime: {details}")


class InvalidRecord(TemplateError):
    kind = "invalid_record"

    def __init__(self, message: str):
        super().__init__(f"invalid record: {message}")


class Panic(TemplateError):
    kind = "panic"

    def __init__(self, message: str):
        self.message = message
        super().__init__(f"template panic: {message}")


class TemplateIOError(TemplateError):
    kind = "io"
