"""Templates: compiled on the driver, rendered as columns."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors
from .operators import columnar
from .operators.batches import python_column
from .operators.checks import Columns, Records
from .operators.lower import BUDGET, PREFIX, Lowering, constant, lower, lower_caught
from .operators.staged import CASES, with_text
from .plans import interp
from .plans import tree as N
from .plans.analysis import MAX_DEPTH, Compiler, Unit, _is_tmpl
from .plans.frontmatter import Decl
from .plans.types import FLOAT, INT, KIND, STR, Enum, List, Option, Struct, VarType, check_spark, check_value, to_spark

#: Kinds of columns that group as they are shown, but for the sign of zero.
PLAIN = (T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType())
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def source_hash(source: str) -> int:
    """FNV-1a, 64 bits."""
    h = FNV_START
    for b in source.encode("utf-8"):
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def load_unit(path: str, env: dict | None) -> Unit:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            source = f.read()
    except OSError as e:
        raise errors.TemplateIOError(f"failed to load template: {e}") from None
    return Unit.of(source, os.path.dirname(path), env)


class Template:
    """A compiled template.  ``templates`` are the values of its ``tmpl(...)`` parameters."""

    def __init__(self, source: str, *, base_dir: str | None = None, env: dict | None = None, allow_unused: bool = False, templates: dict[str, "Template"] | None = None, max_include_depth: int = MAX_DEPTH, load=load_unit):
        self.source = source.replace("\r\n", "\n")
        self._how = {"base_dir": base_dir, "env": env, "allow_unused": allow_unused, "max_include_depth": max_include_depth, "load": load}
        self.given = dict(templates or {})
        try:
            self.unit = Unit.of(self.source, base_dir, env)
            units = {n: {k: x.unit for k, x in t.items()} if isinstance(t, dict) else t.unit for n, t in self.given.items()}
            self.tree = Compiler(load, max_include_depth).compile(self.unit, units, allow_unused)
        except errors.TemplateSyntaxError as e:
            lines = self.source.split("\n")
            if e.line and e.line <= len(lines) and not e.file:
                e.snippet = lines[e.line - 1].strip()[:80]
            raise
        self._checked: set[str] = set()

    # --- construction -------------------------------------------------------

    @classmethod
    def from_source(cls, source: str, **how) -> "Template":
        return cls(source, **how)

    @classmethod
    def from_source_allowing_unused(cls, source: str, **how) -> "Template":
        return cls(source, allow_unused=True, **how)

    @classmethod
    def from_source_with_env(cls, source: str, env: dict, **how) -> "Template":
        return cls(source, env=env, **how)

    @classmethod
    def from_file(cls, path: str, **how) -> "Template":
        try:
            with open(path, encoding="utf-8", newline="") as f:
                source = f.read()
        except OSError as e:
            raise errors.TemplateIOError(f"failed to load template: {e}") from None
        return cls(source, **({"base_dir": os.path.dirname(os.path.abspath(path))} | how))

    def bind(self, **templates: "Template | dict[str, Template]") -> "Template":
        """This template with values of its ``tmpl(...)`` parameters.  A dict of templates makes the parameter a column of
        text: each row names the one that it is rendered with."""
        return Template(self.source, templates=self.given | templates, **self._how)

    # --- what it declares ---------------------------------------------------

    @property
    def name(self) -> str | None:
        return self.unit.head.name

    @property
    def description(self) -> str | None:
        return self.unit.head.description

    @property
    def body(self) -> str:
        from .plans.frontmatter import split_source

        return split_source(self.source)[1]

    @property
    def base_dir(self) -> str | None:
        return self._how["base_dir"]

    @property
    def source_hash(self) -> str:
        return f"{source_hash(self.source):016x}"

    def __eq__(self, other):
        return isinstance(other, Template) and self.source_hash == other.source_hash

    def __hash__(self):
        return hash(self.source_hash)

    def declarations(self) -> list[tuple[str, str]]:
        return [(d.name, str(d.type)) for d in self.unit.head.params]

    def defaults(self) -> dict[str, object]:
        return {d.name: d.default for d in self.unit.head.params if not d.required}

    def consts(self) -> dict[str, object]:
        return {d.name: d.default for d in self.unit.head.consts}

    def imported_consts(self) -> dict[str, dict[str, object]]:
        return {stem: {d.name: d.default for d in head.consts} for stem, head in self.unit.head.imports.items()}

    def schema(self) -> T.StructType:
        """The columns that rendering takes."""
        return T.StructType([T.StructField(d.name, to_spark(d.type), isinstance(d.type, Option)) for d in self._columns()])

    def frame(self, spark: SparkSession, records: list[dict]) -> DataFrame:
        """Python records as a frame to render; parameters that no record has stay away, so their defaults hold."""
        decls = [d for d in self._columns() if any(d.name in r for r in records)]
        kinds = T.StructType([T.StructField(d.name, to_spark(d.type), True) for d in decls])
        return spark.createDataFrame([tuple(spark_value(d.type, r.get(d.name)) for d in decls) for r in records], kinds)

    def _columns(self) -> list[Decl]:
        routed = [replace(d, type=STR) for d in self.unit.head.params if isinstance(self.given.get(d.name), dict)]
        return [d for d in self.unit.head.params if not _is_tmpl(d.type)] + routed

    def _missing(self, have) -> list[str]:
        """Required parameters that are neither in ``have`` nor given as templates."""
        columns = {d.name for d in self._columns()}
        optional = lambda d: _is_tmpl(d.type) and isinstance(d.type, Option) and d.name not in columns
        return [d.name for d in self.unit.head.params if d.required and d.name not in (have if d.name in columns else self.given) and not optional(d)]

    def validate_declarations(self, other: "Template") -> None:
        """The other template takes the same parameters."""
        mine, theirs = dict(self.declarations()), dict(other.declarations())
        faults = [f"removed '{n}'" for n in mine if n not in theirs] + [f"added '{n}'" for n in theirs if n not in mine] + [f"'{n}' changed from {mine[n]} to {theirs[n]}" for n in mine if n in theirs and theirs[n] != mine[n]]
        if faults:
            raise errors.DeclarationsMutated("; ".join(faults))

    # --- rendering of rows --------------------------------------------------

    def check_schema(self, schema: T.StructType, allow_extra: bool = False) -> None:
        """Missing, then mismatched, then extra columns."""
        have = {f.name: f.dataType for f in schema.fields}
        missing = self._missing(have)
        if missing:
            raise errors.MissingParams(missing)
        for d in self._columns():
            if d.name in have:
                check_spark(d.type, have[d.name], d.name)
        extra = [n for n in have if n not in {d.name for d in self._columns()}]
        if extra and not allow_extra:
            raise errors.ExtraParams(extra)

    def column(self, df: DataFrame, *, allow_extra: bool = True, unchecked: bool = False, engine: str = "auto") -> Column:
        """The rendered text of each row of ``df``, whose columns are the parameters."""
        columns, faults = self._checks(df, allow_extra, unchecked)
        bad = _any(test for test, _, _ in faults)
        text = lower(self.tree, columns.__getitem__) if self.engine(engine) == "catalyst" else python_column(self.tree, self._types(), columns, False, bad)
        if bad is None:
            return text
        told = F.coalesce(*[F.when(test, F.raise_error(message).cast("string")) for test, _, message in faults])
        return F.when(bad, told).otherwise(text)

    def _checks(self, df: DataFrame, allow_extra: bool, unchecked: bool):
        key = f"{df.schema.json()}{allow_extra}"
        if key not in self._checked:
            self.check_schema(df.schema, allow_extra)
            self._checked.add(key)
        columns = self._inputs(df)
        return columns, [] if unchecked else [(test, kind, F.concat(F.lit("type mismatch for "), text)) for test, kind, text in self._faults(df, columns)]

    def _used_cases(self, df: DataFrame, columns: dict[str, Column]) -> N.Node:
        """The tree with the cases of its large switches that rows of ``df`` name; one pass over what the names are made of.
        Of a stream, or of a name that is made in a loop, all cases stay."""
        def keep(switch: N.Switch) -> set[str] | None:
            inner = isinstance(switch.key, N.Stop) or any(isinstance(x, (N.Item, N.Index, N.Stop)) for x in N.walk(switch.key))
            if len(switch.cases) <= CASES or inner or df.isStreaming:
                return None
            named = df.select(Lowering(columns.__getitem__, True).value(switch.key).alias("name")).where(F.col("name").isin([n for n, _ in switch.cases]))
            return {r["name"] for r in named.distinct().collect()}  # the switch's cases at most

        return N.pruned(self.tree, keep)

    def _types(self) -> dict[str, VarType]:
        return {d.name: d.type for d in self._columns()}

    def _caught(self, df: DataFrame, columns: dict[str, Column], told: Column | None, engine: str, out: str) -> DataFrame:
        """``df`` with the text, and the kind and message of what the row fails by: ``told`` (a struct), else the first stop of the tree."""
        held = {n: _fresh(df, n) for n in ("_fault", "_made")}
        fault, made = F.col(held["_fault"]), F.col(held["_made"])
        step = df.withColumn(held["_fault"], F.lit(None).cast("struct<kind:string,message:string>") if told is None else told)
        if engine == "auto" and N.size(self.tree) > BUDGET:
            lowering, tree = Lowering(columns.__getitem__, True), self._used_cases(step, columns)
            stop = lowering.fault(tree)
            if stop is not None:
                step = step.withColumn(held["_fault"], F.coalesce(fault, stop))
            step = with_text(step, tree, lowering, held["_made"], _fresh_prefix(step), fault.isNull())
        elif self.engine(engine) == "catalyst":
            text, stop = lower_caught(self.tree, columns.__getitem__)
            if stop is not None:
                step = step.withColumn(held["_fault"], F.coalesce(fault, stop))
            step = step.withColumn(held["_made"], F.when(fault.isNull(), text))
        else:
            step = step.withColumn(held["_made"], python_column(self.tree, self._types(), columns, True, fault.isNotNull()))
            stop = F.when(made["kind"].isNotNull(), F.struct(made["kind"].alias("kind"), made["message"].alias("message")))
            step = step.withColumn(held["_fault"], F.coalesce(fault, stop)).withColumn(held["_made"], made["text"])
        return step.withColumns({out: made, "error_kind": fault["kind"], "error": fault["message"]}).drop(*held.values())

    def engine(self, asked: str = "auto") -> str:
        """``catalyst``, or ``python`` (Arrow batches): for loops in loops, which go by columns there and by lambdas else, and for a
        tree beyond the budget where only one column is asked for."""
        if asked != "auto":
            return asked
        return "python" if N.size(self.tree) > BUDGET or columnar.nested(self.tree) and columnar.supported(self.tree) else "catalyst"

    def _inputs(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for d in self._columns():
            if d.name not in df.columns:
                out[d.name] = constant(d.default, d.type)
                continue
            have = df.schema[d.name].dataType
            col = df[d.name]
            out[d.name] = col.cast(to_spark(d.type)) if isinstance(have, T.NullType) or _narrow(d.type, have) else col
        return out

    def _faults(self, df: DataFrame, columns: dict[str, Column]) -> list[tuple[Column, str, Column]]:
        """Where a parameter does not have its type.  One that has its default, or that the template doesn't read, is not looked at."""
        used, out = N.params_of(self.tree), []
        for d in self._columns():
            if d.name in used and d.name in df.columns:
                field = df.schema[d.name]
                found = Columns().found(d.type, columns[d.name], field.dataType, field.nullable)
                out += [(test, "type_mismatch", F.concat(F.lit(f"'{d.name}"), text)) for test, text in found]
        return out

    def render(self, df: DataFrame, out: str = "out", *, allow_extra: bool = True, unchecked: bool = False, engine: str = "auto") -> DataFrame:
        """``df`` with the text in a new column; of a large template by several projections (``operators/staged.py``)."""
        if engine != "auto" or N.size(self.tree) <= BUDGET:
            return df.withColumn(out, self.column(df, allow_extra=allow_extra, unchecked=unchecked, engine=engine))
        columns, faults = self._checks(df, allow_extra, unchecked)
        bad, made = _any(test for test, _, _ in faults), _fresh(df, "_made")
        step = with_text(df, self._used_cases(df, columns), Lowering(columns.__getitem__, False), made, _fresh_prefix(df), None if bad is None else ~bad)
        if bad is None:
            return step.withColumn(out, F.col(made)).drop(made)
        told = F.coalesce(*[F.when(test, F.raise_error(message).cast("string")) for test, _, message in faults])
        return step.withColumn(made, F.when(bad, told).otherwise(F.col(made))).withColumn(out, F.col(made)).drop(made)

    def render_distinct(self, df: DataFrame, made: dict[str, Column] | None = None, out: str = "out", *, allow_extra: bool = True, **how) -> DataFrame:
        """``df`` with the text, or with the columns that ``made`` makes of it, for rows that repeat their parameters: a text depends on nothing
        else, so each set of parameters is rendered once and joined to its rows.  Without ``made`` the join moves whole texts.  ``df`` is
        read twice and must give the same rows; streams, and parameters that are not plain numbers, texts and booleans, are rendered row by row."""
        self.check_schema(df.schema, allow_extra)
        made = {out: F.col(out)} if made is None else made
        kinds = {d.name: df.schema[d.name].dataType for d in self._columns() if d.name in df.columns}
        if df.isStreaming or not kinds or not all(k in PLAIN for k in kinds.values()):
            held = self.render(df, out, **how)
            return held.select(*df.columns, *[c.alias(n) for n, c in made.items()])
        # Grouping takes 0.0 and -0.0 as one, which texts may tell apart: the zeros' texts are keys too, and give the sets their signs back.
        prefix = _fresh_prefix(df)
        signed = {n: f"{prefix}zero_{n}" for n, k in kinds.items() if isinstance(k, (T.FloatType, T.DoubleType))}
        zeros = {z: F.when(F.col(n) == 0, F.col(n).cast("string")) for n, z in signed.items()}
        keyed, keys = df.withColumns(zeros), [*kinds, *zeros]
        # A set of parameters is few bytes and much work, so sets are dealt out by number, not by size.
        sets = keyed.select(*keys).distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sets = sets.withColumns({n: F.coalesce(F.col(z).cast(kinds[n]), F.col(n)) for n, z in signed.items()})
        texts = self.render(sets, out, **how).select(*[F.col(k).alias(f"{prefix}of_{k}") for k in keys], *[c.alias(n) for n, c in made.items()])
        same = [keyed[k].eqNullSafe(texts[f"{prefix}of_{k}"]) for k in keys]
        return keyed.join(texts, same).select(*df.columns, *made)

    def append(self, df: DataFrame, to: str, **how) -> DataFrame:
        """``df`` with the text appended to a column of text; the other columns are the parameters."""
        return df.withColumn(to, F.concat(F.coalesce(F.col(to), F.lit("")), self.column(df, **how)))

    def render_try(self, df: DataFrame, out: str = "out", *, allow_extra: bool = True, unchecked: bool = False, engine: str = "auto") -> DataFrame:
        """``df`` with the text, and where it failed with ``error_kind`` and ``error`` in place of it."""
        columns, faults = self._checks(df, allow_extra, unchecked)
        told = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("type mismatch: "), F.substr(message, F.lit(len("type mismatch for ") + 1))).alias("message"))) for test, kind, message in faults]
        return self._caught(df, columns, F.coalesce(*told) if told else None, engine, out)

    def render_json(self, df: DataFrame, json: str = "json", out: str = "out", **how) -> DataFrame:
        """Rows of a JSON column as the parameters: an absent key has its default, a null is none; kinds must fit
        (an int may be a float), and other keys are refused unless ``allow_extra``."""
        return self._render_records(df, F.col(json), out, **how)

    def render_cbor(self, df: DataFrame, cbor: str = "cbor", out: str = "out", **how) -> DataFrame:
        """Rows of a column of CBOR records as the parameters, as for JSON."""
        from .sources import binary, cbor_batches

        kinds = {d.name: d.type for d in self._columns()}
        if kinds and all(map(cbor_batches.supported, kinds.values())):
            typed, optional = _fresh(df, "_typed"), {d.name for d in self._columns() if not d.required}
            held = df.withColumn(typed, binary.cbor_struct(F.col(cbor), kinds, optional, how.get("allow_extra", False)))
            return self._render_records(held, F.col(typed)["json"], out, typed=F.col(typed), **how).drop(typed)
        return self._render_records(df, binary.json_text(F.col(cbor), binary.cbor), out, **how)

    def render_flexbuffers(self, df: DataFrame, buffers: str = "buffers", out: str = "out", **how) -> DataFrame:
        """Rows of a column of FlexBuffers records as the parameters, as for JSON."""
        from .sources import binary

        return self._render_records(df, binary.json_text(F.col(buffers), binary.flexbuffer), out, **how)

    def _render_records(self, df: DataFrame, json: Column, out: str, *, allow_extra: bool = False, engine: str = "auto", catch: bool = False, typed: Column | None = None) -> DataFrame:
        """``typed`` are values that are known without their JSON.  With ``catch`` errors are columns, as in ``render_try``.

        Each step is a projection of its own, so a record is parsed once, each parameter is looked up once, and its kind is asked for once."""
        at = {n: _fresh(df, n) for n in ("_variant", "_record", "_fault", "_params", *[f"{k}_{d.name}" for d in self._columns() for k in ("_own", "_kind")])}
        parsed = df.withColumn(at["_variant"], F.try_parse_json(json)).withColumn(at["_record"], F.col(at["_variant"]).try_cast("map<string,variant>"))
        record, rules = F.col(at["_record"]), Records()
        own = {d.name: F.col(at[f"_own_{d.name}"]) for d in self._columns()}
        shape = {d.name: F.col(at[f"_kind_{d.name}"]) for d in self._columns()}
        if own:
            parsed = parsed.withColumns({at[f"_own_{n}"]: F.try_element_at(record, F.lit(n)) for n in own})
            parsed = parsed.withColumns({at[f"_kind_{n}"]: F.schema_of_variant(own[n]) for n in own})
        faults: list[tuple[Column, str, Column]] = [(record.isNull(), "invalid_record", F.when(F.col(at["_variant"]).isNull(), "not JSON").otherwise("no object"))]
        required = [d.name for d in self._columns() if d.required]
        if required:
            faults.append((_any(own[n].isNull() for n in required), "missing_params", F.concat_ws(", ", *[F.when(own[n].isNull(), n) for n in required])))
        fields = []
        for d in self._columns():
            here = own[d.name].isNotNull()
            faults += [(here & test, "type_mismatch", F.concat(F.lit(f"'{d.name}"), text)) for test, text in rules.found(d.type, own[d.name], shape=shape[d.name])]
            value = rules.value(d.type, own[d.name])
            fields.append((value if d.required else F.when(here, value).otherwise(constant(d.default, d.type))).alias(d.name))
        if not allow_extra:
            known = sum((own[n].isNotNull().cast("int") for n in own), F.lit(0))
            extra = F.array_join(F.sort_array(F.array_except(F.map_keys(record), F.array(*map(F.lit, own)).cast("array<string>"))), ", ")
            faults.append((F.size(record) > known, "extra_params", extra))
        # Values are made of records without a fault only.
        told = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(PREFIX[kind]), message).alias("message"))) for test, kind, message in faults])
        fault, columns = F.col(at["_fault"]), {n: F.col(at["_params"]).getField(n) for n in own}
        made = F.when(fault.isNull(), F.struct(F.lit(1).alias("_"), *fields))
        if typed is not None:
            told = F.when(~typed["ok"], told)
            known = lambda d: typed["value"][d.name] if d.required else F.when(typed["there"][d.name], typed["value"][d.name]).otherwise(constant(d.default, d.type))
            made = F.when(typed["ok"], F.struct(F.lit(1).alias("_"), *[known(d).alias(d.name) for d in self._columns()])).otherwise(made)
        checked = parsed.withColumn(at["_fault"], told).drop(at["_variant"]).withColumn(at["_params"], made)
        if catch:
            return self._caught(checked, columns, fault, engine, out).drop(*at.values())
        bad = fault.isNotNull()
        text = lower(self.tree, columns.__getitem__) if self.engine(engine) == "catalyst" else python_column(self.tree, self._types(), columns, False, bad)
        raised = F.raise_error(F.regexp_replace(fault["message"], "^type mismatch: ", "type mismatch for ")).cast("string")
        return checked.withColumn(at["_fault"], F.when(bad, raised).otherwise(text)).drop(*[n for n in at.values() if n != at["_fault"]]).withColumn(out, fault).drop(at["_fault"])

    def document_parts(self, df: DataFrame, order: list[str], separator: str = "", size: int = 1 << 20, **how) -> DataFrame:
        """One document of all rows in order, of any size, as rows: part, start, bytes, text.  Parts follow each other; each has the texts that
        begin in its ``size`` bytes."""
        from .operators import documents

        name = _fresh(df, "_text")
        return documents.parts(self.render(df, name, **how), order, name, separator, size)

    def write_document(self, df: DataFrame, order: list[str], path: str, separator: str = "", size: int = 1 << 24, **how) -> None:
        """The parts as a table at ``path`` in the order of the document."""
        self.document_parts(df, order, separator, size, **how).sort("part").write.parquet(path)

    def document(self, df: DataFrame, order: list[str], separator: str = "", **how) -> DataFrame:
        """The document as one text, for those that one row can hold."""
        parts = self.document_parts(df, order, separator, **how)
        return parts.agg(F.coalesce(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY part)"), F.lit("")).alias("out"))

    # --- rendering of one record --------------------------------------------

    def render_dict(self, values: dict | None = None, allow_extra: bool = False) -> str:
        """One record, on the driver."""
        values = values or {}
        columns = self._columns()
        missing = self._missing(values)
        if missing:
            raise errors.MissingParams(missing)
        env = {d.name: check_value(d.type, values[d.name], d.name) if d.name in values else d.default for d in columns}
        extra = [n for n in values if n not in env]
        if extra and not allow_extra:
            raise errors.ExtraParams(extra)
        try:
            return interp.render(self.tree, env)
        except interp.Stopped as e:
            raise interp.as_error(e) from None

    def render_empty(self) -> str:
        return self.render_dict({})


def _any(tests) -> Column | None:
    got = None
    for test in tests:
        got = test if got is None else got | test
    return got


def _fresh_prefix(df: DataFrame) -> str:
    """What no column of ``df`` begins with."""
    prefix = "_piece"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spark_value(kind: VarType, value):
    """A Python value as ``createDataFrame`` takes it for the type's column."""
    if value is None:
        return None
    if isinstance(kind, Option):
        return spark_value(kind.inner, value)
    if isinstance(kind, List):
        return [spark_value(kind.item, v) for v in value]
    if isinstance(kind, Struct):
        return tuple(spark_value(t, value.get(n)) for n, t in kind.fields)
    if isinstance(kind, Enum) and not kind.plain:
        value = value if isinstance(value, dict) else {KIND: value}
        columns = {kind.column_of(v, n): t for v, fields in kind.variants for n, t in fields}
        mine = {kind.column_of(value[KIND], n): n for n, _ in kind.fields_of(value[KIND])}
        return (value[KIND], *(spark_value(t, value[mine[c]]) if c in mine else None for c, t in columns.items()))
    return float(value) if kind == FLOAT else value


def _narrow(kind: VarType, have: T.DataType) -> bool:
    """Numbers narrower than declared, by themselves or in a list."""
    kind = kind.inner if isinstance(kind, Option) else kind
    if isinstance(kind, List) and isinstance(have, T.ArrayType):
        return _narrow(kind.item, have.elementType)
    return kind in (INT, FLOAT) and have != to_spark(kind)
