"""Rendering of Arrow batches: by columns where that can be done, else row by row."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import interp
from ..plans import tree as N
from ..plans.types import VarType
from . import columnar
from .lower import PREFIX


def python_column(node: N.Node, params: dict[str, VarType], columns: dict[str, Column], catch: bool = False, bad: Column | None = None) -> Column:
    """An Arrow UDF over a struct of the parameters that the tree reads; rows that are ``bad`` don't get there.
    With ``catch`` it gives a struct of text, kind and message."""
    used = sorted(N.params_of(node))

    def by_row(row: dict) -> dict:
        env = {n: interp.shape(params[n], row[n]) for n in used}
        try:
            return {"text": interp.render(node, env)}
        except interp.Stopped as e:
            if not catch:
                raise interp.as_error(e) from None
            return {"kind": e.kind, "message": PREFIX[e.kind] + e.message}

    def render(rows: pa.Array) -> pa.Array:
        known = rows.is_valid()
        asked = rows.filter(known)
        try:
            texts, stopped = columnar.render(node, asked)
        except (columnar.Plain, pa.ArrowException):
            texts, stopped = pa.nulls(len(asked), pa.string()), np.ones(len(asked), bool)
        told = [by_row(row) for row in asked.filter(pa.array(stopped)).to_pylist()]
        # Places: of a text made by columns, of one made by row behind all of those, or of none.
        place = np.where(stopped, len(asked) + np.cumsum(stopped) - 1, np.arange(len(asked)))
        spread = np.full(len(rows), -1)
        spread[known.to_numpy(zero_copy_only=False)] = place
        at = pa.array(spread, mask=spread < 0)
        parts = {"text": pa.concat_arrays([texts, pa.array([r.get("text") for r in told], pa.string())]).take(at)}
        if not catch:
            return parts["text"]
        for name in ("kind", "message"):
            parts[name] = pa.concat_arrays([pa.nulls(len(asked), pa.string()), pa.array([r.get(name) for r in told], pa.string())]).take(at)
        return pa.StructArray.from_arrays(list(parts.values()), names=list(parts))

    run = F.arrow_udf(render, "text string, kind string, message string" if catch else "string")
    row = F.struct(*[columns[n].alias(n) for n in used], F.lit(1).alias("_"))
    return run(row if bad is None else F.when(~bad, row))
