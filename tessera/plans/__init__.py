"""EXPLAIN (S9): what Catalyst made of a query."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import DataFrame

MODES = {"simple", "extended", "codegen", "cost", "formatted"}
UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
#: Nodes that make any number of rows of one, which the optimizer's estimates don't see.
OPEN_ENDED = re.compile(r"^[ :+-]*(\*\(\d+\) )?(Generate|\w*MapIn|FlatMap|MapPartitions|\w*UDTF|ScriptTransformation)", re.MULTILINE)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: "extended" has the logical plans too, "formatted" the physical one in detail."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def estimated_bytes(df: DataFrame) -> float:
    """The optimizer's estimate of what the rows take; infinite where there is none to rely on."""
    plan = explain(df, "cost").partition("== Physical Plan ==")[0]
    found = re.search(r"^.*, Statistics\(sizeInBytes=([\d.E+]+) ([KMGTPE]iB|B)\b", plan, re.MULTILINE)
    return float(found[1]) * 1024 ** UNITS.index(found[2]) if found and not OPEN_ENDED.search(plan) else float("inf")
