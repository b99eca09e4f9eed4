"""Expression builders with the engine's dialect (X1-X11): everything stays a JVM column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Integer division towards zero; null where the divisor is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null where the divisor is 0."""
    return a % F.nullif(b, F.lit(0).cast("long"))


def truth(p: Column, is_boolean: bool) -> Column:
    """An integer counts as true where it isn't 0."""
    return p if is_boolean else p != 0


def as_integer(p: Column) -> Column:
    """A predicate as it is projected: 1, 0 or null."""
    return p.cast("int").cast("long")


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def like_pattern(pattern: str) -> str:
    """Backslashes before anything but % and _ are literal; Spark wants them doubled."""
    return re.sub(r"\\(?![%_])", r"\\\\", pattern)


def like(a: Column, pattern: str) -> Column:
    return a.like(like_pattern(pattern))


def all_of(predicates: list[Column]) -> Column:
    """P5: one predicate of several; Catalyst takes them apart again to push each as far down as it goes."""
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)


def key_hash(*columns: Column | str) -> Column:
    """A 64-bit hash of the columns' values; null is a value like others."""
    return F.xxhash64(*columns)
