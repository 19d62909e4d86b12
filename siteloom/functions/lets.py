"""Values within expressions: computed once where they are used often, and numbers read from texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once however often ``f`` uses it. Spark shares no subexpressions within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def number(text: Column, kind: str = "double") -> Column:
    """A text as a number; null if it isn't one. A missing one, ".", isn't cast: a cast that fails makes an exception, which takes hundreds of times as long."""
    return F.when(text != ".", text.try_cast(kind))
