"""Values that are computed once, however often an expression uses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value bound to a lambda variable, so that it is neither repeated nor recomputed."""

    def bound(v: Column) -> Column:
        return f(v)

    return F.transform(F.array(x), bound)[0]
