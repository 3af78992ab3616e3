"""A value computed once and used many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once a row even where ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)
