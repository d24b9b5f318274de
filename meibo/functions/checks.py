"""Cell checks. A check names a column and says, as a ``Column``, when a cell breaks it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from meibo.functions.text import is_blank


class Check(NamedTuple):
    name: str
    column: str
    broken: Callable[[Column], Column]


def required(column: str, name: str = "required") -> Check:
    """The cell must not be blank."""
    return Check(name, column, is_blank)


def matches(column: str, pattern: str, name: str = "pattern") -> Check:
    """The whole cell must match ``pattern``; a blank cell is left to :func:`required`."""
    return Check(name, column, lambda c: ~is_blank(c) & ~c.rlike(f"\\A(?:{pattern})\\z"))


def in_range(column: str, low=None, high=None, name: str = "range") -> Check:
    """The cell, read as a number, must lie within the bounds; no number at all also fails."""

    def broken(c: Column) -> Column:
        number = c.try_cast("double")
        out = number.isNull()
        if low is not None:
            out = out | (number < low)
        if high is not None:
            out = out | (number > high)
        return ~is_blank(c.cast("string")) & out

    return Check(name, column, broken)


def max_length(column: str, limit: int, name: str = "length") -> Check:
    """The cell may hold at most ``limit`` characters."""
    return Check(name, column, lambda c: F.length(c) > limit)


def one_of(column: str, values: list[str], name: str = "value") -> Check:
    """The cell must be one of ``values``."""
    return Check(name, column, lambda c: ~is_blank(c) & ~c.isin(values))
