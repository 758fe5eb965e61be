"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Inside a lambda Spark does not share common sub-expressions, so the value is
    bound as the element of a one-element array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_array(values: Sequence, sql_type: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{sql_type}>")


def symbol_lookup(symbol: Column, table: Mapping[str, int], sql_type: str) -> Column:
    """Value of a one-letter symbol: an array indexed by its character code.

    An unknown symbol gives NULL. The array is a constant, so the lookup takes
    the same time for every symbol and needs no join.
    """
    slots = [table.get(chr(code)) for code in range(max(map(ord, table)) + 1)]
    return F.try_element_at(literal_array(slots, sql_type), F.ascii(symbol) + 1)


def chars(text: Column) -> Column:
    """The characters of a string as an array."""
    return F.split(text, "")
