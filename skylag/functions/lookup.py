"""Lookups into small fixed tables, as foldable literals.

A map literal keeps the lookup inside the scan's code-generated stage: no join
node, no broadcast to wait for, and the same expression works on a stream. Only
tables whose size is fixed in the source are looked up this way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylag.functions import fixed


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def literal_map(table: Mapping) -> Column:
    items = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    return F.expr(f"map({items})")


def literal_struct_map(table: Mapping[str, tuple], names: Sequence[str]) -> Column:
    items = []
    for key, row in table.items():
        fields = ", ".join(f"'{n}', {_literal(v)}" for n, v in zip(names, row, strict=True))
        items.append(f"{_literal(key)}, named_struct({fields})")
    return F.expr(f"map({', '.join(items)})")


def lookup(key: Column, table: Mapping, default) -> Column:
    return F.coalesce(literal_map(table)[key], F.lit(default))


def airport(code: Column) -> Column:
    """Struct (lon, lat) of an airport, NULL when the code is unknown."""
    return literal_struct_map(fixed.AIRPORTS, ("lon", "lat"))[F.upper(code)]


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def number(column: str | Column) -> Column:
    """The column as DOUBLE with NaN turned into NULL.

    Spark orders NaN above every number, so `NaN >= 15` would be true.
    """
    col = F.col(column) if isinstance(column, str) else column
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def half_even(column: str | Column, digits: int) -> Column:
    """Round the binary value, ties to even, as IEEE arithmetic does.

    Spark's `round` works on the decimal text and takes ties up: 0.3 * 0.95 * 0.97 is
    slightly below 0.27645 and belongs to 0.2764, not to 0.2765.
    """
    col = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.rint(col * scale) / scale
