"""Column builders. Everything here stays inside whole-stage code generation: no user functions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Any) -> Column:
    """A Column for a Column, a column name or, with ``value()``-like literals, the literal itself."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def map_ref(column: str | Column, key: str) -> Column:
    """The value of a map column under a key, null where the key is missing. Dots in a name walk structs (joined relations)."""
    return F.try_element_at(as_column(column), F.lit(key))


def map_of(values: Mapping[str, Any]) -> Column:
    """A string map of literals and expressions; None stays null, all else becomes text; an empty dict is an empty map."""
    if not values:
        return F.create_map().cast("map<string,string>")
    parts = []
    for key, value in values.items():
        parts += [F.lit(str(key)), F.lit(None).cast("string") if value is None else _text(value)]
    return F.create_map(*parts)


def _text(value: Any) -> Column:
    if isinstance(value, Column):
        return value.cast("string")
    if isinstance(value, bool):
        return F.lit(str(value))
    return F.lit(str(value))


def map_update(column: str | Column, values: Mapping[str, Any]) -> Column:
    """A map column with keys set; the new value wins (the session bootstrap sets LAST_WIN)."""
    base = F.map_filter(as_column(column), lambda k, _: ~k.isin(*[str(x) for x in values])) if values else as_column(column)
    return F.map_concat(base, map_of(values)) if values else base


def coerce_map(value: Any) -> Any:
    """What is written to a map column: texts for all but None and Columns; a list becomes a list of texts."""
    if isinstance(value, Mapping):
        return {str(k): v if v is None or isinstance(v, Column) else str(v) for k, v in value.items()}
    if isinstance(value, list):
        return [str(v) for v in value]
    return value


def coerced_map_column(column: str | Column) -> Column:
    """Any map column as map<string,string>."""
    return as_column(column).cast("map<string,string>")


def epoch(column: str | Column) -> Column:
    """Seconds since 1970 as a double with microseconds. Zone-less timestamps count as UTC."""
    return F.unix_micros(as_column(column).cast("timestamp")) / F.lit(1_000_000.0)


def last_not_null(*columns: str | Column, default: Any = None, first_wins: bool = False) -> Column:
    """The last of the columns that is not null, as text, or the default. ``first_wins`` turns the order round."""
    order = columns if first_wins else tuple(reversed(columns))
    return F.coalesce(*[as_column(c).cast("string") for c in order], F.lit(default).cast("string"))


def excluded(name: str) -> Column:
    """The incoming row's value of a column, in conditions and values of an upsert."""
    return F.col(f"excluded.`{name}`")


def equals(left: Any, right: Any) -> Column:
    return as_column(left) == as_column(right)


def is_same(left: Any, right: Any) -> Column:
    """IS: never null; two nulls are the same."""
    return as_column(left).eqNullSafe(as_column(right))


def greater(left: Any, right: Any) -> Column:
    return as_column(left) > as_column(right)


def at_most(left: Any, right: Any) -> Column:
    return as_column(left) <= as_column(right)


def both(left: Any, right: Any) -> Column:
    return as_column(left) & as_column(right)


def to_bool(value: Any) -> Column:
    return as_column(value).cast("boolean")


def case(*branches: tuple[Column, Any], default: Any = None) -> Column:
    """The value of the first branch whose condition is true."""
    out = None
    for condition, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def truncated(unit: str, column: str | Column, zone: str = "UTC") -> Column:
    """A timestamp cut to its unit in a zone."""
    value = as_column(column).cast("timestamp")
    return F.date_trunc(unit, value) if zone == "UTC" else F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(value, zone)), zone)
