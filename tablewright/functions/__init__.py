"""Scalar, boolean, map and date expressions as Column builders."""

from tablewright.functions.expressions import (
    at_most,
    both,
    case,
    coerce_map,
    epoch,
    equals,
    excluded,
    greater,
    is_same,
    last_not_null,
    map_of,
    map_ref,
    map_update,
    to_bool,
    truncated,
)

__all__ = [
    "at_most", "both", "case", "coerce_map", "epoch", "equals", "excluded", "greater", "is_same", "last_not_null", "map_of", "map_ref", "map_update", "to_bool", "truncated",
]
