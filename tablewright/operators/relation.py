"""Relation operators: annotations that may shadow columns, key lists, related rows, row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import SuspiciousOperation
from tablewright.functions import map_ref
from tablewright.plans.keys import Declared

#: Literals up to which a list stays an IN of the scan; longer ones become a semi-join with a local relation.
INLINE = 10


def annotate(df: DataFrame, **columns: Column) -> DataFrame:
    """df with named expressions. An expression reads the base columns, also where an earlier one shadows them."""
    return df.withColumns(columns) if columns else df


def rename_annotations(df: DataFrame, **names: str) -> DataFrame:
    """Columns renamed old=new; an unknown old name is an error."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise SuspiciousOperation(f"cannot rename {unknown}: no such annotation")
    return df.withColumnsRenamed(names)


def values(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; ``column__key`` reads a key of a map column and keeps that name."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in names or df.columns:
        base, _, key = name.partition("__")
        if name not in kinds and key and isinstance(kinds.get(base), T.MapType):
            out.append(map_ref(base, key).alias(name))
        elif name in kinds:
            out.append(F.col(f"`{name}`"))
        else:
            raise SuspiciousOperation(f"no column {name!r}")
    return df.select(*out)


def values_list(df: DataFrame, *names: str, flat: bool = False) -> list:
    """Rows as tuples, or with flat one column's values. Collects: for results that fit the driver."""
    if flat and len(names) != 1:
        raise SuspiciousOperation("flat needs exactly one column")
    rows = values(df, *names).collect()
    return [r[0] for r in rows] if flat else [tuple(r) for r in rows]


def in_values(df: DataFrame, column: str, keys: Iterable[Any] | DataFrame, field: str | None = None) -> DataFrame:
    """Rows whose column is among keys: literals, objects with a key attribute (rows, dicts), or a one-column frame.

    A short list is pushed to the scan; a long one is a semi-join with a local relation, which Catalyst
    broadcasts while it is small and which never grows the plan's text. Null keys match nothing.
    """
    if isinstance(keys, DataFrame):
        own = keys.select(F.col(field or keys.columns[0]).alias("_in"))
        return df.join(own, F.col(column) == F.col("_in"), "left_semi")
    plain = list(dict.fromkeys(v for v in (_key_of(k, field) for k in keys) if v is not None))
    if not plain:
        return df.where(F.lit(False))
    if len(plain) <= INLINE:
        return df.where(F.col(column).isin(plain))
    kind = df.schema[column].dataType
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    local = df.sparkSession.createDataFrame(pa.table({"_in": pa.array([str(v) if isinstance(kind, T.StringType) else v for v in plain], to_arrow_type(kind))}))
    return df.join(local, F.col(column) == F.col("_in"), "left_semi")


def _key_of(value: Any, field: str | None) -> Any:
    if isinstance(value, Row):
        return value[field] if field else value[0]
    if isinstance(value, Mapping):
        return value[field] if field else next(iter(value.values()))
    return value


def static_row(spark: SparkSession, **columns: Any) -> DataFrame:
    """One row of constants, to be united with a result."""
    return spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in columns.items()])


def union_static(df: DataFrame, **columns: Any) -> DataFrame:
    """df and a row of constants cast to its columns; columns that are not given are null."""
    row = static_row(df.sparkSession, **columns)
    return df.unionByName(row.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in df.schema.fields if f.name in columns]), allowMissingColumns=True)


def select_related(df: DataFrame, name: str, parent: DataFrame, column: str, parent_column: str, required: bool = False) -> DataFrame:
    """df with the row that ``column`` refers to as a struct column; null where nothing is referred to or found."""
    packed = parent.select(F.col(parent_column).alias("_ref"), F.struct(*[F.col(f"`{c}`") for c in parent.columns]).alias(name))
    return df.join(packed, F.col(column) == F.col("_ref"), "inner" if required else "left").drop("_ref")


def related_or_null(df: DataFrame, name: str, columns: Iterable[str], prefix: str = "") -> DataFrame:
    """The columns of a flat join as a struct; null if all of them are null."""
    columns = list(columns)
    empty = F.lit(True)
    for c in columns:
        empty = empty & F.col(c).isNull()
    packed = F.when(~empty, F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in columns]))
    return df.withColumn(name, packed).drop(*columns)


def group_annotate(df: DataFrame, by: Iterable[str | Column], **aggregates: Column) -> DataFrame:
    """GROUP BY with named aggregates, which may have the names of columns they read."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])


def ordered(df: DataFrame, *names: str) -> DataFrame:
    """ORDER BY with nulls last ascending and first descending (``-name``), as relational databases have it."""
    return df.orderBy(*[F.col(n[1:]).desc_nulls_first() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names])


def top_k(df: DataFrame, k: int, *names: str) -> DataFrame:
    """The first k rows in order, without sorting all."""
    return ordered(df, *names).limit(k)


def get(df: DataFrame) -> Row:
    """The only row; an error if there is none or several."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError("no row" if not rows else "more than one row")
    return rows[0]


def project(df: DataFrame, table: Declared) -> DataFrame:
    """The declared columns by name, cast to their types; unknown columns are dropped and missing ones null."""
    have = set(df.columns)
    return df.select(*[_converted(df, f.stored, f.type).alias(f.name) if f.stored in have else F.lit(None).cast(_storable(f.type)).alias(f.name) for f in table.fields])


def _storable(kind: str) -> str:
    return {"json": "variant", "uuid": "string"}.get(kind.lower(), kind)


def _converted(df: DataFrame, name: str, kind: str) -> Column:
    value, own = F.col(f"`{name}`"), df.schema[name].dataType
    if kind.lower() in ("variant", "json") and isinstance(own, T.StringType):
        return F.parse_json(value)
    if kind.lower() == "uuid":
        return F.lower(value.cast("string"))
    return value.cast(_storable(kind))


def models_from(df: DataFrame, make: Callable[..., Any] = dict, table: Declared | None = None, related: Mapping[str, Callable[..., Any]] | None = None) -> Iterator[Any]:
    """Objects from rows, read partition by partition. Struct columns named in related become objects, or None."""
    rows = project_keeping(df, table, related) if table else df
    for row in rows.toLocalIterator():
        yield model_from_dict(row.asDict(), make, related)


def project_keeping(df: DataFrame, table: Declared, related: Mapping[str, Any] | None) -> DataFrame:
    own = project(df, table).columns
    structs = [c for c in related or {} if c in df.columns]
    have = set(df.columns)
    cols = [_converted(df, f.stored, f.type).alias(f.name) for f in table.fields if f.stored in have and f.name in own]
    return df.select(*cols, *structs)


def model_from(df: DataFrame, make: Callable[..., Any] = dict, table: Declared | None = None, related: Mapping[str, Callable[..., Any]] | None = None) -> Any:
    """The first row's object, or None."""
    return next(models_from(df.limit(1), make, table, related), None)


def model_from_dict(row: Mapping[str, Any], make: Callable[..., Any] = dict, related: Mapping[str, Callable[..., Any]] | None = None) -> Any:
    """An object from a row's dict; a related row whose values are all null is None."""
    out = dict(row)
    for name, other in (related or {}).items():
        inner = out.get(name)
        inner = inner.asDict() if isinstance(inner, Row) else inner
        out[name] = other(**inner) if inner and any(v is not None for v in inner.values()) else None
    return make(**out)


def local_fields(table: Declared) -> list[str]:
    """The stored columns of a declared table, in order."""
    return [f.stored for f in table.fields]


def peek(rows: Iterable[Any] | None) -> list[Any] | None:
    """The rows as a list, or None if there are none; generators are read once."""
    rows = list(rows or ())
    return rows or None
