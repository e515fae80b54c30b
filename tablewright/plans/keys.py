"""Declared tables: fields, keys and checks, and the queries that find rows which break them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import IntegrityError, SuspiciousOperation


@dataclass(frozen=True)
class Field:
    """A column: its name, Spark type and what fills it when a row does not.

    default fills inserts; on_insert and on_write fill inserts and every write (creation and update
    stamps), as a literal, a Column or a callable that gives one. column is the stored name where it differs.
    """

    name: str
    type: str
    nullable: bool = True
    default: Any = None
    on_insert: Any = None
    on_write: Any = None
    column: str | None = None
    references: tuple[str, str] | None = None
    check: str | None = None

    @property
    def stored(self) -> str:
        return self.column or self.name

    @property
    def has_default(self) -> bool:
        return self.default is not None


Part = str | tuple[str, str]


@dataclass(frozen=True)
class UniqueKey:
    """A unique key over columns and (map column, key) parts; partial with a condition, lower-cased if case-insensitive.

    As in SQL, a row with a null part never collides. A condition that is not true takes a row out of the key.
    """

    parts: tuple[Part, ...]
    name: str = ""
    condition: str | None = None
    case_insensitive: bool = False

    def __post_init__(self):
        parts = (self.parts,) if isinstance(self.parts, str) else tuple(self.parts)
        object.__setattr__(self, "parts", parts)

    def columns(self) -> list[Column]:
        """The key expressions over a table's own columns."""
        out = []
        for part in self.parts:
            value = F.col(f"`{part}`") if isinstance(part, str) else F.try_element_at(F.col(f"`{part[0]}`"), F.lit(part[1]))
            out.append(F.lower(value) if self.case_insensitive else value)
        return out

    def covers(self) -> Column:
        """Whether a row takes part: condition true, no part null."""
        ok = F.coalesce(F.expr(self.condition), F.lit(False)) if self.condition else F.lit(True)
        for column in self.columns():
            ok = ok & column.isNotNull()
        return ok

    def label(self, table: str) -> str:
        return self.name or "_".join([table, "_".join(p if isinstance(p, str) else "_".join(p) for p in self.parts), "unique"])


def conditional_unique(fields: Sequence[str], condition: str, name: str = "") -> UniqueKey:
    return UniqueKey(tuple(fields), name, condition)


def case_insensitive_unique(fields: Sequence[str], name: str = "") -> UniqueKey:
    return UniqueKey(tuple(fields), name, None, True)


def map_unique(column: str, *keys: str, name: str = "") -> UniqueKey:
    """Unique over one or several keys of a map column together."""
    return UniqueKey(tuple((column, k) for k in keys), name)


@dataclass(frozen=True)
class Required:
    """A key that a map column must have with a value."""

    column: str
    key: str

    def label(self, table: str) -> str:
        return f"{table}_{self.column}_required_{self.key}"

    @property
    def condition(self) -> str:
        key = self.key.replace("'", "\\'")
        return f"try_element_at(`{self.column}`, '{key}') IS NOT NULL"


@dataclass(frozen=True)
class Check:
    """A condition that no row may make false; null passes."""

    condition: str
    name: str = ""

    def label(self, table: str) -> str:
        return self.name or f"{table}_check"


@dataclass(frozen=True)
class Index:
    """A plain index: kept as metadata, since Spark has none."""

    fields: tuple[str, ...]
    name: str = ""
    method: str = "btree"


@dataclass(frozen=True)
class Declared:
    """A declared table."""

    name: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ("id",)
    keys: tuple[UniqueKey, ...] = ()
    required: tuple[Required, ...] = ()
    checks: tuple[Check, ...] = ()
    indexes: tuple[Index, ...] = ()
    comment: str = ""
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("fields", "primary_key", "keys", "required", "checks", "indexes"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))

    def by_name(self, name: str) -> Field:
        """A field by its name, its stored name, or ``pk`` for a single primary key."""
        if name == "pk" and len(self.primary_key) == 1:
            name = self.primary_key[0]
        for f in self.fields:
            if name in (f.name, f.stored):
                return f
        raise SuspiciousOperation(f"{self.name} has no field {name!r}")

    def all_keys(self) -> list[UniqueKey]:
        return [UniqueKey(tuple(self.by_name(p).stored for p in self.primary_key), f"{self.name}_pkey"), *self.keys]

    def schema(self) -> str:
        return ", ".join(f"`{f.stored}` {f.type}" for f in self.fields)


def unique_violations(df: DataFrame, key: UniqueKey) -> DataFrame:
    """key parts (k0, k1, ...) that several rows have, and how many."""
    names = [f"k{i}" for i in range(len(key.parts))]
    keyed = df.where(key.covers()).select(*[c.alias(n) for c, n in zip(key.columns(), names)])
    return keyed.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")


def required_violations(df: DataFrame, rule: Required) -> DataFrame:
    """Rows without the required key."""
    return df.where(~F.coalesce(F.expr(rule.condition), F.lit(False)))


def check_violations(df: DataFrame, rule: Check) -> DataFrame:
    """Rows for which the condition is false."""
    return df.where(~F.coalesce(F.expr(rule.condition), F.lit(True)))


def foreign_key_violations(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is not null and names no parent."""
    keys = parent.select(F.col(parent_column).alias("_key"))
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def validate(df: DataFrame, table: Declared, parents: Callable[[str], DataFrame] | None = None) -> None:
    """Raise IntegrityError for the first rule that df breaks. One job for each rule, each stops at its first hit."""
    for f in table.fields:
        if not f.nullable and not df.where(F.col(f"`{f.stored}`").isNull()).isEmpty():
            raise IntegrityError(f"null in {table.name}.{f.stored}")
        if f.check and not check_violations(df, Check(f.check)).isEmpty():
            raise IntegrityError(f"{table.name}.{f.stored} breaks {f.check}")
        if f.references and parents is not None and not foreign_key_violations(df, f.stored, parents(f.references[0]), f.references[1]).isEmpty():
            raise IntegrityError(f"{table.name}.{f.stored} names a row that {f.references[0]} lacks")
    for key in table.all_keys():
        if not unique_violations(df, key).isEmpty():
            raise IntegrityError(f"duplicate key in {key.label(table.name)}")
    for rule in table.required:
        if not required_violations(df, rule).isEmpty():
            raise IntegrityError(f"missing key in {rule.label(table.name)}")
    for rule in table.checks:
        if not check_violations(df, rule).isEmpty():
            raise IntegrityError(f"rows break {rule.label(table.name)}")
