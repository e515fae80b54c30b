"""Conflict-aware insert as one lazy plan.

plan_upsert joins the target with the incoming rows once, on the key that the conflict target names,
and yields every row of the new table with the action that made it. Neither side's null keys, nor rows
that a partial key leaves out, can match: their join key is null, and a salt spreads them over all tasks.
A batch of up to ``small`` rows is broadcast instead, so the target is scanned and never shuffled.
"""

from __future__ import annotations

import enum
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import CardinalityViolation, SuspiciousOperation
from tablewright.plans.keys import Declared, UniqueKey

SMALL = 100_000
_SALTS = 4096


class ConflictAction(enum.Enum):
    NOTHING = "NOTHING"
    UPDATE = "UPDATE"

    @classmethod
    def all(cls) -> list["ConflictAction"]:
        return list(cls)

    @classmethod
    def values(cls) -> list[str]:
        return [x.value for x in cls]


@dataclass(frozen=True)
class ConflictSpec:
    """What makes rows conflict and what then happens.

    target: column names and (map column, key) pairs, or a declared UniqueKey. index_predicate: the
    condition of a partial key, over bare column names. update_condition: over bare names (the stored row)
    and excluded.x (the incoming one); False means NOTHING. update_values: None sets all supplied
    columns from the incoming row; an empty dict means NOTHING.
    """

    target: UniqueKey | tuple
    action: ConflictAction = ConflictAction.UPDATE
    index_predicate: Column | str | None = None
    update_condition: Column | str | bool | None = None
    update_values: Mapping[str, Any] | None = None

    def __post_init__(self):
        if not isinstance(self.action, ConflictAction):
            raise SuspiciousOperation(f"{self.action!r} is not a conflict action")
        if not isinstance(self.target, UniqueKey):
            if self.target is None or isinstance(self.target, (str, bytes)) or not isinstance(self.target, Sequence) or not self.target:
                raise SuspiciousOperation(f"conflict target must be a list of fields, not {self.target!r}")
            for part in self.target:
                ok = isinstance(part, str) or (isinstance(part, tuple) and len(part) == 2 and all(isinstance(x, str) for x in part))
                if not ok:
                    raise SuspiciousOperation(f"{part!r} is neither a field nor a (map field, key) pair")
            object.__setattr__(self, "target", tuple(self.target))

    def effective_action(self) -> ConflictAction:
        """NOTHING where the condition is a plain value that is false (False, 0, empty text), or where no value is to be updated."""
        condition = self.update_condition
        never = condition is not None and not isinstance(condition, Column) and not condition
        nothing = never or (self.update_values is not None and not self.update_values)
        return ConflictAction.NOTHING if nothing else self.action

    def key(self, table: Declared | None = None) -> UniqueKey:
        """The key that the target names; a declared key over the same fields lends its expressions."""
        if isinstance(self.target, UniqueKey):
            return self.target
        if table is None:
            return UniqueKey(self.target)
        parts = tuple(table.by_name(p).stored if isinstance(p, str) else (table.by_name(p[0]).stored, p[1]) for p in self.target)
        for key in table.keys:
            stored = tuple(table.by_name(p).stored if isinstance(p, str) else (table.by_name(p[0]).stored, p[1]) for p in key.parts)
            if stored == parts and key.case_insensitive:
                return UniqueKey(parts, key.name, None, True)
        return UniqueKey(parts)


@dataclass(frozen=True)
class Upsert:
    """merged: the new table with ``_action`` (insert, update, keep)."""

    merged: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.merged.drop("_action")

    @property
    def returning(self) -> DataFrame:
        """The rows that were inserted or updated, with ``_action``."""
        return self.merged.where("_action != 'keep'")


def _expression(value: Column | str | bool | None) -> Column | None:
    return None if value is None else F.expr(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def _keyed(df: DataFrame, key: UniqueKey, predicate: Column | None, names: list[str]) -> DataFrame:
    ok = key.covers() if predicate is None else key.covers() & F.coalesce(predicate, F.lit(False))
    return df.withColumns({n: F.when(ok, c) for n, c in zip(names, key.columns())})


def duplicate_keys(incoming: DataFrame, key: UniqueKey, predicate: Column | str | None = None) -> DataFrame:
    """Keys (k0, k1, ...) that several incoming rows have, and how many (n)."""
    names = [f"k{i}" for i in range(len(key.parts))]
    keyed = _keyed(incoming, key, _expression(predicate), names).where(" and ".join(f"{n} is not null" for n in names))
    return keyed.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")


def first_by_key(incoming: DataFrame, names: list[str], order: Column) -> DataFrame:
    """One row for each key, the first in order; rows with a null key stay but for whole-row repeats."""
    data = [c for c in incoming.columns if c not in names]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data]), {"ignoreNullFields": "false"})
    has = F.lit(True)
    for n in names:
        has = has & F.col(n).isNotNull()
    # keyless rows are their own key, so one aggregation with map-side combine serves both
    grouped = incoming.withColumn("_whole", F.when(~has, whole)).withColumn("_order", order)
    picked = grouped.groupBy(*names, "_whole").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in data]), "_order").alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) for c in data], *names)


def _salt(key: str, df: DataFrame, prefix: str) -> Column:
    """0 for rows with a key; rows without one are spread by a hash of their contents."""
    plain = [f"{prefix}`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(_SALTS))).otherwise(F.lit(0).cast("bigint"))


def plan_upsert(
    target: DataFrame,
    incoming: DataFrame,
    spec: ConflictSpec,
    table: Declared | None = None,
    order: Column | None = None,
    small: int = 0,
    check_duplicates: bool = False,
    set_columns: Sequence[str] | None = None,
) -> Upsert:
    """The target after inserting ``incoming`` under ``spec``.

    incoming may lack columns of the target: they are null in inserted rows and kept in updated ones.
    order: which of several incoming rows of a key comes first (NOTHING), by default Spark's row order.
    small: broadcast an incoming side of up to so many rows (counted first). check_duplicates: count keys
    that would update a row twice and raise. set_columns: what UPDATE sets, by default all of incoming's but the key.
    """
    names = target.columns
    unknown = [c for c in incoming.columns if c not in names]
    if unknown:
        raise SuspiciousOperation(f"the target has no columns {unknown}")
    key, predicate, action = spec.key(table), _expression(spec.index_predicate), spec.effective_action()
    keys = [f"_k{i}" for i in range(len(key.parts))]
    if check_duplicates and action is ConflictAction.UPDATE and not duplicate_keys(incoming, key, predicate).isEmpty():
        raise CardinalityViolation("the batch would update a row twice")
    keyed = _keyed(incoming, key, predicate, keys)
    if action is ConflictAction.NOTHING:
        keyed = first_by_key(keyed, keys, order if order is not None else F.monotonically_increasing_id())
    supplied = list(incoming.columns)
    packed = keyed.select(F.struct(*[F.col(f"`{c}`") for c in supplied]).alias("excluded"), *[F.col(k).alias(f"_x{k}") for k in keys])
    stored = _keyed(target, key, predicate, keys).withColumn("_stored", F.lit(True)).alias("t")
    few = small and incoming.limit(small + 1).count() <= small
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_x{k}"))
    if few:
        packed = F.broadcast(packed)
        left = stored.join(packed, match, "left")
        met = stored.join(packed, match, "inner").select(*[F.col(f"_x{k}").alias(f"_m{k}") for k in keys]).distinct()
        fresh = packed.join(F.broadcast(met), [F.col(f"_x{k}") == F.col(f"_m{k}") for k in keys], "left_anti")
        nothing = {c: F.lit(None).cast(stored.schema[c].dataType) for c in stored.columns}
        both = left.unionByName(fresh.select(*[nothing[c].alias(c) for c in stored.columns], "excluded", *[f"_x{k}" for k in keys]))
        both = both.alias("t")
    else:
        stored = stored.withColumn("_ts", _salt(keys[0], target, "")).alias("t")
        packed = packed.withColumn("_xs", _salt(f"_x{keys[0]}", incoming, "excluded."))
        both = stored.join(packed, match & (F.col("_ts") == F.col("_xs")), "full")
    matched = F.col("_stored").isNotNull() & F.col("excluded").isNotNull()
    inserted = F.col("_stored").isNull()
    change = F.lit(False)
    new: dict[str, Column] = {}
    if action is ConflictAction.UPDATE:
        condition = _expression(spec.update_condition)
        change = matched if condition is None else matched & F.coalesce(condition, F.lit(False))
        if spec.update_values is not None:
            new = {k: v if isinstance(v, Column) else F.lit(v) for k, v in spec.update_values.items()}
            stray = [k for k in new if k not in names]
            if stray:
                raise SuspiciousOperation(f"the target has no columns {stray}")
        else:
            plain = {p for p in key.parts if isinstance(p, str)} if not key.case_insensitive else set()
            for c in set_columns if set_columns is not None else supplied:
                if c not in plain:
                    new[c] = F.col(f"excluded.`{c}`")
    done = F.when(inserted, "insert").when(change, "update").otherwise("keep")
    both = both.withColumn("_action", done)
    out = []
    for c in names:
        kind = target.schema[c].dataType
        own, fresh = F.col(f"t.`{c}`"), F.col(f"excluded.`{c}`") if c in supplied else F.lit(None)
        value = F.when(F.col("_action") == "insert", fresh.cast(kind))
        if c in new:
            value = value.when(F.col("_action") == "update", new[c].cast(kind))
        out.append(value.otherwise(own).alias(c))
    return Upsert(both.select(*out, "_action"))


def fill_defaults(incoming: DataFrame, table: Declared) -> tuple[DataFrame, list[str]]:
    """incoming with every declared column that has a default or a stamp, and the columns an UPDATE sets.

    Supplied columns are inserted and updated; defaults and creation stamps only inserted; write stamps both.
    """
    supplied = [table.by_name(c).stored for c in incoming.columns]
    out = incoming.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(incoming.columns, supplied)])
    update = list(supplied)
    for f in table.fields:
        made = next((x for x in (f.on_write, f.on_insert, f.default) if x is not None), None)
        if f.stored in supplied or made is None:
            continue
        made = made() if callable(made) else made
        out = out.withColumn(f.stored, (made if isinstance(made, Column) else F.lit(made)).cast(f.type))
        if f.on_write is not None:
            update.append(f.stored)
    return out, update
