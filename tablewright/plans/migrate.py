"""Versioned schema changes: operations with a way back, state, differences, and the shadow-copy data migrator."""

from __future__ import annotations

import enum
from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from tablewright.errors import SuspiciousOperation
from tablewright.plans.keys import Declared, validate
from tablewright.plans.partitioning import Partition, Partitioning


@dataclass
class TableState:
    declared: Declared
    partitioning: Partitioning | None = None
    partitions: dict[str, Partition] = field(default_factory=dict)


@dataclass
class ViewState:
    query: Any
    materialized: bool = False
    with_data: bool = True


@dataclass
class State:
    """What the operations so far have declared."""

    tables: dict[str, TableState] = field(default_factory=dict)
    views: dict[str, ViewState] = field(default_factory=dict)

    def clone(self) -> "State":
        tables = {k: TableState(v.declared, v.partitioning, dict(v.partitions)) for k, v in self.tables.items()}
        return State(tables, {k: replace(v) for k, v in self.views.items()})


class Operation(ABC):
    """One change: of the state, of the catalog, and back. before is the state without it."""

    state_only = False

    @abstractmethod
    def apply_state(self, state: State) -> None: ...

    def forwards(self, catalog, before: State, after: State) -> None: ...

    def backwards(self, catalog, before: State, after: State) -> None: ...

    def describe(self) -> str:
        return type(self).__name__


@dataclass
class CreateTable(Operation):
    declared: Declared
    partitioning: Partitioning | None = None

    def apply_state(self, state):
        declared = self.declared
        if self.partitioning:
            declared = replace(declared, primary_key=self.partitioning.primary_key(declared.primary_key))
        state.tables[self.declared.name] = TableState(declared, self.partitioning)

    def forwards(self, catalog, before, after):
        catalog.create_table(self.declared, partitioning=self.partitioning)

    def backwards(self, catalog, before, after):
        catalog.drop_table(self.declared.name)

    def describe(self):
        return f"Create {'partitioned ' if self.partitioning else ''}table {self.declared.name}"


@dataclass
class DeleteTable(Operation):
    name: str

    def apply_state(self, state):
        del state.tables[self.name]

    def forwards(self, catalog, before, after):
        catalog.drop_table(self.name)

    def backwards(self, catalog, before, after):
        own = before.tables[self.name]
        catalog.create_table(own.declared, partitioning=own.partitioning)
        for p in own.partitions.values():
            catalog.add_partition(self.name, p)

    def describe(self):
        return f"Delete table {self.name}"


@dataclass
class AlterTable(Operation):
    """New fields, keys, required keys, checks or indexes of a table."""

    name: str
    changes: dict[str, Any]

    def apply_state(self, state):
        own = state.tables[self.name]
        own.declared = replace(own.declared, **self.changes)

    def forwards(self, catalog, before, after):
        catalog.alter(self.name, **self.changes)

    def backwards(self, catalog, before, after):
        old = before.tables[self.name].declared
        catalog.alter(self.name, **{k: getattr(old, k) for k in self.changes})

    def describe(self):
        return f"Alter {', '.join(self.changes)} of table {self.name}"


@dataclass
class CreateView(Operation):
    name: str
    query: Any
    materialized: bool = False
    with_data: bool = True

    def apply_state(self, state):
        state.views[self.name] = ViewState(self.query, self.materialized, self.with_data)

    def forwards(self, catalog, before, after):
        catalog.create_view(self.name, self.query, materialized=self.materialized, with_data=self.with_data)

    def backwards(self, catalog, before, after):
        catalog.delete_view(self.name)

    def describe(self):
        return f"Create {'materialized ' if self.materialized else ''}view {self.name}"


@dataclass
class DeleteView(Operation):
    name: str

    def apply_state(self, state):
        del state.views[self.name]

    def forwards(self, catalog, before, after):
        catalog.delete_view(self.name)

    def backwards(self, catalog, before, after):
        own = before.views[self.name]
        catalog.create_view(self.name, own.query, materialized=own.materialized, with_data=own.with_data)

    def describe(self):
        return f"Delete view {self.name}"


@dataclass
class AddPartition(Operation):
    """A range, list, hash or default partition."""

    table: str
    partition: Partition

    def apply_state(self, state):
        state.tables[self.table].partitions[self.partition.name.lower()] = self.partition

    def forwards(self, catalog, before, after):
        catalog.add_partition(self.table, self.partition)

    def backwards(self, catalog, before, after):
        catalog.delete_partition(self.table, self.partition.name)

    def describe(self):
        return f"Add {self.partition.kind} partition {self.partition.name} to {self.table}"


@dataclass
class DeletePartition(Operation):
    table: str
    name: str

    def apply_state(self, state):
        del state.tables[self.table].partitions[self.name.lower()]

    def forwards(self, catalog, before, after):
        catalog.delete_partition(self.table, self.name)

    def backwards(self, catalog, before, after):
        catalog.add_partition(self.table, before.tables[self.table].partitions[self.name.lower()])

    def describe(self):
        return f"Delete partition {self.name} of {self.table}"


@dataclass
class ApplyState(Operation):
    """Another operation's state change without its work in the catalog."""

    operation: Operation
    state_only = True

    def apply_state(self, state):
        self.operation.apply_state(state)

    def describe(self):
        return f"State only: {self.operation.describe()}"


@dataclass
class Migrations:
    """An ordered list of named steps and how far a catalog has come."""

    steps: list[tuple[str, list[Operation]]]

    def states(self) -> list[State]:
        out = [State()]
        for _, operations in self.steps:
            state = out[-1].clone()
            for o in operations:
                o.apply_state(state)
            out.append(state)
        return out

    def migrate(self, catalog, have: int, to: int | None = None) -> int:
        """Forwards or backwards from step number ``have``; each step is one transaction."""
        to = len(self.steps) if to is None else to
        states = self.states()
        while have < to:
            state = states[have].clone()
            with catalog.transaction():
                for o in self.steps[have][1]:
                    before = state.clone()
                    o.apply_state(state)
                    o.forwards(catalog, before, state)
            have += 1
        while have > to:
            chain, state = [], states[have - 1].clone()
            for o in self.steps[have - 1][1]:
                before = state.clone()
                o.apply_state(state)
                chain.append((o, before, state.clone()))
            with catalog.transaction():
                for o, before, after in reversed(chain):
                    o.backwards(catalog, before, after)
            have -= 1
        return have


def diff(old: State, new: State, default_partition: str = "default") -> list[Operation]:
    """Operations from one state to another. A new range or list table gets a default partition; view changes are state only."""
    out: list[Operation] = []
    for name in old.views.keys() - new.views.keys():
        out.append(DeleteView(name))
    for name in old.tables.keys() - new.tables.keys():
        out.append(DeleteTable(name))
    for name, own in new.tables.items():
        before = old.tables.get(name)
        if before is None:
            out.append(CreateTable(own.declared, own.partitioning))
            parts = list(own.partitions.values())
            if own.partitioning and own.partitioning.method != "hash" and not any(p.kind == "default" for p in parts):
                parts.append(Partition(default_partition, "default"))
            out += [AddPartition(name, p) for p in parts]
            continue
        if before.partitioning != own.partitioning:
            raise SuspiciousOperation(f"the partitioning of {name} cannot be changed")
        changes = {k: getattr(own.declared, k) for k in ("fields", "keys", "required", "checks", "indexes") if getattr(own.declared, k) != getattr(before.declared, k)}
        if changes:
            out.append(AlterTable(name, changes))
        out += [DeletePartition(name, p) for p in before.partitions.keys() - own.partitions.keys()]
        out += [AddPartition(name, own.partitions[p]) for p in own.partitions.keys() - before.partitions.keys()]
    for name, own in new.views.items():
        if name not in old.views:
            out.append(CreateView(name, own.query, own.materialized, own.with_data))
        elif own != old.views[name]:
            out.append(ApplyState(CreateView(name, own.query, own.materialized, own.with_data)))
    return out


class Phase(enum.StrEnum):
    FILLED = "filled"
    CONSTRAINED = "constrained"
    CLEANED = "cleaned"
    SWAPPED = "swapped"


class DataMigrator(ABC):
    """Rewrites a table beside itself and then takes its place; the old version stays as a backup.

    Phases: fill the shadow from a snapshot without any check, check its rules, clean and compact it,
    then under a lock catch up with what changed and swap. Subclasses say what fills, cleans and catches up.
    """

    def __init__(self, catalog, table: str):
        self.catalog, self.table = catalog, table
        self.phase: Phase | None = None
        self.shadow: DataFrame | None = None
        self.backup: str | None = None

    @abstractmethod
    def fill(self, source: DataFrame) -> DataFrame:
        """The shadow's rows from the source's."""

    @abstractmethod
    def clean(self, shadow: DataFrame) -> DataFrame:
        """The shadow without what should not survive."""

    @abstractmethod
    def catch_up(self, shadow: DataFrame, source: DataFrame) -> DataFrame:
        """The shadow with rows that came to the source meanwhile."""

    def migrate(self) -> None:
        with self.catalog.no_transaction("a data migration commits phase by phase"):
            self.shadow = self._stored("fill", self.fill(self.catalog.read(self.table)))
            self.phase = Phase.FILLED
            validate(self.shadow, self.catalog.declared(self.table), self.catalog.read)
            self.phase = Phase.CONSTRAINED
            self.shadow = self._stored("clean", self.clean(self.shadow))
            self.phase = Phase.CLEANED
            with self.catalog.transaction():
                self.catalog._lock(self.table)
                self.backup = self.catalog._entry(self.table)["path"]
                self.catalog.write(self.table, self.catch_up(self.shadow, self.catalog.read(self.table)))
            self.phase = Phase.SWAPPED

    def restore(self) -> None:
        """The backup as the current version again."""
        with self.catalog.transaction():
            self.catalog._touch(self.table)
            self.catalog._entry(self.table)["path"] = self.backup

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        import os
        import uuid

        path = os.path.join(self.catalog.root, "_shadow", f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.catalog.spark.read.schema(df.schema).parquet(path)
