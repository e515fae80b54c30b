"""A thin versioned catalog over Parquet directories.

State is one JSON document that is swapped by an atomic rename; every version of a table is a directory of
its own, so readers keep what they began with and an old version is a backup. Writers take table locks and read a table's state
once they hold its lock. A transaction works on a copy of the state and merges the tables that it touched into the stored state at
its end, under a file lock that all processes share; if another process changed one of them meanwhile, it fails and changes
nothing. Directories that a failed one wrote are never referenced.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import secrets
import shutil
import threading
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from copy import deepcopy
from dataclasses import asdict, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import ImproperlyConfigured, IntegrityError, NotPopulatedError, PartitioningError, StaleStateError, SuspiciousOperation, TransactionError
from tablewright.functions import coerce_map
from tablewright.locking import LockManager, LockMode
from tablewright.operators.relation import peek
from tablewright.plans.conflict import ConflictAction, ConflictSpec, fill_defaults, plan_upsert
from tablewright.plans.keys import Check, Declared, Field, Index, Required, UniqueKey, foreign_key_violations, validate
from tablewright.plans.partitioning import Partition, Partitioning, PartitioningMethod, route

DEFAULT_SCHEMA = "default"
_EMPTY = {"schemas": {DEFAULT_SCHEMA: {"tables": {}, "views": {}}}}
#: Collected rows of a returning frame are for batches; larger results are read as a frame.
ROUTE = "_part"
#: Size of a file that a full vacuum writes, about.
FILE_BYTES = 128 << 20
#: Times that a single write runs again when another process was faster.
TRIES = 20


def _jsonable(table: Declared) -> dict:
    out = asdict(table)
    for f in out["fields"]:
        for stamp in ("default", "on_insert", "on_write"):
            f[stamp] = f[stamp] if isinstance(f[stamp], (str, int, float, bool, type(None))) else None
    return json.loads(json.dumps(out))


def _declared(state: dict) -> Declared:
    state = dict(state)
    state["fields"] = tuple(Field(**{**f, "references": tuple(f["references"]) if f["references"] else None}) for f in state["fields"])
    state["keys"] = tuple(UniqueKey(**{**k, "parts": tuple(p if isinstance(p, str) else tuple(p) for p in k["parts"])}) for k in state["keys"])
    state["required"] = tuple(Required(**x) for x in state["required"])
    state["checks"] = tuple(Check(**x) for x in state["checks"])
    state["indexes"] = tuple(Index(**{**x, "fields": tuple(x["fields"])}) for x in state["indexes"])
    return Declared(**state)


def _renamed(sql: str, old: str, new: str) -> str:
    """An expression with a column under another name; texts in quotes stay."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if i % 2 else re.sub(rf"(?<![\w.]){re.escape(old)}(?!\w)", new, p) for i, p in enumerate(parts))


class Catalog:
    """Tables, views and schemas under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = os.path.join(root, "catalog.json")
        os.makedirs(root, exist_ok=True)
        self.locks = LockManager()
        self._local = threading.local()
        self._declared: dict[str, Declared] = {}
        self.search_path: list[str] = [DEFAULT_SCHEMA]
        with self._alone():
            if not os.path.exists(self.path):
                self._swap(deepcopy(_EMPTY))

    # state and transactions

    def _load(self) -> dict:
        with open(self.path) as f:
            return json.load(f)

    def _swap(self, state: dict) -> None:
        new = f"{self.path}.{uuid.uuid4().hex}"
        with open(new, "w") as f:
            json.dump(state, f)
        os.replace(new, self.path)

    @contextlib.contextmanager
    def _alone(self) -> Iterator[None]:
        """No other thread or process changes the stored state meanwhile."""
        with open(f"{self.path}.lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    @property
    def state(self) -> dict:
        own = getattr(self._local, "state", None)
        return own if own is not None else self._load()

    @property
    def in_transaction(self) -> bool:
        return getattr(self._local, "state", None) is not None

    @contextlib.contextmanager
    def transaction(self) -> Iterator["Catalog"]:
        """All changes inside become visible together, or none does. Nested ones join the outer."""
        if self.in_transaction:
            yield self
            return
        self._local.state, self._local.owner, self._local.touched = self._load(), uuid.uuid4().hex, {}
        try:
            yield self
            with self._alone():
                self._swap(self._merged(self._load()))
        finally:
            self.locks.release(self._local.owner)
            self._local.state = None
            self._local.dropped = set()

    def _merged(self, stored: dict) -> dict:
        """The stored state with what this transaction touched; other tables may have moved on meanwhile."""
        own, schemas = self._local.state["schemas"], stored["schemas"]
        for (schema, table), before in self._local.touched.items():
            if self._kept(stored, schema, table) != before:
                raise StaleStateError(f"{schema}.{table} was changed by another writer")
            for kind in ("tables", "views"):
                new = own.get(schema, {}).get(kind, {}).get(table)
                if schema in schemas:
                    schemas[schema][kind].pop(table, None)
                if new is not None:
                    schemas.setdefault(schema, {"tables": {}, "views": {}})[kind][table] = new
        for schema in set(schemas) - set(own):
            if schema in getattr(self._local, "dropped", set()):
                del schemas[schema]
        for schema in own:
            schemas.setdefault(schema, {"tables": {}, "views": {}})
        return stored

    @staticmethod
    def _kept(state: dict, schema: str, table: str) -> str:
        """The entries of that name in a state, as text to compare."""
        return json.dumps([state["schemas"].get(schema, {}).get(kind, {}).get(table) for kind in ("tables", "views")], sort_keys=True)

    @contextlib.contextmanager
    def no_transaction(self, why: str) -> Iterator[None]:
        """Guard for work that must not be part of a transaction."""
        if self.in_transaction:
            raise TransactionError(f"not inside a transaction: {why}")
        yield

    # names

    def split(self, name: str) -> tuple[str, str]:
        """(schema, table): a bare name is looked up along the search path, or lies in its first schema."""
        schema, dot, table = name.rpartition(".")
        if dot:
            return schema, table
        schemas = self.state["schemas"]
        return next(((s, name) for s in self.search_path if name in schemas.get(s, {}).get("tables", {}) or name in schemas.get(s, {}).get("views", {})), (self.search_path[0], name))

    def _entry(self, name: str) -> dict:
        schema, table = self.split(name)
        found = self.state["schemas"].get(schema, {}).get("tables", {}).get(table)
        if found is None:
            raise SuspiciousOperation(f"no table {schema}.{table}")
        return found

    def _touch(self, name: str) -> tuple[str, str]:
        """Lock a table or view that is about to change."""
        self._lock(name)
        return self.split(name)

    def _lock(self, name: str, mode: LockMode = LockMode.ACCESS_EXCLUSIVE) -> None:
        """Take a lock, and read the stored entry anew at the first one: a writer that held it before may have changed it."""
        schema, table = self.split(name)
        self.locks.acquire(f"{schema}.{table}", mode, self._local.owner)
        if (schema, table) in self._local.touched or mode != LockMode.ACCESS_EXCLUSIVE:
            return
        stored, own = self._load(), self._local.state["schemas"]
        self._local.touched[schema, table] = self._kept(stored, schema, table)
        for kind in ("tables", "views"):
            found = stored["schemas"].get(schema, {}).get(kind, {}).get(table)
            if found is not None:
                own.setdefault(schema, {"tables": {}, "views": {}})[kind][table] = found
            elif schema in own:
                own[schema][kind].pop(table, None)

    # schemas

    def schemas(self) -> list[str]:
        return sorted(self.state["schemas"])

    def schema_exists(self, name: str) -> bool:
        return name in self.state["schemas"]

    def create_schema(self, name: str) -> str:
        if not name or len(name) > 63:
            raise SuspiciousOperation("schema names have 1 to 63 characters")
        with self.transaction():
            if name in self.state["schemas"]:
                raise SuspiciousOperation(f"schema {name} exists")
            self.state["schemas"][name] = {"tables": {}, "views": {}}
        return name

    def delete_schema(self, name: str, cascade: bool = False) -> None:
        if name == DEFAULT_SCHEMA:
            raise SuspiciousOperation("the default schema cannot be deleted")
        with self.transaction():
            own = self.state["schemas"].get(name)
            if own is None:
                raise SuspiciousOperation(f"no schema {name}")
            if (own["tables"] or own["views"]) and not cascade:
                raise SuspiciousOperation(f"schema {name} is not empty")
            del self.state["schemas"][name]
            self._local.dropped = getattr(self._local, "dropped", set()) | {name}

    def delete_and_create_schema(self, name: str, cascade: bool = False) -> str:
        if self.schema_exists(name):
            self.delete_schema(name, cascade)
        return self.create_schema(name)

    def create_time_based_schema(self, prefix: str, now: datetime | None = None) -> str:
        return self.create_schema(f"{prefix}_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d%H%M%S')}")

    def create_random_schema(self, prefix: str) -> str:
        return self.create_schema(f"{prefix}_{secrets.token_hex(4)}")

    @contextlib.contextmanager
    def temporary_schema(self, prefix: str, cascade: bool = False, delete_on_throw: bool = False) -> Iterator[str]:
        """A random schema for a while; after an error it stays unless delete_on_throw."""
        name = self.create_random_schema(prefix)
        try:
            yield name
        except BaseException:
            if delete_on_throw:
                self.delete_schema(name, cascade)
            raise
        self.delete_schema(name, cascade)

    @contextlib.contextmanager
    def searching(self, *schemas: str, prepend: bool = False) -> Iterator[None]:
        """Another search path, or more schemas in front of it, restored whatever happens."""
        before = self.search_path
        self.search_path = [*schemas, *(before if prepend else [])]
        try:
            yield
        finally:
            self.search_path = before

    # tables

    def create_table(self, table: Declared, schema: str | None = None, partitioning: Partitioning | None = None, rows: DataFrame | None = None) -> "Table":
        schema = schema or self.search_path[0]
        if partitioning is not None:
            partitioning.check([f.stored for f in table.fields])
            table = replace(table, primary_key=partitioning.primary_key(table.primary_key))
        with self.transaction():
            if schema not in self.state["schemas"]:
                raise SuspiciousOperation(f"no schema {schema}")
            self._touch(f"{schema}.{table.name}")
            if table.name in self.state["schemas"][schema]["tables"]:
                raise SuspiciousOperation(f"table {table.name} exists")
            self._declared[f"{schema}.{table.name}"] = table
            self.state["schemas"][schema]["tables"][table.name] = {
                "declared": _jsonable(table), "path": None, "versions": [], "sequence": 1, "ordinal": time.time_ns(), "comment": table.comment, "properties": dict(table.properties),
                "partitioning": {"method": str(partitioning.method), "key": list(partitioning.key)} if partitioning else None, "partitions": [],
            }
            if rows is not None:
                self.write(f"{schema}.{table.name}", rows)
        return Table(self, f"{schema}.{table.name}")

    def table(self, name: str) -> "Table":
        self._entry(name)
        return Table(self, ".".join(self.split(name)))

    def tables(self, schema: str | None = None) -> list[str]:
        own = self.state["schemas"].get(schema or self.search_path[0], {"tables": {}})["tables"]
        return sorted(own, key=lambda t: own[t]["ordinal"])

    def declared(self, name: str) -> Declared:
        full = ".".join(self.split(name))
        entry = self._entry(full)
        live = self._declared.get(full)
        return live if live is not None and _jsonable(live) == entry["declared"] else _declared(entry["declared"])

    def alter(self, name: str, **changes: Any) -> Declared:
        """A new declaration: rows that are there must keep it; columns are added as null or default, dropped or renamed by position."""
        with self.transaction():
            schema, table = self._touch(name)
            old, entry = self.declared(name), self._entry(name)
            new = replace(old, **changes)
            rows = self.read(name)
            have = {f.stored for f in old.fields}
            out = rows.select(*[(F.col(f"`{f.stored}`") if f.stored in have else F.lit(f.default)).cast(f.type).alias(f.stored) for f in new.fields])
            self._declared[f"{schema}.{table}"] = new
            entry["declared"] = _jsonable(new)
            self.write(f"{schema}.{table}", out)
            if new.name != table:
                self._touch(f"{schema}.{new.name}")
                self.state["schemas"][schema]["tables"][new.name] = self.state["schemas"][schema]["tables"].pop(table)
                self._declared[f"{schema}.{new.name}"] = new
        return new

    def rename_field(self, name: str, old: str, new: str) -> Declared:
        """A column under another name, in keys, rules, indexes, the partitioning and references from other tables too."""
        with self.transaction():
            schema, bare = self._touch(name)
            table, entry = self.declared(name), self._entry(name)
            rows = self.read(name).withColumnRenamed(old, new)
            swap = lambda p: new if p == old else (new, p[1]) if isinstance(p, tuple) and p[0] == old else p
            text = lambda c: _renamed(c, old, new) if isinstance(c, str) else c
            changed = replace(
                table,
                fields=tuple(replace(f, name=new, column=None) if f.stored == old else f for f in table.fields),
                primary_key=tuple(swap(p) for p in table.primary_key),
                keys=tuple(replace(k, parts=tuple(swap(p) for p in k.parts), condition=text(k.condition)) for k in table.keys),
                required=tuple(replace(r, column=swap(r.column)) for r in table.required),
                checks=tuple(replace(c, condition=text(c.condition)) for c in table.checks),
                indexes=tuple(replace(x, fields=tuple(swap(f) for f in x.fields)) for x in table.indexes),
            )
            self._declared[f"{schema}.{bare}"] = changed
            entry["declared"] = _jsonable(changed)
            if entry["partitioning"]:
                entry["partitioning"]["key"] = [swap(k) for k in entry["partitioning"]["key"]]
            self.write(name, rows)
            for other in self.tables(schema):
                refers = self.declared(f"{schema}.{other}")
                if other != bare and any(f.references and f.references[0].split(".")[-1] == bare and f.references[1] == old for f in refers.fields):
                    self._touch(f"{schema}.{other}")
                    moved = tuple(replace(f, references=(f.references[0], new)) if f.references and f.references[0].split(".")[-1] == bare and f.references[1] == old else f for f in refers.fields)
                    self._declared[f"{schema}.{other}"] = replace(refers, fields=moved)
                    self._entry(f"{schema}.{other}")["declared"] = _jsonable(self._declared[f"{schema}.{other}"])
        return changed

    def drop_table(self, name: str) -> None:
        with self.transaction():
            self._lock(name)
            schema, table = self._touch(name)
            self._entry(name)
            del self.state["schemas"][schema]["tables"][table]

    def move_table(self, name: str, schema: str) -> "Table":
        """The table in another schema; only its entry moves."""
        with self.transaction():
            old, table = self._touch(name)
            if schema not in self.state["schemas"]:
                raise SuspiciousOperation(f"no schema {schema}")
            self._touch(f"{schema}.{table}")
            self.state["schemas"][schema]["tables"][table] = self.state["schemas"][old]["tables"].pop(table)
        return Table(self, f"{schema}.{table}")

    def read(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """The table's current version; parts: only these partitions."""
        entry, table = self._entry(name), self.declared(name)
        if entry["path"] is None:
            return self.spark.createDataFrame([], table.schema())
        out = self.spark.read.schema(table.schema() + (f", {ROUTE} string" if entry["partitioning"] else "")).parquet(entry["path"])
        if entry["partitioning"]:
            if parts is not None:
                out = out.where(F.col(ROUTE).isin(list(parts)))
            if entry.get("hidden"):
                out = out.where(~F.col(ROUTE).isin(entry["hidden"]))
            out = out.drop(ROUTE)
        return out

    def write(self, name: str, rows: DataFrame, extra: str | None = None) -> DataFrame:
        """rows as the table's next version, once they keep its rules; extra: a column that is read back but not part of the table."""
        with self.transaction():
            self._lock(name)
            schema, bare = self._touch(name)
            entry, table = self._entry(name), self.declared(name)
            path = os.path.join(self.root, schema, bare, f"v={len(entry['versions']) + 1}-{uuid.uuid4().hex[:8]}")
            columns = [F.col(f"`{f.stored}`").cast(f.type).alias(f.stored) for f in table.fields]
            out = rows.select(*columns, *([extra] if extra else []))
            if entry["partitioning"]:
                out = out.withColumn(ROUTE, route(entry["partitioning"]["key"], self.partitions(name)))
                out.write.partitionBy(ROUTE).parquet(path)
            else:
                out.write.parquet(path)
            kept = self.spark.read.schema(f"{table.schema()}{f', {extra} string' if extra else ''}{f', {ROUTE} string' if entry['partitioning'] else ''}").parquet(path)
            try:
                if entry["partitioning"] and not kept.where(F.col(ROUTE).isNull()).isEmpty():
                    raise PartitioningError(f"a row of {bare} belongs to no partition")
                validate(kept.drop(ROUTE, *([extra] if extra else [])), table, lambda other: self.read(other))
            except (IntegrityError, PartitioningError):
                shutil.rmtree(path, ignore_errors=True)
                raise
            entry["versions"].append(path)
            entry["path"], entry["hidden"] = path, []
        return kept

    def truncate(self, name: str, cascade: bool = False, restart_identity: bool = False) -> None:
        """No rows; cascade: nor in tables that refer here, without which those must be empty of references."""
        with self.transaction():
            self._lock(name)
            schema, bare = self._touch(name)
            for other in self.tables(schema):
                refers = [f for f in self.declared(f"{schema}.{other}").fields if f.references and f.references[0].split(".")[-1] == bare]
                if not refers or other == bare:
                    continue
                if cascade:
                    self.truncate(f"{schema}.{other}", True, restart_identity)
                else:
                    raise IntegrityError(f"{other} refers to {bare}; truncate with cascade")
            entry = self._entry(name)
            entry["path"], entry["hidden"] = None, []
            if restart_identity:
                entry["sequence"] = 1

    # partitions

    def partitions(self, name: str) -> list[Partition]:
        return [Partition(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}) for p in self._entry(name)["partitions"]]

    def partition(self, name: str, partition: str) -> Partition | None:
        return next((p for p in self.partitions(name) if p.name == partition.lower()), None)

    def add_partition(self, name: str, partition: Partition) -> None:
        with self.transaction():
            self._touch(name)
            entry = self._entry(name)
            if not entry["partitioning"]:
                raise PartitioningError(f"{name} is not partitioned")
            plain = lambda v: tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v.isoformat(" ") if hasattr(v, "isoformat") else v
            partition = replace(partition, name=partition.name.lower(), lower=plain(partition.lower), upper=plain(partition.upper), members=plain(partition.members))
            if partition.kind != "default" and partition.kind != entry["partitioning"]["method"]:
                raise PartitioningError(f"{name} is partitioned by {entry['partitioning']['method']}")
            if partition.kind == "default" and entry["partitioning"]["method"] == "hash":
                raise PartitioningError("hash partitioning has no default partition")
            for other in self.partitions(name):
                if other.name == partition.name or partition.overlaps(other):
                    raise PartitioningError(f"{partition.name} clashes with {other.name}")
            default = next((p for p in self.partitions(name) if p.kind == "default"), None)
            if default is not None and entry["path"] is not None:  # its rows would stay behind where no one looks for them
                theirs = route(entry["partitioning"]["key"], [partition]) == partition.name
                if not self.read(name, [default.name]).where(theirs).isEmpty():
                    raise IntegrityError(f"rows of {default.name} belong to {partition.name}")
            entry["partitions"].append(asdict(partition))

    def add_range_partition(self, name: str, partition: str, from_values: Any, to_values: Any, comment: str = "") -> None:
        self.add_partition(name, Partition(partition, "range", from_values, to_values, comment=comment))

    def add_list_partition(self, name: str, partition: str, values: Iterable[Any], comment: str = "") -> None:
        self.add_partition(name, Partition(partition, "list", members=tuple(values), comment=comment))

    def add_hash_partition(self, name: str, partition: str, modulus: int, remainder: int, comment: str = "") -> None:
        self.add_partition(name, Partition(partition, "hash", modulus=modulus, remainder=remainder, comment=comment))

    def add_default_partition(self, name: str, partition: str, comment: str = "") -> None:
        self.add_partition(name, Partition(partition, "default", comment=comment))

    def delete_partition(self, name: str, partition: str) -> None:
        """The partition with its rows: no other file is touched, as its directory just leaves the current version."""
        with self.transaction():
            self._lock(name)
            self._touch(name)
            entry = self._entry(name)
            if self.partition(name, partition) is None:
                raise PartitioningError(f"{name} has no partition {partition}")
            entry["partitions"] = [p for p in entry["partitions"] if p["name"] != partition.lower()]
            if entry["path"] is not None:
                entry["hidden"] = [*entry.get("hidden", []), partition.lower()]

    def partitioned_tables(self, schema: str | None = None) -> list[dict]:
        """name, method, key and partitions (with full names and comments) of every partitioned table."""
        schema, out = schema or self.search_path[0], []
        for table in self.tables(schema):
            entry = self.state["schemas"][schema]["tables"][table]
            if entry["partitioning"]:
                parts = [{"name": p.name, "full_name": p.full_name(table), "comment": p.comment} for p in self.partitions(f"{schema}.{table}")]
                out.append({"name": table, "method": PartitioningMethod(entry["partitioning"]["method"]), "key": list(entry["partitioning"]["key"]), "partitions": parts})
        return out

    # views

    def create_view(self, name: str, query: Any, schema: str | None = None, replace_existing: bool = False, materialized: bool = False, with_data: bool = True) -> None:
        """A view over SQL text, (SQL, parameters), or a callable that gives one of these or a frame."""
        schema, text = schema or self.search_path[0], view_query(query)
        if callable(text) and not isinstance(text, DataFrame):  # what it gives now is kept for other processes
            text = view_query(text())
        with self.transaction():
            self._touch(f"{schema}.{name}")
            own = self.state["schemas"][schema]["views"]
            if name in own and not replace_existing:
                raise SuspiciousOperation(f"view {name} exists")
            own[name] = {"query": text if isinstance(text, (str, list)) else None, "materialized": materialized, "path": None, "indexes": own.get(name, {}).get("indexes", [])}
            self._live_views()[f"{schema}.{name}"] = query
            if materialized and with_data:
                self._fill(schema, name)

    def replace_view(self, name: str, query: Any, schema: str | None = None) -> None:
        self.create_view(name, query, schema, True)

    def replace_materialized_view(self, name: str, query: Any, schema: str | None = None, with_data: bool = True) -> None:
        self.create_view(name, query, schema, True, True, with_data)

    def delete_view(self, name: str) -> None:
        """Nothing happens where there is none."""
        with self.transaction():
            schema, view = self._touch(name)
            self.state["schemas"][schema]["views"].pop(view, None)

    def _live_views(self) -> dict:
        if not hasattr(self, "_views"):
            self._views: dict[str, Any] = {}
        return self._views

    def _view(self, name: str) -> tuple[str, str, dict]:
        schema, view = self.split(name)
        own = self.state["schemas"].get(schema, {}).get("views", {}).get(view)
        if own is None:
            raise SuspiciousOperation(f"no view {name}")
        return schema, view, own

    def _query(self, schema: str, view: str, own: dict) -> DataFrame:
        query = self._live_views().get(f"{schema}.{view}", own["query"])
        if callable(query) and not isinstance(query, DataFrame):
            query = query()
        if isinstance(query, DataFrame):
            return query
        if query is None:
            raise ImproperlyConfigured(f"{view} was made of a frame in another process; only views over SQL outlive theirs")
        sql, args = (query, None) if isinstance(query, str) else query
        self.register(schema)
        return self.spark.sql(sql, args=args if args is None or isinstance(args, dict) else list(args))

    def register(self, schema: str | None = None) -> None:
        """The current versions of a schema's tables as temporary views, for SQL."""
        schema = schema or self.search_path[0]
        for table in self.tables(schema):
            self.read(f"{schema}.{table}").createOrReplaceTempView(table)

    def _fill(self, schema: str, view: str) -> None:
        own = self.state["schemas"][schema]["views"][view]
        path = os.path.join(self.root, schema, view, f"mv-{uuid.uuid4().hex[:8]}")
        self._query(schema, view, own).write.parquet(path)
        own["path"] = path

    def read_view(self, name: str) -> DataFrame:
        schema, view, own = self._view(name)
        if not own["materialized"]:
            return self._query(schema, view, own)
        if own["path"] is None:
            raise NotPopulatedError(f"materialized view {view} has not been populated")
        return self.spark.read.parquet(own["path"])

    def refresh(self, name: str, concurrently: bool = False) -> None:
        """A new snapshot; readers of the old one keep it. Concurrently needs one to be there."""
        with self.transaction():
            self._touch(name)
            schema, view, own = self._view(name)
            if not own["materialized"]:
                raise SuspiciousOperation(f"{view} is not a materialized view")
            if concurrently and own["path"] is None:
                raise NotPopulatedError(f"{view} cannot be refreshed concurrently before it is populated")
            self._fill(schema, view)

    # administration

    def lock_table(self, name: str, mode: LockMode) -> None:
        """A lock until the transaction ends."""
        if not self.in_transaction:
            raise TransactionError("a table lock lasts as long as a transaction and needs one")
        self._entry(name)
        self._lock(name, mode)

    def set_comment(self, name: str, comment: str) -> None:
        with self.transaction():
            self._touch(name)
            self._entry(name)["comment"] = comment

    def comment(self, name: str) -> str:
        return self._entry(name)["comment"]

    def set_properties(self, name: str, **properties: Any) -> None:
        with self.transaction():
            self._touch(name)
            self._entry(name)["properties"] |= {k: str(v) for k, v in properties.items()}

    def reset_property(self, name: str, key: str) -> None:
        with self.transaction():
            self._touch(name)
            self._entry(name)["properties"].pop(key, None)

    def properties(self, name: str) -> dict[str, str]:
        return dict(self._entry(name)["properties"])

    def vacuum(self, name: str, full: bool = False, freeze: bool = False, verbose: bool = False, analyze: bool = False, disable_page_skipping: bool = False, skip_locked: bool = False, index_cleanup: bool = False, truncate: bool = False, parallel: int | None = None) -> dict:
        """Old versions and deleted partitions' files go; full rewrites the rows into few files, analyze counts them. The other options have no meaning here."""
        with self.no_transaction("vacuum removes files that a rollback would need"):
            if full:
                with self.transaction():
                    self._lock(name)
                    top = self._entry(name)["path"]
                    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top or self.root) for f in names) if top else 0
                    self.write(name, self.read(name).repartition(parallel or max(1, -(-size // FILE_BYTES))))
            with self.transaction():
                self._touch(name)
                entry = self._entry(name)
                old = [v for v in entry["versions"] if v != entry["path"]]
                old += [os.path.join(entry["path"], f"{ROUTE}={p}") for p in entry.get("hidden", [])]
                entry["versions"] = [entry["path"]] if entry["path"] else []
                if analyze:
                    entry["properties"]["rows"] = str(self.read(name).count())
            for path in old:
                shutil.rmtree(path, ignore_errors=True)
        return {"removed": len(old)}

    def clone_structure(self, name: str, schema: str, with_constraints: bool = True) -> "Table":
        """The same empty table in another schema; constraints and indexes now or by clone_constraints."""
        table = self.declared(name)
        bare = table if with_constraints else replace(table, keys=(), checks=(), required=(), indexes=(), fields=tuple(replace(f, references=None) for f in table.fields))
        part = self._entry(name)["partitioning"]
        return self.create_table(bare, schema, Partitioning(part["method"], tuple(part["key"])) if part else None)

    def clone_constraints(self, name: str, schema: str) -> None:
        """The constraints and indexes of a table for its clone; foreign keys are taken over unchecked."""
        table = self.declared(name)
        with self.transaction():
            self._touch(f"{schema}.{table.name}")
            own = replace(table, name=table.name)
            self._declared[f"{schema}.{table.name}"] = own
            self.state["schemas"][schema]["tables"][table.name]["declared"] = _jsonable(own)

    def validate_foreign_keys(self, name: str) -> None:
        for f in self.declared(name).fields:
            if f.references and not foreign_key_violations(self.read(name), f.stored, self.read(f.references[0]), f.references[1]).isEmpty():
                raise IntegrityError(f"{name}.{f.stored} names a row that {f.references[0]} lacks")

    def constraints(self, name: str) -> dict[str, dict]:
        """Keys, checks, required keys, foreign keys and indexes by name."""
        table, out = self.declared(name), {}
        for k in table.all_keys():
            out[k.label(table.name)] = {"columns": list(k.parts), "unique": True, "primary_key": k.name.endswith("_pkey"), "definition": f"UNIQUE ({', '.join(map(str, k.parts))})" + (f" WHERE {k.condition}" if k.condition else "")}
        for r in table.required:
            out[r.label(table.name)] = {"columns": [r.column], "check": True, "definition": f"CHECK ({r.condition})"}
        for c in table.checks:
            out[c.label(table.name)] = {"columns": [], "check": True, "definition": f"CHECK ({c.condition})"}
        for f in table.fields:
            if f.references:
                out[f"{table.name}_{f.stored}_fk"] = {"columns": [f.stored], "foreign_key": f.references, "definition": f"REFERENCES {f.references[0]} ({f.references[1]})"}
        for i in table.indexes:
            out[i.name or f"{table.name}_{'_'.join(i.fields)}_idx"] = {"columns": list(i.fields), "index": True, "definition": f"INDEX USING {i.method} ({', '.join(i.fields)})"}
        return out

    def columns(self, name: str) -> list[tuple[str, str]]:
        return [(f.stored, f.type) for f in self.declared(name).fields]

    def relations(self) -> list[tuple[str, str, str]]:
        """(schema, name, kind) of all tables and views."""
        out = []
        for schema, own in sorted(self.state["schemas"].items()):
            out += [(schema, t, "partitioned table" if e["partitioning"] else "table") for t, e in own["tables"].items()]
            out += [(schema, v, "materialized view" if e["materialized"] else "view") for v, e in own["views"].items()]
        return out

    def held_locks(self) -> list[tuple[str, str]]:
        return self.locks.held()


def view_query(query: Any) -> Any:
    """Check a view's query: a frame, SQL text, (SQL, list, tuple or dict of parameters), or a callable that gives one."""
    if query is None:
        raise ImproperlyConfigured("a view needs a query")
    if isinstance(query, DataFrame) or callable(query):
        return query
    if isinstance(query, str):
        return query
    if isinstance(query, (tuple, list)) and len(query) == 2 and isinstance(query[0], str) and isinstance(query[1], (tuple, list, dict)):
        return [query[0], query[1] if isinstance(query[1], dict) else list(query[1])]
    raise ImproperlyConfigured(f"{query!r} is not a view query")


class Table:
    """A handle on one table."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name = catalog, name

    @property
    def declared(self) -> Declared:
        return self.catalog.declared(self.name)

    @property
    def df(self) -> DataFrame:
        return self.catalog.read(self.name)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.df, name)

    def on_conflict(self, target: Any, action: ConflictAction, index_predicate=None, update_condition=None, update_values=None) -> "Inserting":
        return Inserting(self, ConflictSpec(target, action, index_predicate, update_condition, update_values))

    def _frame(self, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
        table, first = self.declared, set(rows[0])
        if any(set(r) != first for r in rows):
            raise SuspiciousOperation("all rows of a batch have the same fields")
        fields = [table.by_name(n) for n in rows[0]]
        kind = lambda f: "string" if f.type.lower() in ("timestamp", "date", "variant") else f.type
        data = [tuple(self._plain(f, r[n]) for f, n in zip(fields, rows[0])) for r in rows]
        df = self.catalog.spark.createDataFrame(data, ", ".join(f"`{f.stored}` {kind(f)}" for f in fields)).coalesce(1)
        return df.select(*[(F.parse_json(f.stored) if f.type.lower() == "variant" else F.col(f"`{f.stored}`").cast(f.type)).alias(f.stored) for f in fields])

    @staticmethod
    def _plain(f: Field, value: Any) -> Any:
        if value is None:
            return None
        if f.references and not isinstance(value, (int, str)):
            value = value[f.references[1]] if isinstance(value, Mapping) else getattr(value, f.references[1])
        kind = f.type.lower()
        if kind.startswith("map"):
            return coerce_map(value)
        if kind == "variant":
            return value if isinstance(value, str) else json.dumps(value)
        if kind in ("timestamp", "date"):
            return value.isoformat(" ") if hasattr(value, "isoformat") and kind == "timestamp" else str(value)
        return str(value) if kind == "string" else value

    def _store(self, incoming: DataFrame, spec: ConflictSpec | None, order: Column | None = None) -> DataFrame:
        """Insert a frame; returns the inserted and updated rows, read back from what was written."""
        return self._again(lambda: self._stored(incoming, spec, order))

    def _again(self, write):
        """A write as a transaction of its own, anew when another process was faster; inside a transaction it belongs to that."""
        for left in range(TRIES, 0, -1):
            try:
                return write()
            except StaleStateError:
                if left == 1 or self.catalog.in_transaction:
                    raise

    def _stored(self, incoming: DataFrame, spec: ConflictSpec | None, order: Column | None) -> DataFrame:
        with self.catalog.transaction():
            self.catalog._lock(self.name)
            table, entry = self.declared, self.catalog._entry(self.name)
            incoming, update = fill_defaults(incoming, table)
            for pk in table.primary_key:  # generated keys continue the sequence in batch order
                f = table.by_name(pk)
                if f.stored not in incoming.columns and f.type.lower() in ("bigint", "long", "int", "integer"):
                    # a batch of rows lies in one partition and gets consecutive keys; a frame's have gaps
                    width = incoming.rdd.getNumPartitions() << 33 if incoming.rdd.getNumPartitions() > 1 else incoming.count()
                    incoming = incoming.withColumn(f.stored, F.lit(entry["sequence"]) + F.monotonically_increasing_id())
                    entry["sequence"] += width
            target = self.df
            if spec is None:
                merged = target.withColumn("_action", F.lit("keep")).unionByName(incoming.withColumn("_action", F.lit("insert")), allowMissingColumns=True)
            else:
                merged = plan_upsert(target, incoming, spec, table, order, 100_000, True, update).merged
            kept = self.catalog.write(self.name, merged, "_action")
        return kept.where("_action != 'keep'").drop(ROUTE)

    def insert(self, **values: Any) -> Any:
        """The new row's primary key."""
        return self._key(self._store(self._frame([values]), None))

    def insert_and_get(self, **values: Any) -> dict | None:
        return self._one(self._store(self._frame([values]), None))

    def bulk_insert(self, rows: Iterable[Mapping[str, Any]] | DataFrame | None, return_rows: bool = False) -> list[dict] | DataFrame:
        return Inserting(self, None).bulk_insert(rows, return_rows)

    def upsert(self, conflict_target: Any, fields: Mapping[str, Any], index_predicate=None, update_condition=None, update_values=None) -> Any:
        return self.on_conflict(conflict_target, ConflictAction.UPDATE, index_predicate, update_condition, update_values).insert(**fields)

    def upsert_and_get(self, conflict_target: Any, fields: Mapping[str, Any], index_predicate=None, update_condition=None, update_values=None) -> dict | None:
        return self.on_conflict(conflict_target, ConflictAction.UPDATE, index_predicate, update_condition, update_values).insert_and_get(**fields)

    def bulk_upsert(self, conflict_target: Any, rows: Any, index_predicate=None, return_rows: bool = False, update_condition=None, update_values=None) -> Any:
        return self.on_conflict(conflict_target, ConflictAction.UPDATE, index_predicate, update_condition, update_values).bulk_insert(rows, return_rows)

    def update(self, where: Column | str | None = None, **values: Any) -> None:
        """Set columns where a condition is true; dicts for map columns may hold expressions."""
        from tablewright.functions import map_of

        condition = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where

        def write() -> None:
            with self.catalog.transaction():
                self.catalog._lock(self.name)
                new = {}
                for name, value in values.items():
                    f = self.declared.by_name(name)
                    value = map_of(value) if isinstance(value, Mapping) else value if isinstance(value, Column) else F.lit(value)
                    new[f.stored] = F.when(condition, value.cast(f.type)).otherwise(F.col(f"`{f.stored}`"))
                self.catalog.write(self.name, self.df.withColumns(new))

        self._again(write)

    def delete(self, where: Column | str | None = None) -> None:
        condition = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where

        def write() -> None:
            with self.catalog.transaction():
                self.catalog._lock(self.name)
                self.catalog.write(self.name, self.df.where(~F.coalesce(condition, F.lit(False))))

        self._again(write)

    def truncate(self, cascade: bool = False, restart_identity: bool = False) -> None:
        self.catalog.truncate(self.name, cascade, restart_identity)

    def _key(self, rows: DataFrame) -> Any:
        found = self._one(rows)
        return None if found is None else found[self.declared.by_name(self.declared.primary_key[0]).stored]

    def _one(self, rows: DataFrame) -> dict | None:
        row = rows.drop("_action").first()
        return None if row is None else row.asDict()


class Inserting:
    """A table with an immutable conflict rule."""

    def __init__(self, table: Table, spec: ConflictSpec | None):
        self.table, self.spec = table, spec

    def insert(self, **values: Any) -> Any:
        return self.table._key(self.table._store(self.table._frame([values]), self.spec))

    def insert_and_get(self, **values: Any) -> dict | None:
        return self.table._one(self.table._store(self.table._frame([values]), self.spec))

    def bulk_insert(self, rows: Iterable[Mapping[str, Any]] | DataFrame | None, return_rows: bool = False) -> list[dict] | DataFrame:
        """Rows or a frame. Rows give the stored rows (matched by what was written, not by position) or dicts of key and input; a frame gives a frame."""
        if isinstance(rows, DataFrame):
            return self.table._store(rows, self.spec).drop("_action")
        rows = peek(rows)
        if rows is None:
            return []
        frame = self.table._frame(rows)
        stored = self.table._store(frame, self.spec).drop("_action").collect()
        return [r.asDict() for r in stored]


def slug(name: str) -> str:
    """A name fit for a folder or table."""
    return re.sub(r"[^0-9a-zA-Z_]+", "_", name).strip("_").lower()
