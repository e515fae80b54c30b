"""Registered queries that go through a catalog: tables, partitions, views and migrations as a user keeps them.

Each makes a catalog of its own in the folder that all executors share, changes it, and returns what is read back.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import functions as F

from tablewright.catalog import Catalog
from tablewright.plans.conflict import ConflictAction
from tablewright.plans.keys import Check, Declared, Field, UniqueKey
from tablewright.plans.migrate import DataMigrator
from tablewright.plans.partitioning import Partitioning
from tablewright.queries import _catalog_root, query
from tablewright.sources import table

ORDER = Declared("o", (Field("o_orderkey", "bigint"), Field("o_custkey", "bigint"), Field("o_orderstatus", "string"), Field("o_totalprice", "double")), ("o_orderkey",))
COUNTRY = Declared("n", (Field("id", "bigint"), Field("name", "string"), Field("seen", "int")), ("id",), (UniqueKey(("name",)),))


def new_catalog(spark) -> Catalog:
    """An empty catalog in the shared folder; in one of its own where the session names none."""
    root = _catalog_root(spark)
    if root is None:
        root = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, root, True)
    return Catalog(spark, f"{root}/catalog-{uuid.uuid4().hex}")


def _orders(spark, d):
    return table(spark, d, "orders").select(*[f.name for f in ORDER.fields])


@query("SELECT n_name AS name, CAST(CASE WHEN n_nationkey < 2 THEN 2 ELSE 1 END AS INTEGER) AS seen FROM nation WHERE n_nationkey < 5")
def table_upsert_concurrent(spark, d):
    """Single-row upserts from four threads, some of the same key: none is lost."""
    t = new_catalog(spark).create_table(COUNTRY)
    names = {r.n_nationkey: r.n_name for r in table(spark, d, "nation").where("n_nationkey < 5").collect()}  # five rows

    def upsert(k: int) -> None:
        t.upsert(["name"], {"name": names[k], "seen": 1}, update_values={"seen": F.expr("seen + 1")})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(upsert, [*range(5), *range(2)]))
    return t.df.select("name", "seen")


@query("SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 4) AS o_totalprice FROM orders UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, round(o_totalprice * 2, 4) FROM orders WHERE o_orderkey % 10 = 0")
def table_bulk_upsert(spark, d):
    """A frame into a stored table: a tenth conflicts, as many are new."""
    t = new_catalog(spark).create_table(ORDER, rows=_orders(spark, d))
    batch = _orders(spark, d).where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.expr("o_totalprice * 2"))
    t.bulk_upsert(["o_orderkey"], batch.unionByName(batch.withColumn("o_orderkey", F.expr("o_orderkey + 10000000"))))
    return t.df.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def table_update_delete(spark, d):
    t = new_catalog(spark).create_table(ORDER, rows=_orders(spark, d))
    t.delete("o_orderkey % 7 = 0")
    t.update("o_totalprice > 100000", o_orderstatus="big")
    return t.df.select("o_orderkey", "o_orderstatus")


@query("SELECT CAST(1 + row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey < 5")
def table_truncate_restart(spark, d):
    """Keys begin anew after a truncation that restarts the sequence."""
    t = new_catalog(spark).create_table(COUNTRY)
    rows = [{"name": r.n_name} for r in table(spark, d, "nation").where("n_nationkey < 5").orderBy("n_nationkey").collect()]  # five rows
    t.bulk_insert(rows)
    t.truncate(restart_identity=True)
    t.on_conflict(["name"], ConflictAction.NOTHING).bulk_insert(rows)
    return t.df.select("id", "name")


def _by_year(spark, d):
    declared = Declared("o", (Field("o_orderkey", "bigint"), Field("o_orderdate", "timestamp")), ("o_orderkey",))
    catalog = new_catalog(spark)
    t = catalog.create_table(declared, partitioning=Partitioning("range", ("o_orderdate",)))
    for year in range(1993, 1997):
        catalog.add_range_partition("o", f"y{year}", datetime(year, 1, 1), datetime(year + 1, 1, 1))
    catalog.add_default_partition("o", "rest")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    catalog.write("o", rows)
    return catalog, t


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def table_partitions_read(spark, d):
    """Two partitions of a stored table: only their directories are read."""
    catalog, _ = _by_year(spark, d)
    return catalog.read("o", ["y1994", "y1995"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01' OR o_orderdate >= TIMESTAMP '1995-01-01'")
def table_partition_deleted(spark, d):
    """A partition leaves with its rows."""
    catalog, t = _by_year(spark, d)
    catalog.delete_partition("o", "y1994")
    return t.df.select("o_orderkey")


@query("SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus FROM orders WHERE o_totalprice > 1000")
def table_data_migrator(spark, d):
    """A stored table is rewritten beside itself, cleaned, caught up and swapped."""

    class Lower(DataMigrator):
        def fill(self, source):
            return source.withColumn("o_orderstatus", F.lower("o_orderstatus"))

        def clean(self, shadow):
            return shadow.where("o_totalprice > 1000")

        def catch_up(self, shadow, source):
            late = source.where("o_totalprice > 1000").join(shadow.select("o_orderkey"), "o_orderkey", "left_anti")
            return shadow.unionByName(self.fill(late))

    catalog = new_catalog(spark)
    t = catalog.create_table(ORDER, rows=_orders(spark, d))
    Lower(catalog, "o").migrate()
    return t.df.select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def view_of_another_process(spark, d):
    """A materialized view over a callable's SQL with parameters, refreshed through a second catalog on the same folder."""
    catalog = new_catalog(spark)
    catalog.create_table(ORDER, rows=_orders(spark, d))
    catalog.create_view("v", lambda: ("SELECT o_orderstatus, count(*) AS n FROM o WHERE o_totalprice > :least GROUP BY 1", {"least": 50000}), materialized=True, with_data=False)
    other = Catalog(spark, catalog.root)
    other.refresh("v")
    return other.read_view("v")


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_totalprice >= 0")
def table_renamed_fields(spark, d):
    """Renamed columns keep their key and check."""
    declared = Declared("o", (Field("o_orderkey", "bigint"), Field("o_totalprice", "double")), ("o_orderkey",), (UniqueKey(("o_orderkey",)),), checks=(Check("o_totalprice >= 0"),))
    catalog = new_catalog(spark)
    catalog.create_table(declared, rows=_orders(spark, d).select("o_orderkey", "o_totalprice"))
    catalog.rename_field("o", "o_orderkey", "k")
    catalog.rename_field("o", "o_totalprice", "price")
    return catalog.read("o")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def table_cloned(spark, d):
    """The structure of a table in another schema, filled by an insert of a frame."""
    catalog = new_catalog(spark)
    catalog.create_table(ORDER)
    catalog.create_schema("copy")
    clone = catalog.clone_structure("o", "copy")
    clone.bulk_insert(_orders(spark, d).where("o_orderkey % 2 = 0"))
    return clone.df
