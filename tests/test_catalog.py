from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablewright import cli, settings
from tablewright.catalog import Catalog
from tablewright.errors import ImproperlyConfigured, IntegrityError, NotPopulatedError, StaleStateError, SuspiciousOperation, TransactionError, sqlstate
from tablewright.locking import LockMode, conflicts
from tablewright.plans.conflict import ConflictAction
from tablewright.plans.keys import Check, Declared, Field, Index, Required, UniqueKey
from tablewright.plans.migrate import AddPartition, AlterTable, CreateTable, CreateView, DataMigrator, DeletePartition, DeleteTable, DeleteView, Migrations, State, TableState, ViewState, diff
from tablewright.plans.partitioning import Partition, Partitioning
from tablewright.streaming.upsert import stream_upsert

T = Declared("t", (Field("id", "bigint"), Field("name", "string")), ("id",))


def test_insert_update_delete_truncate(catalog):
    t = catalog.create_table(T)
    assert [t.insert(name=x) for x in "ab"] == [1, 2]
    assert t.insert_and_get(name="c") == {"id": 3, "name": "c"}
    t.update("id = 1", name=F.upper("name"))
    t.delete("id = 2")
    assert sorted(r.name for r in t.df.collect()) == ["A", "c"]
    t.truncate(restart_identity=True)
    assert t.df.count() == 0 and t.insert(name="z") == 1


def test_rules(catalog):
    d = Declared("r", (Field("id", "bigint"), Field("age", "int", check="age >= 0"), Field("title", "map<string,string>"), Field("name", "string", False)), ("id",), required=(Required("title", "en"),), checks=(Check("age < 200"),))
    t = catalog.create_table(d)
    t.insert(age=None, title={"en": "x"}, name="n")
    for bad in ({"age": -1, "title": {"en": "x"}, "name": "n"}, {"age": 300, "title": {"en": "x"}, "name": "n"}, {"age": 1, "title": {"ar": "x"}, "name": "n"}, {"age": 1, "title": {"en": "x"}, "name": None}):
        with pytest.raises(IntegrityError):
            t.insert(**bad)
    assert t.df.count() == 1


def test_transactions_and_locks(catalog):
    t = catalog.create_table(T)
    with pytest.raises(ZeroDivisionError), catalog.transaction():
        t.insert(name="x")
        catalog.create_schema("s")
        1 / 0
    assert t.df.count() == 0 and not catalog.schema_exists("s")
    with catalog.transaction():
        catalog.lock_table("t", LockMode.SHARE)
        assert ("default.t", "ShareLock") in catalog.held_locks()
        with pytest.raises(TransactionError), catalog.no_transaction("x"):
            pass
    assert catalog.held_locks() == []
    with pytest.raises(TransactionError):
        catalog.lock_table("t", LockMode.SHARE)
    assert not conflicts(LockMode.SHARE, LockMode.SHARE) and conflicts(LockMode.SHARE, LockMode.ROW_EXCLUSIVE) and conflicts(LockMode.ACCESS_SHARE, LockMode.ACCESS_EXCLUSIVE)
    assert not conflicts(LockMode.ACCESS_SHARE, LockMode.EXCLUSIVE) and conflicts(LockMode.SHARE_UPDATE_EXCLUSIVE, LockMode.SHARE_UPDATE_EXCLUSIVE)
    assert all(conflicts(a, b) == conflicts(b, a) for a in LockMode for b in LockMode)


def test_views(catalog):
    t = catalog.create_table(T)
    t.bulk_insert([{"name": "test1"}, {"name": "test2"}])
    catalog.create_view("v", ("SELECT * FROM t WHERE name = :n", {"n": "test1"}))
    assert catalog.read_view("v").count() == 1
    catalog.create_view("m", "SELECT * FROM t WHERE name = 'test1'", materialized=True, with_data=False)
    with pytest.raises(NotPopulatedError) as error:
        catalog.read_view("m")
    assert sqlstate(error.value) == "55000"
    with pytest.raises(NotPopulatedError):
        catalog.refresh("m", concurrently=True)
    catalog.refresh("m")
    t.insert(name="test1")
    old = catalog.read_view("m")
    assert old.count() == 1
    cli.main([catalog.root, "refresh", "m", "-c"], catalog)
    assert catalog.read_view("m").count() == 2 and old.count() == 1
    catalog.replace_materialized_view("m", lambda: t.df.where("name = 'test2'"))
    assert catalog.read_view("m").count() == 1
    catalog.delete_view("m")
    catalog.delete_view("m")
    for bad in (None, 1, ("x",), ("x", 1), ("x", "y"), (1, [])):
        with pytest.raises(ImproperlyConfigured):
            catalog.create_view("bad", bad)


def test_schemas(catalog):
    with catalog.temporary_schema("tmp") as name:
        assert catalog.schema_exists(name) and name.startswith("tmp_")
        catalog.create_table(T, name)
        with pytest.raises(SuspiciousOperation):
            catalog.delete_schema(name)
        catalog.drop_table(f"{name}.t")
    assert not catalog.schema_exists(name)
    kept = []
    with pytest.raises(ValueError), catalog.temporary_schema("e") as other:
        kept.append(other)
        raise ValueError
    assert catalog.schema_exists(kept[0])
    catalog.delete_and_create_schema(kept[0])
    for bad in (lambda: catalog.delete_schema("default"), lambda: catalog.create_schema("x" * 64), lambda: catalog.create_schema(kept[0])):
        with pytest.raises(SuspiciousOperation):
            bad()
    catalog.create_table(T, kept[0])
    with catalog.searching(kept[0], prepend=True):
        assert catalog.split("t") == (kept[0], "t")
    assert catalog.create_time_based_schema("x").startswith("x_20")


def test_clone_move_alter_properties(catalog):
    catalog.create_table(Declared("p", T.fields, ("id",)))
    d = Declared("f", (Field("id", "bigint"), Field("first", "string"), Field("p_id", "bigint", references=("default.p", "id"))), ("id",), (UniqueKey(("first",)),), indexes=(Index(("first",)),), checks=(Check("id > 0", "positive"),))
    f = catalog.create_table(d)
    catalog.create_schema("s")
    catalog.clone_structure("f", "s", with_constraints=False)
    assert catalog.constraints("s.f").keys() == {"f_pkey"}
    catalog.clone_constraints("f", "s")
    assert catalog.constraints("s.f") == catalog.constraints("f") and catalog.columns("s.f") == catalog.columns("f")
    catalog.validate_foreign_keys("s.f")
    f.insert(first="a", p_id=None)
    catalog.drop_table("s.f")
    catalog.move_table("f", "s")
    assert catalog.table("s.f").df.count() == 1
    catalog.alter("s.f", fields=(*d.fields, Field("more", "int", default=3)))
    assert catalog.table("s.f").df.first().more == 3
    catalog.rename_field("s.f", "first", "given")
    assert catalog.declared("s.f").keys[0].parts == ("given",) and catalog.table("s.f").df.first().given == "a"
    catalog.set_properties("s.f", fillfactor=70)
    catalog.set_comment("s.f", "about")
    assert (catalog.properties("s.f"), catalog.comment("s.f")) == ({"fillfactor": "70"}, "about")
    catalog.reset_property("s.f", "fillfactor")
    assert catalog.properties("s.f") == {}
    assert catalog.vacuum("s.f", full=True, analyze=True)["removed"] >= 1 and catalog.properties("s.f")["rows"] == "1"
    with catalog.transaction(), pytest.raises(TransactionError):
        catalog.vacuum("s.f")
    assert ("s", "f", "table") in catalog.relations()


def test_settings_and_tags(spark, catalog):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), settings.set_local(spark, spark__sql__shuffle__partitions=7):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert spark.conf.get(key) == before
    with pytest.raises(TransactionError), settings.set_local(spark, catalog, x=1):
        pass
    with settings.tagged(spark, True) as tag:
        assert "test_settings_and_tags" in tag and spark.sparkContext.getLocalProperty("spark.job.description") == tag


def test_migrations_forth_and_back(catalog):
    part = Partition("y", "range", "2019-01-01", "2020-01-01")
    d = Declared("e", (Field("id", "bigint"), Field("ts", "timestamp")), ("id",))
    new = State({"t": TableState(T), "e": TableState(d, Partitioning("range", ("ts",)), {"y": part})}, {"v": ViewState("SELECT * FROM t", True)})
    operations = diff(State(), new)
    assert {type(o) for o in operations} == {CreateTable, AddPartition, CreateView} and sum(isinstance(o, AddPartition) for o in operations) == 2
    wider = (*T.fields, Field("more", "int"))
    m = Migrations([("0001", operations), ("0002", [AlterTable("t", {"fields": wider}), DeletePartition("e", "y"), DeleteView("v")]), ("0003", [DeleteTable("e")])])
    assert m.migrate(catalog, 0) == 3
    assert catalog.tables() == ["t"] and catalog.columns("t")[-1] == ("more", "int")
    assert m.migrate(catalog, 3, 1) == 1
    assert [p.name for p in catalog.partitions("e")] == ["default", "y"] and catalog.columns("t")[-1] == ("name", "string")
    assert catalog.read_view("v").count() == 0
    assert m.migrate(catalog, 1, 0) == 0 and catalog.tables() == []
    changed = State({"t": TableState(replace(T, fields=wider)), "e": new.tables["e"]}, {"v": ViewState("SELECT 1")})
    assert [o.describe() for o in diff(new, changed)] == ["Alter fields of table t", "State only: Create view v"]
    with pytest.raises(SuspiciousOperation):
        diff(new, State({"e": TableState(d, Partitioning("list", ("ts",)))}))


def test_shadow_migrator(catalog):
    t = catalog.create_table(T)
    t.bulk_insert([{"name": "a"}, {"name": ""}])

    class Upper(DataMigrator):
        def fill(self, source):
            return source.withColumn("name", F.upper("name"))

        def clean(self, shadow):
            t.insert(name="late")
            return shadow.where("name != ''")

        def catch_up(self, shadow, source):
            return shadow.unionByName(source.join(shadow.select("id"), "id", "left_anti").where("name = 'late'"))

    m = Upper(catalog, "t")
    m.migrate()
    assert sorted(r.name for r in t.df.collect()) == ["A", "late"]
    m.restore()
    assert t.df.count() == 3
    with catalog.transaction(), pytest.raises(TransactionError):
        m.migrate()


def test_stream_upsert(spark, catalog, tmp_path):
    t = catalog.create_table(Declared("s", (Field("id", "bigint"), Field("v", "int")), ("id",)))
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1), (1, 5), (2, 2)], "id long, v int").write.parquet(source)
    stream = spark.readStream.schema("id long, v int").parquet(source)
    stream_upsert(stream, t.on_conflict(["id"], ConflictAction.UPDATE), str(tmp_path / "cp"), "v", True).awaitTermination(120)
    assert sorted((r.id, r.v) for r in t.df.collect()) == [(1, 5), (2, 2)]


def test_concurrent_upserts(spark, catalog):
    """Threads, and catalogs of their own as other processes have them: no row is lost and no key given twice."""
    t = catalog.create_table(Declared("c", (Field("id", "bigint"), Field("name", "string"), Field("n", "int")), ("id",), (UniqueKey(("name",)),)))
    others = [t, t, t, Catalog(spark, catalog.root).table("c")]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: x[1].upsert(["name"], {"name": x[0], "n": 1}, update_values={"n": F.expr("n + 1")}), zip("abcdab", others + others)))
    rows = t.df.collect()
    assert sorted((r.name, r.n) for r in rows) == [("a", 2), ("b", 2), ("c", 1), ("d", 1)] and len({r.id for r in rows}) == 4


def test_stale_transaction(spark, catalog):
    t, other = catalog.create_table(T), Catalog(spark, catalog.root)
    with pytest.raises(StaleStateError), catalog.transaction():
        t.insert(name="a")
        other.table("t").insert(name="b")
    assert [r.name for r in t.df.collect()] == ["b"]


@pytest.mark.parametrize("never", [False, 0, ""])
def test_condition_that_is_false(catalog, never):
    t = catalog.create_table(Declared("f", (Field("id", "bigint"), Field("name", "string"), Field("n", "int")), ("id",), (UniqueKey(("name",)),)))
    t.insert(name="a", n=1)
    t.upsert(["name"], {"name": "a", "n": 2}, update_condition=never)
    assert [r.n for r in t.df.collect()] == [1]


def test_default_partition_keeps_no_rows_of_a_new_one(catalog):
    d = Declared("p", (Field("id", "bigint"), Field("at", "int")), ("id",))
    t = catalog.create_table(d, partitioning=Partitioning("range", ("at",)))
    catalog.add_default_partition("p", "rest")
    t.bulk_insert([{"id": 1, "at": 5}, {"id": 2, "at": 50}])
    with pytest.raises(IntegrityError):
        catalog.add_range_partition("p", "low", 0, 10)
    catalog.add_range_partition("p", "mid", 10, 20)
    assert [p.name for p in catalog.partitions("p")] == ["rest", "mid"]
    catalog.rename_field("p", "at", "moment")
    t.bulk_insert([{"id": 3, "moment": 12}])
    assert [r.id for r in catalog.read("p", ["mid"]).collect()] == [3]


def test_rename_is_carried_through(catalog):
    parent = Declared("a", (Field("id", "bigint"), Field("n", "int")), ("id",), (UniqueKey(("n",), condition="n > 0 AND 'n' <> ''"),), checks=(Check("n < 9"),), indexes=(Index(("n",)),))
    catalog.create_table(parent).insert(n=1)
    catalog.create_table(Declared("b", (Field("id", "bigint"), Field("a", "int", references=("a", "n"))), ("id",)))
    new = catalog.rename_field("a", "n", "m")
    assert new.checks[0].condition == "m < 9" and new.keys[0].condition == "m > 0 AND 'n' <> ''" and new.indexes[0].fields == ("m",)
    assert catalog.declared("b").by_name("a").references == ("a", "m")
    with pytest.raises(IntegrityError):
        catalog.table("a").insert(m=9)


def test_view_of_a_callable_outlives_its_process(spark, catalog):
    catalog.create_table(T).insert(name="x")
    catalog.create_view("v", lambda: "SELECT name FROM t", materialized=True, with_data=False)
    catalog.create_view("w", lambda: catalog.read("t"), materialized=True, with_data=False)
    other = Catalog(spark, catalog.root)
    other.refresh("v")
    assert [r.name for r in other.read_view("v").collect()] == ["x"]
    with pytest.raises(ImproperlyConfigured):
        other.refresh("w")
