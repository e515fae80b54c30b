import pytest
from pyspark.sql import functions as F

from tablewright.errors import CardinalityViolation, IntegrityError, SuspiciousOperation
from tablewright.functions import excluded
from tablewright.plans.conflict import ConflictAction, ConflictSpec, plan_upsert
from tablewright.plans.keys import Declared, Field, UniqueKey, case_insensitive_unique, conditional_unique, map_unique

U, N = ConflictAction.UPDATE, ConflictAction.NOTHING


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def people(catalog, keys=(UniqueKey(("name",)),), **more):
    fields = (Field("id", "bigint"), Field("name", "string"), Field("priority", "int"), Field("active", "boolean"))
    return catalog.create_table(Declared("people", fields, ("id",), keys, **more))


def test_upsert_conditions_and_returned_keys(catalog):
    t = people(catalog)
    first = t.upsert(["name"], {"name": "joe", "priority": 1, "active": False})
    assert t.upsert(["name"], {"name": "joe", "priority": 2, "active": True}, update_condition="active = excluded.active") is None
    assert rows(t.df, "name", "priority") == [("joe", 1)]
    assert t.upsert(["name"], {"name": "joe", "priority": 2, "active": True}, update_condition=~F.col("active")) == first
    assert t.upsert(["name"], {"name": "joe", "priority": 9, "active": True}, update_condition=False) is None
    assert rows(t.df, "name", "priority") == [("joe", 2)]


def test_update_values(catalog):
    t = catalog.create_table(Declared("c", (Field("id", "bigint"), Field("name", "string"), Field("n", "int", default=0)), ("id",), (UniqueKey(("name",)),)))
    t.insert(name="joe")
    t.upsert(["name"], {"name": "joe"}, update_values={"n": F.col("n") + 1})
    assert rows(t.df, "name", "n") == [("joe", 1)]
    t.upsert(["name"], {"name": "joe", "n": 7}, update_values={})
    assert rows(t.df, "name", "n") == [("joe", 1)]
    t.upsert(["name"], {"name": "joe", "n": 7}, update_values={"n": excluded("n") * 2})
    assert rows(t.df, "n") == [(14,)]


def test_bulk_upsert_and_dicts_by_key(catalog):
    t = people(catalog)
    t.bulk_insert([{"name": "a", "priority": 1}, {"name": "b", "priority": 2}])
    got = t.bulk_upsert(["name"], [{"name": "c", "priority": 3}, {"name": "a", "priority": 9}], return_rows=True)
    assert sorted((r["name"], r["priority"]) for r in got) == [("a", 9), ("c", 3)]
    assert rows(t.df, "name", "priority") == [("a", 9), ("b", 2), ("c", 3)]
    assert t.bulk_upsert(["name"], []) == [] and t.bulk_upsert(["name"], None) == []
    assert t.bulk_upsert(["name"], ({"name": x, "priority": 0} for x in "xy"))


def test_nothing_drops_repeats_and_keeps_stored_rows(catalog):
    t = people(catalog)
    rule = t.on_conflict(["name"], N)
    assert len(rule.bulk_insert([{"name": "a", "priority": 1}, {"name": "a", "priority": 1}])) == 1
    assert rule.bulk_insert([{"name": "a", "priority": 2}]) == []
    assert rule.insert(name="a", priority=3) is None
    assert rows(t.df, "name", "priority") == [("a", 1)]


def test_batch_rules(catalog):
    t = people(catalog)
    with pytest.raises(CardinalityViolation):
        t.bulk_upsert(["name"], [{"name": "a", "priority": 1}, {"name": "a", "priority": 2}])
    with pytest.raises(SuspiciousOperation):
        t.bulk_upsert(["name"], [{"name": "a", "priority": 1}, {"name": "b", "active": True}])
    for target in (None, "name", 1, [1], [("a",)]):
        with pytest.raises(SuspiciousOperation):
            t.upsert(target, {"name": "a"})
    with pytest.raises(SuspiciousOperation):
        t.upsert(["nope"], {"name": "a"})
    with pytest.raises(SuspiciousOperation):
        t.on_conflict(["name"], ["name"])


def test_map_key(catalog):
    t = catalog.create_table(Declared("m", (Field("id", "bigint"), Field("title", "map<string,string>"), Field("cookies", "string")), ("id",), (map_unique("title", "key1"),)))
    t.upsert([("title", "key1")], {"title": {"key1": "beer"}, "cookies": "cheers"})
    t.upsert([("title", "key1")], {"title": {"key1": "beer"}, "cookies": "choco"})
    assert rows(t.df, "cookies") == [("choco",)]
    t.bulk_insert([{"title": {"en": 1}, "cookies": "x"}, {"title": {"en": None}, "cookies": "y"}])
    assert t.df.count() == 3
    with pytest.raises(IntegrityError):
        t.insert(title={"key1": "beer"}, cookies="z")
    assert t.df.where("cookies = 'x'").first().title == {"en": "1"}


def test_partial_and_case_insensitive_keys(catalog):
    fields = (Field("id", "bigint"), Field("a", "int"), Field("b", "int"), Field("c", "int"))
    t = catalog.create_table(Declared("p", fields, ("id",), (conditional_unique(["a", "b"], "b is not null"), conditional_unique(["a"], "b is null"))))
    t.upsert(["a"], {"a": 1, "b": None, "c": 1}, index_predicate="b is null")
    t.upsert(["a"], {"a": 1, "b": None, "c": 2}, index_predicate="b is null")
    t.upsert(["a", "b"], {"a": 1, "b": 1, "c": 1}, index_predicate="b is not null")
    t.upsert(["a", "b"], {"a": 1, "b": 1, "c": 2}, index_predicate="b is not null")
    assert sorted((r.a, r.b, r.c) for r in t.df.collect() if r.b) == [(1, 1, 2)] and t.df.count() == 2
    with pytest.raises(IntegrityError):
        t.insert(a=1, b=None, c=5)
    t.insert(a=2, b=None, c=1)
    n = catalog.create_table(Declared("n", (Field("id", "bigint"), Field("name", "string")), ("id",), (case_insensitive_unique(["name"]),)))
    n.insert(name="henk")
    with pytest.raises(IntegrityError):
        n.insert(name="Henk")
    n.upsert(["name"], {"name": "HENK"})
    assert rows(n.df, "name") == [("HENK",)]


def test_null_keys_never_match_and_plans_agree(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    i = spark.createDataFrame([(None, "x"), (3, "y"), (4, "z")], "k int, v string")
    want = [("4", "z"), ("None", "b"), ("None", "x"), ("1", "a"), ("3", "y")]
    for small in (0, 100):
        got = plan_upsert(t, i, ConflictSpec(["k"]), small=small).table.collect()
        assert sorted((str(r.k), r.v) for r in got) == sorted(want)
    assert plan_upsert(t.limit(0), i, ConflictSpec(["k"])).table.count() == 3
    assert plan_upsert(t, i.limit(0), ConflictSpec(["k"]), small=5).returning.count() == 0


def test_named_constraint_field_names_and_stamps(catalog):
    key = UniqueKey(("title",), "title_key")
    fields = (Field("id", "bigint"), Field("title", "string", column="beer"), Field("text", "string", column="desc"), Field("made", "int", on_insert=1), Field("seen", "int", on_write=lambda: 2))
    t = catalog.create_table(Declared("r", fields, ("id",), (UniqueKey(("beer",), "title_key"),)))
    pk = t.upsert(UniqueKey(("beer",), key.name), {"title": "x", "text": "1"})
    assert t.upsert(["title"], {"title": "x"}) == pk
    assert rows(t.df, "beer", "desc", "made", "seen") == [("x", "1", 1, 2)]
    assert t.upsert(["pk"], {"id": pk, "title": "y"}) == pk
    assert rows(t.df, "beer") == [("y",)]


def test_foreign_key_objects_and_json(catalog):
    catalog.create_table(Declared("f", (Field("id", "bigint"), Field("name", "string")), ("id",))).insert(id=5, name="p")
    t = catalog.create_table(Declared("g", (Field("id", "bigint"), Field("f_id", "bigint", references=("f", "id")), Field("data", "variant"), Field("at", "timestamp")), ("id",), (UniqueKey(("f_id",)),)))
    import datetime

    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    a = t.upsert(["f_id"], {"f_id": {"id": 5}, "data": {"a": [1]}, "at": at})
    assert t.upsert(["f_id"], {"f_id": 5, "data": {"a": 2}, "at": "2024-01-02T03:04:05"}) == a
    assert t.df.selectExpr("variant_get(data, '$.a', 'int')", "cast(at as string)").first() == (2, "2024-01-02 03:04:05")
    with pytest.raises(IntegrityError):
        t.insert(f_id=99)
    with pytest.raises(IntegrityError):
        catalog.truncate("f")
    catalog.truncate("f", cascade=True)
    assert t.df.count() == 0
