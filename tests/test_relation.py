import pytest
from pyspark.sql import functions as F

from tablewright.errors import SuspiciousOperation
from tablewright.functions import coerce_map, epoch, last_not_null, map_of, map_ref, map_update
from tablewright.operators import relation as R
from tablewright.plans.keys import Declared, Field


def test_map_expressions(spark):
    df = spark.range(1).select(map_of({"en": "x", "n": 1, "none": None}).alias("m"), F.lit("v").alias("v"))
    r = df.select(map_ref("m", "en"), map_ref("m", "n"), map_ref("m", "none"), map_ref("m", "zz")).first()
    assert tuple(r) == ("x", "1", None, None)
    assert df.select(map_update("m", {"en": F.col("v"), "q": "it's"}).alias("m")).first().m == {"en": "v", "n": "1", "none": None, "q": "it's"}
    assert df.select(map_of({}).alias("m")).first().m == {}
    assert coerce_map({"a": 1, "b": None, "c": "3"}) == {"a": "1", "b": None, "c": "3"} and coerce_map([1, "2"]) == ["1", "2"] and coerce_map(None) is None


def test_last_not_null_and_epoch(spark):
    df = spark.sql("select cast(null as string) a, 'b' b, 'c' c, timestamp_ntz'2024-01-01 00:00:07.179575' t")
    assert df.select(last_not_null("a", "b", "c")).first()[0] == "c"
    assert df.select(last_not_null("a", "b", "c", first_wins=True)).first()[0] == "b"
    assert df.select(last_not_null("a", default=5)).first()[0] == "5"
    assert df.select(epoch("t")).first()[0] == 1704067207.179575


def test_annotate_rename_values(spark):
    df = spark.sql("select 1 id, 'x' name, map('en', 'hello') title")
    out = R.annotate(df, name=F.upper("name"), n=F.length("name"))
    assert (out.first().name, out.first().n) == ("X", 1)
    assert R.rename_annotations(out, n="size").columns[-1] == "size"
    with pytest.raises(SuspiciousOperation):
        R.rename_annotations(df, nope="x")
    assert R.values(df, "title__en", "id").first().asDict() == {"title__en": "hello", "id": 1}
    assert R.values_list(df, "id", flat=True) == [1]
    with pytest.raises(SuspiciousOperation):
        R.values(df, "nope")


def test_in_values_forms(spark):
    df = spark.range(100)
    assert R.in_values(df, "id", [3, 5, 500, None]).count() == 2
    assert R.in_values(df, "id", range(0, 200, 2)).count() == 50
    assert "LeftSemi" in R.in_values(df, "id", range(50))._jdf.queryExecution().toString()
    assert R.in_values(df, "id", []).count() == 0
    assert R.in_values(df, "id", df.where("id < 4")).count() == 4
    assert R.in_values(df, "id", df.where("id < 4").collect()).count() == 4


def test_related_rows_and_objects(spark):
    parent, child = spark.sql("select 1 id, 'p' name"), spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, ref int")
    got = {r.id: r.parent for r in R.select_related(child, "parent", parent, "ref", "id").collect()}
    assert got[1].name == "p" and got[2] is None and got[3] is None
    made = sorted(R.models_from(R.select_related(child, "parent", parent, "ref", "id"), related={"parent": dict}), key=lambda o: o["id"])
    assert [o["parent"] for o in made] == [{"id": 1, "name": "p"}, None, None]
    assert R.model_from(child.limit(0)) is None
    assert R.model_from_dict({"a": 1, "r": {"x": None}}, related={"r": dict}) == {"a": 1, "r": None}


def test_projection_by_declaration(spark):
    declared = Declared("t", (Field("id", "bigint", column="pk"), Field("data", "json"), Field("gone", "string"), Field("u", "uuid")), ("id",))
    df = spark.sql("""select 7 pk, '{"a": 1}' data, 'ABC' u, 'more' extra""")
    out = R.project(df, declared)
    assert out.columns == ["id", "data", "gone", "u"]
    assert out.selectExpr("id", "variant_get(data, '$.a', 'int')", "gone", "u").first() == (7, 1, None, "abc")
    assert R.local_fields(declared) == ["pk", "data", "gone", "u"]
    assert next(R.models_from(df, table=declared))["id"] == 7


def test_order_static_row_and_get(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert [r.a for r in R.ordered(df, "a").collect()] == [1, 3, None]
    assert [r.a for r in R.top_k(df, 2, "-a").collect()] == [None, 3]
    assert R.union_static(df, a=5).count() == 4
    assert R.get(df.where("a = 3")).a == 3
    for bad in (df, df.limit(0)):
        with pytest.raises(LookupError):
            R.get(bad)
