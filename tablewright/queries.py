"""Registered queries of the table toolkit and the SQL that checks them.

Every query is a lazy plan over whole tables. Doubles are rounded to four digits, so that sums and products
compare by value. The incoming batch of the upsert queries is ``orders`` with keys divisible by ten at a price
raised by a tenth, which all conflict, and those with remainder one moved by ten million, which are new.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import at_most, both, case, coerce_map, epoch, equals, excluded, greater, is_same, last_not_null, map_of, map_ref, map_update, to_bool, truncated
from tablewright.functions.expressions import coerced_map_column
from tablewright.operators import relation as R
from tablewright.plans.conflict import ConflictAction, ConflictSpec, duplicate_keys, fill_defaults, first_by_key, plan_upsert
from tablewright.plans.keys import Check, Declared, Field, Required, UniqueKey, check_violations, case_insensitive_unique, foreign_key_violations, map_unique, required_violations, unique_violations
from tablewright.plans.partitioning import CurrentTimeStrategy, Partition, Span, TimePartitionSize, TimeUnit, bucket_name, bucket_start, pruned, route, time_partition
from tablewright.session import configure
from tablewright.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
_MOVED = 10_000_000


def query(oracle: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return run

    return add


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


def _incoming(orders):
    own = orders.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 1.1, 4))
    return own.unionByName(orders.where("o_orderkey % 10 = 1").withColumn("o_orderkey", F.col("o_orderkey") + _MOVED))


_T = "t AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
_I = f"inc AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 1.1, 4) AS o_totalprice, o_orderdate, o_orderpriority FROM t WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey + {_MOVED}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM t WHERE o_orderkey % 10 = 1)"
_NEW = "SELECT * FROM inc WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)"
_COLS = "t.o_orderkey, t.o_custkey, t.o_orderstatus, {price} AS o_totalprice, t.o_orderdate, t.o_orderpriority"


def _upsert_sql(price: str, extra: str = "") -> str:
    return f"WITH {_T}, {_I} SELECT {_COLS.format(price=price)} FROM t LEFT JOIN inc e ON t.o_orderkey = e.o_orderkey {extra} UNION ALL {_NEW}"


@query(_upsert_sql("CASE WHEN e.o_orderkey IS NULL THEN t.o_totalprice ELSE e.o_totalprice END"))
def upsert_update(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"])).table


@query(_upsert_sql("CASE WHEN e.o_orderkey IS NULL THEN t.o_totalprice ELSE e.o_totalprice END"))
def upsert_update_small_batch(spark, d):
    """The same, by the plan that broadcasts a counted small batch and never shuffles the target."""
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"]), small=1_000_000).table


@query(_upsert_sql("t.o_totalprice"))
def upsert_nothing(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], ConflictAction.NOTHING)).table


@query(f"WITH {_T}, {_I} SELECT inc.*, CASE WHEN t.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS action FROM inc LEFT JOIN t ON t.o_orderkey = inc.o_orderkey")
def upsert_returning_update(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"])).returning.withColumnRenamed("_action", "action")


@query(f"WITH {_T}, {_I} {_NEW}")
def upsert_returning_nothing(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], ConflictAction.NOTHING)).returning.drop("_action")


@query(_upsert_sql("CASE WHEN e.o_totalprice > 150000 AND t.o_orderstatus = 'O' THEN e.o_totalprice ELSE t.o_totalprice END"))
def upsert_condition(spark, d):
    orders = _orders(spark, d)
    spec = ConflictSpec(["o_orderkey"], update_condition=(excluded("o_totalprice") > 150000) & (F.col("t.o_orderstatus") == "O"))
    return plan_upsert(orders, _incoming(orders), spec).table


@query(_upsert_sql("CASE WHEN e.o_totalprice > t.o_totalprice + 10000 THEN e.o_totalprice ELSE t.o_totalprice END"))
def upsert_condition_text(spark, d):
    """The condition as SQL text: bare names are the stored row's."""
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], update_condition="excluded.o_totalprice > o_totalprice + 10000")).table


@query(_upsert_sql("t.o_totalprice"))
def upsert_condition_false(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], update_condition=False)).table


@query(_upsert_sql("CASE WHEN e.o_orderkey IS NULL THEN t.o_totalprice ELSE round(t.o_totalprice + e.o_totalprice + 1, 4) END"))
def upsert_values_expr(spark, d):
    orders = _orders(spark, d)
    new = F.round(F.col("t.o_totalprice") + excluded("o_totalprice") + 1, 4)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], update_values={"o_totalprice": new})).table


@query(_upsert_sql("t.o_totalprice"))
def upsert_values_empty(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], update_values={})).table


@query(f"WITH {_T}, {_I} SELECT {_COLS.format(price='coalesce(e.o_totalprice, t.o_totalprice)')} FROM t LEFT JOIN (SELECT * FROM inc WHERE o_orderstatus = 'O') e ON t.o_orderkey = e.o_orderkey AND t.o_orderstatus = 'O' UNION ALL SELECT * FROM inc WHERE NOT (o_orderstatus = 'O' AND o_orderkey IN (SELECT o_orderkey FROM t WHERE o_orderstatus = 'O'))")
def upsert_partial_predicate(spark, d):
    orders = _orders(spark, d)
    return plan_upsert(orders, _incoming(orders), ConflictSpec(["o_orderkey"], index_predicate="o_orderstatus = 'O'")).table


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL),
i AS (SELECT user_id, event_type, n * 10 AS n, total FROM g WHERE user_id % 3 = 0 UNION ALL SELECT user_id + 1000000000, event_type, n, total FROM g WHERE user_id % 3 = 1)
SELECT g.user_id, g.event_type, coalesce(i.n, g.n) AS n, g.total FROM g LEFT JOIN i USING (user_id, event_type) UNION ALL SELECT i.* FROM i ANTI JOIN g USING (user_id, event_type)""")
def upsert_multi_key(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    i = g.where("user_id % 3 = 0").withColumn("n", F.col("n") * 10).unionByName(g.where("user_id % 3 = 1").withColumn("user_id", F.col("user_id") + 1_000_000_000))
    return plan_upsert(g, i, ConflictSpec(["user_id", "event_type"], update_values={"n": excluded("n")})).table


_MAP = "from_json(props, 'map<string,string>')"


@query("""WITH f AS (SELECT json_extract_string(props, '$.k') AS k, min(event_id) AS event_id FROM events GROUP BY 1),
i AS (SELECT k, event_id + 1 AS event_id FROM f WHERE event_id % 2 = 0 UNION ALL SELECT 'new' || k, event_id FROM f WHERE event_id % 2 = 1)
SELECT f.k, coalesce(i.event_id, f.event_id) AS event_id FROM f LEFT JOIN i ON f.k = i.k UNION ALL SELECT i.k, i.event_id FROM i ANTI JOIN f ON f.k = i.k""")
def upsert_map_key(spark, d):
    """The key is a map column's: (props, 'k')."""
    f = table(spark, d, "events").select(map_ref(F.expr(_MAP), "k").alias("k"), "event_id").groupBy("k").agg(F.min("event_id").alias("event_id"))
    f = f.select(map_of({"k": F.col("k")}).alias("props"), "event_id")
    i = f.where("event_id % 2 = 0").withColumn("event_id", F.col("event_id") + 1)
    i = i.unionByName(f.where("event_id % 2 = 1").withColumn("props", map_of({"k": F.concat(F.lit("new"), map_ref("props", "k"))})))
    return plan_upsert(f, i, ConflictSpec([("props", "k")], update_values={"event_id": excluded("event_id")})).table.select(map_ref("props", "k").alias("k"), "event_id")


@query("""WITH i AS (SELECT c_custkey + 100000000 AS c_custkey, upper(c_name) AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 100000000, 'X' || c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 1)
SELECT c.c_custkey, c.c_name, CASE WHEN i.c_custkey IS NULL THEN c.c_acctbal ELSE 0 END AS c_acctbal FROM customer c LEFT JOIN i ON lower(i.c_name) = lower(c.c_name) UNION ALL SELECT * FROM i WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer)""")
def upsert_ci_key(spark, d):
    """The declared case-insensitive key lends its expression to a target on the plain column."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    declared = Declared("customer", (Field("c_custkey", "bigint"), Field("c_name", "string"), Field("c_acctbal", "double")), ("c_custkey",), (case_insensitive_unique(["c_name"]),))
    i = c.where("c_custkey % 5 = 0").withColumn("c_name", F.upper("c_name")).unionByName(c.where("c_custkey % 5 = 1").withColumn("c_name", F.concat(F.lit("X"), "c_name")))
    i = i.withColumn("c_custkey", F.col("c_custkey") + 100_000_000)
    return plan_upsert(c, i, ConflictSpec(["c_name"], update_values={"c_acctbal": 0.0}), declared).table


@query(f"""WITH {_T}, n AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS k, o_totalprice AS p FROM t), i AS (SELECT k, p + 1 AS p FROM n WHERE k IS NULL OR k % 10 = 0)
SELECT n.k, round(coalesce(i.p, n.p), 4) AS p FROM n LEFT JOIN i ON n.k = i.k UNION ALL SELECT k, round(p, 4) FROM i WHERE k IS NULL""")
def upsert_null_keys(spark, d):
    n = _orders(spark, d).select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("k"), F.col("o_totalprice").alias("p"))
    i = n.where("k is null or k % 10 = 0").withColumn("p", F.col("p") + 1)
    return plan_upsert(n, i, ConflictSpec(["k"])).table.select("k", F.round("p", 4).alias("p"))


@query(f"WITH {_T}, {_I} SELECT * FROM t UNION ALL {_NEW}")
def upsert_dedupe_batch(spark, d):
    orders = _orders(spark, d)
    i = _incoming(orders)
    return plan_upsert(orders, i.unionByName(i), ConflictSpec(["o_orderkey"], ConflictAction.NOTHING)).table


@query(f"WITH {_T} SELECT o_custkey AS custkey, min(o_orderkey) AS first_order FROM t WHERE o_custkey IS NOT NULL GROUP BY 1")
def upsert_first_by_key(spark, d):
    """The first incoming row of a key wins under NOTHING."""
    o = _orders(spark, d).select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("first_order")).withColumn("_k0", F.col("custkey"))
    return first_by_key(o, ["_k0"], F.col("first_order")).drop("_k0")


@query(f"WITH {_T}, {_I}, b AS (SELECT o_orderkey FROM inc UNION ALL SELECT o_orderkey FROM inc WHERE o_custkey % 2 = 0) SELECT o_orderkey AS k0, count(*) AS n FROM b GROUP BY 1 HAVING count(*) > 1")
def upsert_dup_key_report(spark, d):
    i = _incoming(_orders(spark, d))
    return duplicate_keys(i.unionByName(i.where("o_custkey % 2 = 0")), UniqueKey(("o_orderkey",)))


@query("""WITH i AS (SELECT c_custkey, c_name || '!' AS c_name FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 100000000, c_name FROM customer WHERE c_custkey % 10 = 1)
SELECT c.c_custkey, coalesce(i.c_name, c.c_name) AS c_name, c.c_mktsegment, CASE WHEN i.c_custkey IS NULL THEN 0 ELSE 2 END AS stamp FROM customer c LEFT JOIN i USING (c_custkey)
UNION ALL SELECT c_custkey, c_name, 'NONE', 2 FROM i WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_defaults(spark, d):
    """A default fills inserts only; a write stamp fills both."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(0).alias("stamp"))
    declared = Declared("customer", (Field("c_custkey", "bigint"), Field("c_name", "string"), Field("c_mktsegment", "string", default="NONE"), Field("stamp", "int", on_write=2)), ("c_custkey",))
    i = c.select("c_custkey", "c_name")
    i = i.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("!"))).unionByName(i.where("c_custkey % 10 = 1").withColumn("c_custkey", F.col("c_custkey") + 100_000_000))
    filled, update = fill_defaults(i, declared)
    return plan_upsert(c, filled, ConflictSpec(["c_custkey"]), declared, set_columns=update).table


@query("SELECT event_id, json_extract_string(props, '$.k') AS props__k FROM events")
def values_map_key(spark, d):
    return R.values(table(spark, d, "events").withColumn("props", F.expr(_MAP)), "event_id", "props__k")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def map_ref_keys(spark, d):
    props = F.expr(_MAP)
    return table(spark, d, "events").select("event_id", map_ref(props, "k").alias("k"), map_ref(props, "missing").alias("missing"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS uid, CAST(NULL AS VARCHAR) AS empty, 3 AS size FROM events")
def map_build(spark, d):
    m = map_of({"kind": F.col("event_type"), "user": F.col("user_id"), "empty": None})
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", map_ref("m", "kind").alias("kind"), map_ref("m", "user").alias("uid"), map_ref("m", "empty").alias("empty"), F.size("m").alias("size"))


@query("SELECT event_id, event_type AS k, 'x' AS added FROM events")
def map_merge(spark, d):
    """A repeated key takes the last value; the update of a map column with an expression."""
    m = map_update(F.expr(_MAP), {"k": F.col("event_type"), "added": "x"})
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", map_ref("m", "k").alias("k"), map_ref("m", "added").alias("added"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS a, '1' AS b, CAST(NULL AS VARCHAR) AS c FROM events")
def map_cast(spark, d):
    written = coerce_map({"b": 1, "c": None})
    m = F.map_concat(coerced_map_column(F.create_map(F.lit("a"), F.col("user_id"))), map_of(written))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", map_ref("m", "a").alias("a"), map_ref("m", "b").alias("b"), map_ref("m", "c").alias("c"))


@query("SELECT event_id, round(epoch(ts), 4) AS seconds FROM events")
def epoch_seconds(spark, d):
    return table(spark, d, "events").select("event_id", F.round(epoch("ts"), 4).alias("seconds"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'none') AS last_one,
coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'none') AS first_one FROM orders""")
def is_not_none(spark, d):
    a, b = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", last_not_null(a, b, default="none").alias("last_one"), last_not_null(a, b, default="none", first_wins=True).alias("first_one"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, length(o_orderpriority) AS n FROM orders")
def annotate_shadow(spark, d):
    """A shadowing annotation; the other one still reads the base column."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return R.annotate(o, o_orderpriority=F.upper("o_orderpriority"), n=F.length("o_orderpriority").cast("bigint"))


@query("SELECT o_orderkey, lower(o_orderstatus) AS status_new FROM orders")
def annotate_rename(spark, d):
    return R.rename_annotations(R.annotate(table(spark, d, "orders").select("o_orderkey"), status=F.lit(None)), status="dropped").join(
        R.rename_annotations(table(spark, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("s")), s="status_new"), "o_orderkey"
    ).drop("dropped")


@query("SELECT o_custkey, min(o_orderdate) AS o_orderdate, count(*) AS n FROM orders GROUP BY 1")
def annotate_group_by(spark, d):
    """The aggregate has the name of the column it reads."""
    return R.group_annotate(table(spark, d, "orders"), ["o_custkey"], o_orderdate=F.min("o_orderdate"), n=F.count("*"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice > 100000 THEN 'large' ELSE 'other' END AS kind FROM orders")
def annotate_case(spark, d):
    return table(spark, d, "orders").select("o_orderkey", case((F.col("o_orderstatus") == "O", "open"), (F.col("o_totalprice") > 100000, "large"), default="other").alias("kind"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', 'ABSENT')")
def in_values_text(spark, d):
    return R.in_values(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW", "ABSENT", None]).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 15000")
def in_values_int(spark, d):
    """Five thousand literals: a semi-join with a local relation."""
    return R.in_values(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", range(0, 15000, 3))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)")
def in_values_fk(spark, d):
    """Referred rows as objects."""
    return R.in_values(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [{"c_custkey": i} for i in range(1, 13)], field="c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def in_values_subquery(spark, d):
    return R.in_values(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query("SELECT o_orderkey FROM orders WHERE lower(md5(CAST(o_orderkey AS VARCHAR))) IN (SELECT md5(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey IN (3, 33, 333))")
def in_values_uuid(spark, d):
    """Identifiers as canonical lower-case text."""
    import hashlib

    return R.in_values(table(spark, d, "orders").withColumn("u", F.md5(F.col("o_orderkey").cast("string"))), "u", [hashlib.md5(str(i).encode()).hexdigest() for i in (3, 33, 333)]).select("o_orderkey")


@query("""SELECT o_orderkey, o_orderstatus = 'O' AS eq, o_custkey IS NULL AS is_null, (o_orderstatus = 'F') IS TRUE AS is_true, o_totalprice > 100000 AS gt, o_totalprice <= 50000 AS le,
(o_orderstatus = 'O' AND o_totalprice > 100000) AS conj, CAST(o_orderkey % 2 AS BOOLEAN) AS odd FROM orders""")
def boolean_expressions(spark, d):
    open_ = equals("o_orderstatus", F.lit("O"))
    return table(spark, d, "orders").select(
        "o_orderkey", open_.alias("eq"), is_same("o_custkey", None).alias("is_null"), is_same(equals("o_orderstatus", F.lit("F")), True).alias("is_true"), greater("o_totalprice", 100000).alias("gt"),
        at_most("o_totalprice", 50000).alias("le"), both(open_, greater("o_totalprice", 100000)).alias("conj"), to_bool(F.col("o_orderkey") % 2).alias("odd"),
    )


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT -1, 'static', -1")
def static_row_union(spark, d):
    return R.union_static(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), n_nationkey=-1, n_name="static", n_regionkey=-1)


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def fk_path_join(spark, d):
    return R.select_related(table(spark, d, "nation"), "region", table(spark, d, "region"), "n_regionkey", "r_regionkey", True).select("n_nationkey", F.col("region.r_name").alias("r_name"))


@query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END = n_nationkey")
def select_related(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("ref"))
    return R.select_related(c, "nation", table(spark, d, "nation"), "ref", "n_nationkey").select("c_custkey", "nation.n_name", "nation.n_regionkey")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def related_optional_null(spark, d):
    """A related block whose columns are all null is no relation."""
    l = table(spark, d, "labels").select(F.col("doc_id").alias("l_doc_id"), F.col("quality").alias("l_quality"))
    flat = table(spark, d, "documents").select("doc_id").join(l, F.col("doc_id") == F.col("l_doc_id"), "left")
    return R.related_or_null(flat, "label", ["l_doc_id", "l_quality"], "l_").select("doc_id", F.col("label").isNotNull().alias("labelled"), F.col("label.quality").alias("quality"))


@query("SELECT event_type, date_trunc('second', ts) AS second, min(value) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def truncated_group(spark, d):
    e = table(spark, d, "events").withColumn("second", truncated("second", "ts").cast("timestamp_ntz"))
    return R.group_annotate(e, ["event_type", "second"], value=F.min("value"), n=F.count("*"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10")
def top_k(spark, d):
    return R.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, "-o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 AND o_custkey IS NOT NULL")
def filter_values(spark, d):
    return R.values(table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000) & F.col("o_custkey").isNotNull()), "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS n FROM orders")
def row_count(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation")
def projected_rows(spark, d):
    """The declared columns by name: unknown ones dropped, missing ones null, types converted."""
    declared = Declared("nation", (Field("id", "bigint", column="n_nationkey"), Field("name", "string", column="n_name"), Field("note", "string")))
    return R.project(table(spark, d, "nation"), declared)


_YEARS = [Partition(f"y{y}", "range", datetime(y, 1, 1), datetime(y + 1, 1, 1)) for y in range(1992, 1998)]


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1992 AND 1997 THEN 'y' || year(o_orderdate) ELSE 'rest' END AS part FROM orders")
def partition_route_range(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return o.select("o_orderkey", route(["o_orderdate"], [*_YEARS, Partition("rest", "default")]).alias("part"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '5-LOW' THEN 'slow' END AS part FROM orders")
def partition_route_list(spark, d):
    """Without a default partition some rows have none."""
    return table(spark, d, "orders").select("o_orderkey", route(["o_orderpriority"], [Partition("fast", "list", members=("1-URGENT", "2-HIGH")), Partition("slow", "list", members=("5-LOW",))]).alias("part"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE 'other' END AS part FROM orders")
def partition_route_default(spark, d):
    return table(spark, d, "orders").select("o_orderkey", route(["o_orderstatus"], [Partition("other", "default"), Partition("f", "list", members=("F",))]).alias("part"))


@query("SELECT count(*) AS n, count(*) AS routed, 4 AS parts FROM orders")
def partition_route_hash_coverage(spark, d):
    """Every row lies in exactly one of four hash partitions."""
    parts = [Partition(f"h{i}", "hash", modulus=4, remainder=i) for i in range(4)]
    o = table(spark, d, "orders").select(route(["o_orderkey"], parts).alias("part"))
    return o.agg(F.count("*").alias("n"), F.count("part").alias("routed"), F.count_distinct("part").cast("int").alias("parts"))


def _bucket_sql(start: str, name: str) -> str:
    return f"WITH b AS (SELECT o_orderkey, {start} AS s FROM orders) SELECT o_orderkey, CAST(s AS TIMESTAMP) AS bucket, {name} AS name FROM b"


def _bucketed(spark, d, size: TimePartitionSize) -> DataFrame:
    start = bucket_start(size, "o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", start.cast("timestamp_ntz").alias("bucket"), bucket_name(size, start).alias("name"))


@query(_bucket_sql("date_trunc('year', o_orderdate)", "strftime(s, '%Y')"))
def partition_bucket_year(spark, d):
    return _bucketed(spark, d, TimePartitionSize(years=1))


@query(_bucket_sql("date_trunc('month', o_orderdate)", "lower(strftime(s, '%Y_%b'))"))
def partition_bucket_month(spark, d):
    return _bucketed(spark, d, TimePartitionSize(months=1))


@query(_bucket_sql("date_trunc('week', o_orderdate)", "strftime(s, '%Y_week_%W')"))
def partition_bucket_week(spark, d):
    return _bucketed(spark, d, TimePartitionSize(weeks=1))


@query(_bucket_sql("DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 5.0) * 5 AS INTEGER)", "lower(strftime(s, '%Y_%b_%d'))"))
def partition_bucket_day5(spark, d):
    return _bucketed(spark, d, TimePartitionSize(days=5))


@query(_bucket_sql("date_trunc('day', o_orderdate)", "lower(strftime(s, '%Y_%b_%d_%H:00:00'))"))
def partition_bucket_hour(spark, d):
    """Hour buckets begin at the day's first hour."""
    return _bucketed(spark, d, TimePartitionSize(hours=1))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def partition_pruned_scan(spark, d):
    """Only the partitions that a range can touch are scanned."""
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    keep = pruned(_YEARS, datetime(1994, 1, 1), datetime(1996, 1, 1))
    bounds = (F.col("o_orderdate") >= F.lit(keep[0].lower)) & (F.col("o_orderdate") < F.lit(keep[-1].upper)) if keep else F.lit(False)
    return o.where(bounds).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def partition_retention(spark, d):
    """Rows that stay after partitions of two years and more before 1998 are dropped."""
    strategy = CurrentTimeStrategy(TimePartitionSize(years=1), 1, Span(TimeUnit.YEARS, 3), clock=lambda: datetime(1998, 6, 1, tzinfo=timezone.utc))
    newest = next(strategy.to_delete())
    return table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(newest.upper).cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


@query("SELECT 'o_' || strftime(m, '%Y_%m') AS name, strftime(m, '%Y-%m-%d %H:00:00') AS lower_bound, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d %H:00:00') AS upper_bound FROM (SELECT unnest(generate_series(TIMESTAMP '2019-01-01', TIMESTAMP '2019-12-01', INTERVAL 1 MONTH)) AS m)")
def partition_plan_names(spark, d):
    """The twelve monthly partitions that a strategy plans on 2019-01-30."""
    plan = CurrentTimeStrategy(TimePartitionSize(months=1), 12, name_format="%Y_%m", clock=lambda: datetime(2019, 1, 30, tzinfo=timezone.utc)).to_create()
    return spark.createDataFrame([(p.full_name("o"), p.lower, p.upper) for p in plan], "name string, lower_bound string, upper_bound string")


@query("SELECT l_orderkey AS k0, l_linenumber AS k1, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations_composite(spark, d):
    return unique_violations(table(spark, d, "lineitem"), UniqueKey(("l_orderkey", "l_linenumber")))


@query("SELECT o_custkey AS k0, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def cond_unique_violations(spark, d):
    return unique_violations(table(spark, d, "orders"), UniqueKey(("o_custkey",), condition="o_orderstatus = 'P'"))


@query("WITH n AS (SELECT c_name FROM customer UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 9 = 0) SELECT lower(c_name) AS k0, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def ci_unique_violations(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return unique_violations(c.select("c_name").unionByName(c.where("c_custkey % 9 = 0").select(F.upper("c_name").alias("c_name"))), case_insensitive_unique(["c_name"]))


@query("SELECT json_extract_string(props, '$.k') AS k0, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def map_unique_violations(spark, d):
    return unique_violations(table(spark, d, "events").select(F.expr(_MAP).alias("props")), map_unique("props", "k"))


@query("SELECT event_id FROM events WHERE event_id % 5 = 0")
def map_required_violations(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.expr(_MAP)).otherwise(map_of({"other": 1})).alias("props"))
    return required_violations(e, Required("props", "k")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 10000")
def check_rule_violations(spark, d):
    return check_violations(table(spark, d, "orders"), Check("o_totalprice > 10000")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey + 700 NOT IN (SELECT c_custkey FROM customer)")
def fk_violations(spark, d):
    return foreign_key_violations(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 700).alias("ref")), "ref", table(spark, d, "customer"), "c_custkey").select("o_orderkey")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def view_query(spark, d):
    """A view by SQL text over registered tables."""
    table(spark, d, "customer").createOrReplaceTempView("tw_customer")
    table(spark, d, "nation").createOrReplaceTempView("tw_nation")
    return spark.sql("SELECT n_name, count(*) AS customers FROM tw_customer JOIN tw_nation ON c_nationkey = n_nationkey GROUP BY 1")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def view_params(spark, d):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "F", "least": 250000}, o=table(spark, d, "orders"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def matview_snapshot_vs_refresh(spark, d):
    """A materialized view in a catalog, refreshed after its table has changed."""
    import atexit
    import shutil
    import tempfile

    from tablewright.catalog import Catalog

    root = _catalog_root(spark)
    if root is None:
        root = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, root, True)
    catalog = Catalog(spark, f"{root}/matview-{_unique()}")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    t = catalog.create_table(Declared("o", (Field("o_orderkey", "bigint"), Field("o_orderstatus", "string")), ("o_orderkey",)), rows=orders)
    catalog.create_view("by_status", "SELECT o_orderstatus, count(*) AS n FROM o GROUP BY 1", materialized=True)
    t.delete("o_orderkey % 2 = 1")
    catalog.refresh("by_status", concurrently=True)
    return catalog.read_view("by_status")


def _catalog_root(spark) -> str | None:
    """The shared folder of the cluster, where it is a local path of the driver's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.removeprefix("file://") if named and (named.startswith("file://") or named.startswith("/")) else None


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


@query(f"WITH {_T} SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice FROM t WHERE o_totalprice > 1000 AND o_orderkey % 10 <> 1 UNION ALL SELECT o_orderkey, lower(o_orderstatus), o_totalprice FROM t WHERE o_orderkey % 10 = 1")
def shadow_migrate(spark, d):
    """Fill from a snapshot, clean, and catch up with rows that came meanwhile."""
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice")
    filled = o.where("o_orderkey % 10 != 1").withColumn("o_orderstatus", F.lower("o_orderstatus"))
    cleaned = filled.where("o_totalprice > 1000")
    late = o.where("o_orderkey % 10 = 1").withColumn("o_orderstatus", F.lower("o_orderstatus"))
    return plan_upsert(cleaned, late, ConflictSpec(["o_orderkey"], ConflictAction.NOTHING)).table


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_totalprice < 20000)")
def delete_where(spark, d):
    return table(spark, d, "orders").where(~F.coalesce(F.expr("o_totalprice < 20000"), F.lit(False))).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("SELECT strftime(TIMESTAMP '2025-06-16' + INTERVAL (i * 5) DAY, '%Y-%m-%d %H:00:00') AS lower_bound, lower(strftime(TIMESTAMP '2025-06-16' + INTERVAL (i * 5) DAY, '%Y_%b_%d')) AS name FROM range(3) r(i)")
def partition_anchor_days(spark, d):
    """Five-day partitions are counted from the epoch."""
    size = TimePartitionSize(days=5)
    at = size.start(datetime(2025, 6, 20))
    rows = []
    for _ in range(3):
        p = time_partition(size, at)
        rows.append((p.lower, p.name))
        at = size.as_delta().after(at)
    return spark.createDataFrame(rows, "lower_bound string, name string")
