"""One query per operator of the query surface, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as fn
from quern.functions import transforms as tr
from quern.plans import expr as e
from quern.plans.query import Query, nan_low, sum_or_zero
from quern.session import fresh_dir
from quern.sources.catalog import Catalog
from quern.sources.transaction import Transaction
from quern.sources.types import rename_column
from quern.streaming import tables as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> Query:
        return Query(self.spark.read.parquet(f"{self.sf}/{name}.parquet"))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], Query | DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            got = f(Tables(spark, sf))
            return got.to_df() if isinstance(got, Query) else got

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def simple(name: str, sql: str, f: Callable[[Tables], Query | DataFrame]) -> None:
    query(name, sql)(f)


c = F.col

# Projections and filters

simple(
    "scan_project", "SELECT o_orderkey, o_totalprice FROM orders",
    lambda t: t.orders.select("o_orderkey", "o_totalprice")
)
simple(
    "select_struct_access", "SELECT o_orderkey, o_custkey AS a, o_totalprice AS b FROM orders",
    lambda t: t.orders.let(
        s=F.struct(c("o_custkey").alias("a"), F.struct(c("o_totalprice").alias("b")).alias("i"))
    ).select("o_orderkey", c("s.a"), c("s.i.b"))
)
simple(
    "select_let",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem",
    lambda t: t.lineitem.let(n=c("l_extendedprice") * (1 - c("l_discount"))).let(g=c("n") * (1 + c("l_tax"))).select(
        "l_orderkey", "l_linenumber", c("n").alias("net"), c("g").alias("gross")
    )
)
simple(
    "select_cast", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
    lambda t: t.orders.select("o_orderkey", "o_custkey").cast(o_custkey="string")
)
simple(
    "select_indexed", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders",
    lambda t: t.orders.order_by("o_totalprice", "o_orderkey").index("i").select("o_orderkey", "i")
)
simple(
    "where_indexed", "SELECT event_id FROM events QUALIFY (row_number() OVER (ORDER BY ts, event_id) - 1) < user_id",
    lambda t: t.events.order_by("ts", "event_id").where_indexed(lambda i: i < c("user_id")).select("event_id")
)
simple(
    "of_type", "SELECT event_id, value FROM events WHERE event_type = 'click'",
    lambda t: t.events.of_type("click", "event_type").select("event_id", "value")
)
simple(
    "default_if_empty",
    "SELECT r_regionkey, r_name FROM region WHERE r_name = 'NOWHERE' UNION ALL SELECT -1, 'none' WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'NOWHERE')",
    lambda t: t.region.where(c("r_name") == "NOWHERE").default_if_empty(r_regionkey=-1, r_name="none")
)

_PART = "(SELECT p_partkey, nullif(p_size, 7) AS s, nullif(p_name, 'small ring') AS n, CASE WHEN p_size = 9 THEN 'NaN'::DOUBLE WHEN p_size = 7 THEN NULL ELSE p_retailprice END AS x FROM part)"


def _part(t: Tables) -> Query:
    """Parts with nulls and NaN put in."""
    return t.part.select(
        "p_partkey", F.nullif(c("p_size"), F.lit(7)).alias("s"), F.nullif(c("p_name"), F.lit("small ring")).alias("n"),
        F.when(c("p_size") == 9, F.lit(float("nan"))).when(c("p_size") != 7, c("p_retailprice")).alias("x")
    )


for _name, _p, _sql in [
    ("where_lt", e.lt("s", 20), "coalesce(s < 20, false)"),
    ("where_lt_eq", e.lt_eq("s", 20), "coalesce(s <= 20, false)"),
    ("where_gt", e.gt("s", 20), "coalesce(s > 20, false)"),
    ("where_gt_eq", e.gt_eq("s", 20), "coalesce(s >= 20, false)"),
    ("where_eq", e.eq("s", 20), "coalesce(s = 20, false)"), ("where_eq_null", e.eq("s", None), "s IS NULL"),
    ("where_not_eq", e.not_eq("s", 20), "s IS DISTINCT FROM 20"),
    (
        "where_and_or_not", (e.gt("s", 10) & ~e.starts_with("n", "red")) | e.is_null("n"),
        "(coalesce(s > 10, false) AND NOT coalesce(starts_with(n, 'red'), false)) OR n IS NULL"
    ),
    ("where_in", e.is_in("s", [1, 5, 12]), "coalesce(s IN (1, 5, 12), false)"),
    ("where_not_in", e.not_in("s", [1, 5, 12]), "NOT coalesce(s IN (1, 5, 12), false)"),
    ("where_starts_with", e.starts_with("n", "red"), "coalesce(starts_with(n, 'red'), false)"),
    ("where_not_starts_with", e.not_starts_with("n", "red"), "NOT coalesce(starts_with(n, 'red'), false)"),
    ("where_is_null", e.is_null("s"), "s IS NULL"), ("where_not_null", e.not_null("s"), "s IS NOT NULL"),
    ("where_is_nan", e.is_nan("x"), "coalesce(isnan(x), false)"),
    ("where_not_nan", e.not_nan("x"), "NOT coalesce(isnan(x), false)"),
    ("where_two_valued_not", ~e.gt("s", 20), "NOT coalesce(s > 20, false)"), ("where_true", e.TRUE, "true"),
    ("where_false", e.FALSE, "false"),
    ("where_transform", e.eq(e.Term("s", "truncate[10]"), 20), "coalesce(s - ((s % 10) + 10) % 10 = 20, false)")
]:
    simple(
        _name, f"SELECT p_partkey, s, n FROM {_PART} WHERE {_sql}", lambda t,
        p=_p: _part(t).where(p).select("p_partkey", "s", "n")
    )
simple(
    "where_from_json", f"SELECT p_partkey FROM {_PART} WHERE coalesce(s >= 10, false) AND NOT (n IS NULL)",
    lambda t: _part(t).where(
        e.from_json(
            {
                "type": "and", "left": {"type": "gt-eq", "term": "s", "value": 10},
                "right": {"type": "not", "child": {"type": "is-null", "term": "n"}}
            }
        )
    ).select("p_partkey")
)

# Flattening

simple(
    "selectmany_split",
    "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL",
    lambda t: t.documents.where(c("text").isNotNull()).let(
        ls=fn.split(c("text"), "\n")
    ).select_many("ls", "line", "doc_id")
)
simple(
    "selectmany_array_explode",
    "SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(embedding[p], 5) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)",
    lambda t: t.embeddings.select_many("embedding", "v", "vec_id", position="pos").select(
        "vec_id", "pos", F.round("v", 5).alias("v")
    )
)
simple(
    "selectmany_struct",
    "SELECT doc_id, x.cell_no AS cell_no, x.cell_type AS cell_type FROM (SELECT doc_id, unnest(cells) AS x FROM documents)",
    lambda t: t.documents.select_many("cells", "x", "doc_id").select("doc_id", "x.cell_no", "x.cell_type")
)

# Joins

simple(
    "join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    lambda t: t.orders.join(t.customer, [("o_custkey", "c_custkey")], "l.o_orderkey", "r.c_name")
)
simple(
    "join_composite_key",
    "SELECT a.l_orderkey, count(*) AS n FROM (SELECT l_orderkey, nullif(l_linenumber, 3) AS k FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, nullif(l_linenumber, 3) AS k FROM lineitem WHERE l_quantity > 45) b ON a.l_orderkey IS NOT DISTINCT FROM b.l_orderkey AND a.k IS NOT DISTINCT FROM b.k GROUP BY 1",
    lambda t: t.lineitem.select("l_orderkey", F.nullif(c("l_linenumber"), F.lit(3)).alias("k")).join(
        t.lineitem.where(c("l_quantity") > 45).select(
            "l_orderkey", F.nullif(c("l_linenumber"), F.lit(3)).alias("k")
        ).distinct(),
        ["l_orderkey", "k"], "l.l_orderkey"
    ).group_by("l_orderkey").agg(F.count("*").alias("n"))
)
simple(
    "join_left",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey",
    lambda t: t.customer.left_join(
        t.orders.where(e.gt("o_totalprice", 400000)), [("c_custkey", "o_custkey")], "l.c_custkey", "r.o_orderkey"
    )
)
simple(
    "join_right",
    "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON c_custkey = o_custkey",
    lambda t: t.customer.where(e.gt("c_acctbal", 5000)).right_join(
        t.orders, [("c_custkey", "o_custkey")], "l.c_custkey", "r.o_orderkey"
    )
)
simple(
    "join_group",
    "SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY 1",
    lambda t: t.customer.group_join(t.orders.where(e.gt("o_totalprice", 400000)), [("c_custkey", "o_custkey")], "os", "o_orderkey", "o_totalprice").select(
        "c_custkey", F.size("os").cast("bigint").alias("n"),
        F.round(fn.total(F.transform("os", lambda x: x["o_totalprice"]), "double"), 2).alias("total")
    )
)
simple(
    "join_semi",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    lambda t: t.customer.semi_join(
        t.orders.where(e.gt("o_totalprice", 400000)), [("c_custkey", "o_custkey")]
    ).select("c_custkey")
)
simple(
    "join_anti",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    lambda t: t.customer.anti_join(
        t.orders.where(e.gt("o_totalprice", 400000)), [("c_custkey", "o_custkey")]
    ).select("c_custkey")
)
simple(
    "join_theta",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    lambda t: t.nation.theta_join(
        t.nation, c("l.n_nationkey") < c("r.n_nationkey"), c("l.n_nationkey").alias("a"), c("r.n_nationkey").alias("b"),
        equal=[("n_regionkey", "n_regionkey")]
    )
)
simple(
    "join_cross_filter", "SELECT r_regionkey, n_nationkey FROM region, nation WHERE n_nationkey % 5 < r_regionkey",
    lambda t: t.region.theta_join(
        t.nation, c("r.n_nationkey") % 5 < c("l.r_regionkey"), "l.r_regionkey", "r.n_nationkey"
    )
)
simple(
    "join_range",
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50",
    lambda t: t.part.range_join(
        Query(t.supplier.df.withColumn("hi", c("s_acctbal") + 50)), "p_retailprice", "s_acctbal", "hi", 50,
        "l.p_partkey", "r.s_suppkey"
    )
)
simple(
    "join_in_memory",
    "SELECT o_orderkey, w AS weight FROM orders JOIN (VALUES ('O', 1), ('F', 2)) v(k, w) ON o_orderstatus = k",
    lambda t: t.orders.join_local(
        [("O", 1), ("F", 2)], "k string, weight int", [("o_orderstatus", "k")], "l.o_orderkey", "r.weight"
    )
)

# Groups

simple(
    "group_by_agg",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1",
    lambda t: t.lineitem.group_by("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("l_quantity").alias("low"),
        F.max("l_quantity").alias("high")
    )
)
simple(
    "group_by_const", "SELECT 1 AS k, count(*) AS n FROM orders HAVING count(*) > 0",
    lambda t: t.orders.group_by(F.lit(1).alias("k")).agg(F.count("*").alias("n"))
)
simple(
    "group_by_const_empty", "SELECT 1 AS k, count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0",
    lambda t: t.orders.where(e.lt("o_orderkey", 0)).group_by(F.lit(1).alias("k")).agg(F.count("*").alias("n"))
)
simple(
    "group_by_null_key", f"SELECT s, count(*) AS n FROM {_PART} GROUP BY 1",
    lambda t: _part(t).group_by("s").agg(F.count("*").alias("n"))
)
simple(
    "group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
    lambda t: t.orders.group_by("o_custkey").agg(F.count("*").alias("n")).where(e.gt("n", 15))
)
simple(
    "group_top1",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    lambda t: t.orders.group_by("o_custkey").top(
        1, "o_custkey", c("o_totalprice").desc(), c("o_orderkey")
    ).select("o_custkey", "o_orderkey")
)
simple(
    "group_materialize",
    "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys FROM orders GROUP BY 1",
    lambda t: t.orders.group_by("o_custkey").collect("g", "o_orderkey").select(
        "o_custkey", F.array_join(F.array_sort(F.transform("g", lambda x: x["o_orderkey"])), ",").alias("keys")
    )
)
simple(
    "count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1",
    lambda t: t.lineitem.group_by("l_returnflag").agg(F.count_distinct("l_suppkey").alias("n"))
)
simple(
    "count_if", "SELECT event_type, count(*) FILTER (value > 50) AS n FROM events GROUP BY 1",
    lambda t: t.events.group_by("event_type").agg(F.count_if(c("value") > 50).alias("n"))
)
simple(
    "sum_empty_zero",
    "SELECT o_orderstatus, coalesce(CAST(sum(CASE WHEN o_totalprice > 499990 THEN o_orderkey END) AS BIGINT), 0) AS total FROM orders GROUP BY 1",
    lambda t: t.orders.group_by("o_orderstatus").agg(
        sum_or_zero(F.when(c("o_totalprice") > 499990, c("o_orderkey"))).alias("total")
    )
)
simple(
    "min_max",
    "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders",
    lambda t: t.orders.df.agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last")
    )
)
simple(
    "avg_by", "SELECT p_brand, round(avg(p_size), 6) AS size FROM part GROUP BY 1",
    lambda t: t.part.group_by("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size"))
)
simple(
    "count_by", "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1",
    lambda t: t.events.count_by(c("event_type"))
)
simple(
    "min_by", "SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS k FROM customer GROUP BY 1",
    lambda t: t.customer.group_by("c_nationkey").agg(
        F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("k")
    )
)
simple(
    "max_by", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS k FROM customer GROUP BY 1",
    lambda t: t.customer.group_by("c_nationkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("k")
    )
)
simple(
    "fold_aggregate",
    "SELECT o_custkey AS key, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list(o_orderkey ORDER BY o_orderkey)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS value FROM orders GROUP BY 1",
    lambda t: t.orders.aggregate_by(
        c("o_custkey"), F.lit(7).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003, c("o_orderkey"), c("o_orderkey")
    )
)
simple(
    "any_all",
    "SELECT o_custkey, bool_or(o_totalprice > 450000) AS some, bool_and(o_totalprice > 20000) AS every FROM orders GROUP BY 1",
    lambda t: t.orders.group_by("o_custkey").agg(
        F.bool_or(c("o_totalprice") > 450000).alias("some"), F.bool_and(c("o_totalprice") > 20000).alias("every")
    )
)

# Sets

simple(
    "distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct()
)
simple(
    "distinct_by",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    lambda t: t.orders.order_by("o_orderkey").distinct_by("o_custkey").select("o_custkey", "o_orderkey")
)
_NC, _NS = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


def _nations(t: Tables) -> tuple[Query, Query]:
    return t.customer.where(e.gt("c_acctbal", 9000)).select(
        c("c_nationkey").alias("k")
    ), t.supplier.where(e.gt("s_acctbal", 5000)).select(c("s_nationkey").alias("k"))


simple("concat", f"{_NC} UNION ALL {_NS}", lambda t: (lambda a, b: a.concat(b))(*_nations(t)))
simple("union", f"{_NC} UNION {_NS}", lambda t: (lambda a, b: a.union(b))(*_nations(t)))
simple("intersect", f"{_NC} INTERSECT {_NS}", lambda t: (lambda a, b: a.intersect(b))(*_nations(t)))
simple("except", f"{_NC} EXCEPT {_NS}", lambda t: (lambda a, b: a.except_(b))(*_nations(t)))
_CP, _SP = "SELECT c_nationkey AS k, c_custkey AS id FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k, s_suppkey AS id FROM supplier WHERE s_acctbal > 5000"


def _people(t: Tables) -> tuple[Query, Query]:
    return t.customer.where(e.gt("c_acctbal", 9000)).select(c("c_nationkey").alias("k"), c("c_custkey").alias("id")).order_by(
        "id"
    ), t.supplier.where(e.gt(
        "s_acctbal", 5000
    )).select(c("s_nationkey").alias("k"), c("s_suppkey").alias("id")).order_by("id")


simple(
    "union_by",
    f"SELECT k, id FROM (SELECT *, 0 AS s FROM ({_CP}) UNION ALL SELECT *, 1 FROM ({_SP})) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, id) = 1",
    lambda t: (lambda a, b: a.union_by(b, "k"))(*_people(t))
)
simple(
    "intersect_by",
    f"SELECT k, id FROM ({_CP}) WHERE k IN (SELECT k FROM ({_SP})) QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1",
    lambda t: (lambda a, b: a.intersect_by(b, "k"))(*_people(t))
)
simple(
    "except_by",
    f"SELECT k, id FROM ({_CP}) WHERE k NOT IN (SELECT k FROM ({_SP})) QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1",
    lambda t: (lambda a, b: a.except_by(b, "k"))(*_people(t))
)

# Order and positions

_O = "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def _orders(t: Tables) -> Query:
    return t.orders.order_by(c("o_totalprice").desc()).then_by("o_orderkey")


simple("order_take", f"{_O} LIMIT 100", lambda t: _orders(t).take(100).select("o_orderkey"))
simple("order_skip_take", f"{_O} LIMIT 100 OFFSET 50", lambda t: _orders(t).take_range(50, 150).select("o_orderkey"))
simple("skip", f"{_O} OFFSET 1000", lambda t: _orders(t).skip(1000).select("o_orderkey"))
simple(
    "take_last", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 100",
    lambda t: _orders(t).take_last(100).select("o_orderkey")
)
simple(
    "skip_last", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey DESC OFFSET 100",
    lambda t: _orders(t).skip_last(100).select("o_orderkey")
)
simple(
    "order_nulls", f"SELECT p_partkey, row_number() OVER (ORDER BY s ASC NULLS FIRST, p_partkey) - 1 AS i FROM {_PART}",
    lambda t: _part(t).order_by(c("s").asc(), "p_partkey").index("i").select("p_partkey", "i")
)
simple(
    "order_nan_low",
    f"SELECT p_partkey, row_number() OVER (ORDER BY x IS NOT NULL, coalesce(isnan(x), false) DESC, x, p_partkey) - 1 AS i FROM {_PART}",
    lambda t: _part(t).order_by(*nan_low("x"), "p_partkey").index("i").select("p_partkey", "i")
)
simple(
    "apply_function", "SELECT o_orderkey, o_totalprice * 2 AS value FROM orders",
    lambda t: t.orders.apply(lambda x: x * 2, "double", "o_totalprice").select("o_orderkey", "value")
)
simple(
    "reverse_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS i FROM orders",
    lambda t: t.orders.order_by("o_orderkey").reverse(c("o_orderkey").desc()).index("i").select("o_orderkey", "i")
)
simple(
    "top_n_per_group",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    lambda t: _orders(t).top_by_group(3, "o_custkey").select("o_custkey", "o_orderkey")
)
_STOP = "(SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE NOT value < 60)"
simple(
    "take_while", f"SELECT event_id FROM events WHERE event_id < {_STOP}",
    lambda t: t.events.order_by("event_id").take_while(e.lt("value", 60.0)).select("event_id")
)
simple(
    "skip_while", f"SELECT event_id FROM events WHERE event_id >= {_STOP}",
    lambda t: t.events.order_by("event_id").skip_while(e.lt("value", 60.0)).select("event_id")
)
simple(
    "chunk",
    "SELECT CAST((event_id_pos) // 7 AS BIGINT) AS chunk, array_to_string(list(event_id ORDER BY event_id_pos), ',') AS ids FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS event_id_pos FROM events) GROUP BY 1",
    lambda t: t.events.order_by("ts", "event_id").chunk(7, "event_id").select(
        "chunk", F.array_join(F.transform("items", lambda x: x["event_id"]), ",").alias("ids")
    )
)
simple(
    "zip",
    "SELECT o_orderkey, event_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) JOIN (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events) USING (i)",
    lambda t: t.orders.order_by("o_orderkey").zip(t.events.order_by("ts", "event_id"), "l.o_orderkey", "r.event_id")
)
simple(
    "zip_lag",
    "SELECT event_id, lead(event_id) OVER (ORDER BY ts, event_id) AS next_id FROM events QUALIFY next_id IS NOT NULL",
    lambda t: (
        lambda q: q.zip(q.skip(1), c("l.event_id"), c("r.event_id").alias("next_id"))
    )(t.events.order_by("ts", "event_id"))
)
simple("element_at", f"{_O} LIMIT 1 OFFSET 10", lambda t: _orders(t).take_range(10, 11).select("o_orderkey"))
simple(
    "append_prepend", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (99, 'LAST'), (-1, 'FIRST')",
    lambda t: t.region.order_by("r_regionkey").append(r_regionkey=99, r_name="LAST").select(
        "r_regionkey", "r_name"
    ).order_by("r_regionkey").prepend(r_regionkey=-1, r_name="FIRST").select("r_regionkey", "r_name")
)
simple("shuffle", "SELECT r_regionkey FROM region", lambda t: t.region.shuffle(3).select("r_regionkey"))

# Functions

simple(
    "transform_dates",
    "SELECT event_id, year(ts) - 1970 AS y, (year(ts) - 1970) * 12 + month(ts) - 1 AS m, date_diff('day', DATE '1970-01-01', ts::DATE) AS d, epoch_us(ts) // 3600000000 AS h FROM events",
    lambda t: t.events.select(
        "event_id", tr.years(c("ts")).cast("bigint").alias("y"), tr.months(c("ts")).cast("bigint").alias("m"),
        tr.days(c("ts")).cast("bigint").alias("d"), tr.hours(c("ts")).cast("bigint").alias("h")
    )
)
simple(
    "transform_truncate",
    "SELECT o_orderkey, o_orderkey - o_orderkey % 100 AS t, substr(o_orderpriority, 1, 3) AS p FROM orders",
    lambda t: t.orders.select(
        "o_orderkey", tr.transform("truncate[100]", c("o_orderkey")).alias("t"),
        tr.transform("truncate[3]", c("o_orderpriority"), "text").alias("p")
    )
)
def _murmur_mix(k: str) -> str:
    """One word of the hash in SQL over unsigned 64-bit numbers."""
    m = f"(({k} * 3432918353) & 4294967295)"
    return f"((((({m} << 15) | ({m} >> 17)) & 4294967295) * 461845907) & 4294967295)"


def _murmur_step(h: str, k: str) -> str:
    x = f"xor({h}, {_murmur_mix(k)})"
    return f"((((({x} << 13) | ({x} >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295)"


_U = "CAST({0} AS UBIGINT)"
_BYTE = "CAST(ascii(substr(p, {0}, 1)) AS UBIGINT)"
_WORD4 = " + ".join(f"{_BYTE.format(f'4 * i + {b + 1}')} * {256 ** b}" for b in range(4))
_TAIL = " + ".join(
    f"(CASE WHEN length(p) % 4 > {b} THEN {_BYTE.format(f'length(p) // 4 * 4 + {b + 1}')} ELSE 0 END) * {256 ** b}" for b in range(
        3
    )
)
_BUCKET = f"""WITH l AS (SELECT o_orderkey, o_orderpriority, {_murmur_step(_murmur_step('0::UBIGINT', _U.format('o_orderkey & 4294967295')), _U.format('(o_orderkey >> 32) & 4294967295'))} h, 8::UBIGINT n FROM orders),
 p AS (SELECT p, list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, length(p) // 4), lambda i: {_WORD4})), lambda h, k: {_murmur_step('h', 'k')}) h0, {_TAIL} t, CAST(length(p) AS UBIGINT) n
  FROM (SELECT DISTINCT o_orderpriority p FROM orders)),
 q AS (SELECT p, CASE WHEN n % 4 = 0 THEN h0 ELSE xor(h0, {_murmur_mix('t')}) END h, n FROM p),
 e AS (SELECT 'l' k, o_orderkey key, o_orderpriority p, h, n FROM l UNION ALL SELECT 'p', NULL, p, h, n FROM q),
 f AS (SELECT k, key, p, xor(h, n) h FROM e), g AS (SELECT k, key, p, (xor(h, h >> 16) * 2246822507) & 4294967295 h FROM f),
 i AS (SELECT k, key, p, (xor(h, h >> 13) * 3266489909) & 4294967295 h FROM g), j AS (SELECT k, key, p, CAST((xor(h, h >> 16) & 2147483647) % 16 AS INTEGER) b FROM i)
 SELECT x.key AS o_orderkey, x.b AS b, y.b AS p FROM j x JOIN j y ON x.p = y.p WHERE x.k = 'l' AND y.k = 'p'"""

query("transform_bucket", _BUCKET)(
    lambda t: t.orders.select(
        "o_orderkey", tr.bucket(16, c("o_orderkey")).alias("b"), tr.bucket(16, c("o_orderpriority"), "text").alias("p")
    )
)
simple("str_functions", """SELECT p_partkey, length(p_name) AS len, substr(p_name, 3, 4) AS sub, CAST(instr(p_name, 'r') - 1 AS INTEGER) AS idx, contains(p_name, 'ring') AS has, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ring') AS ends,
 upper(p_name) AS up, trim('  ' || p_name || ' ') AS tr, replace(p_name, 'e', 'E') AS rep, CASE WHEN length(p_name) >= 14 THEN p_name ELSE lpad(p_name, 14, '*') END AS pad, p_brand || '' || p_type AS cat, substr(p_name, 2, 1) AS ch,
 regexp_matches(p_name, '^[a-m]') AS rx, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rr FROM part""",
       lambda t: t.part.select("p_partkey", fn.length(c("p_name")).cast("bigint").alias("len"), fn.substring(c("p_name"), 2, 4).alias("sub"), fn.index_of(c("p_name"), "r").alias("idx"), fn.contains(c("p_name"), "ring").alias("has"), fn.starts_with(c("p_name"), "red").alias("starts"),
                               fn.ends_with(c("p_name"), "ring").alias("ends"), fn.to_upper("p_name").alias("up"), fn.trim(F.concat(F.lit("  "), c("p_name"), F.lit(" "))).alias("tr"), fn.replace(c("p_name"), "e", "E").alias("rep"), fn.pad_left(c("p_name"), 14, "*").alias("pad"),
                               fn.concat(c("p_brand"), F.lit(None), c("p_type")).alias("cat"), fn.char_at(c("p_name"), 1).alias("ch"), fn.is_match(c("p_name"), "^[a-m]").alias("rx"), fn.regex_replace(c("p_name"), "[aeiou]", "_").alias("rr")))
simple("math_functions", """SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_discount - 0.05) AS a, round_even(l_quantity / 2, 0) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, round(sqrt(l_quantity), 6) AS s, round(l_quantity ** 2, 4) AS p,
 round(ln(l_quantity), 6) AS l, l_linenumber % 3 AS m, l_orderkey // 7 AS d FROM lineitem""",
       lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", fn.absolute(c("l_discount") - 0.05).alias("a"), fn.round_even(c("l_quantity") / 2).alias("r"), fn.floor("l_extendedprice").alias("f"), fn.ceiling("l_extendedprice").alias("ce"), F.round(fn.sqrt("l_quantity"), 6).alias("s"),
                                   F.round(fn.power(c("l_quantity"), F.lit(2)), 4).alias("p"), F.round(fn.log(c("l_quantity")), 6).alias("l"), fn.modulo(c("l_linenumber"), F.lit(3)).alias("m"), e.divide(c("l_orderkey"), F.lit(7)).alias("d")))
simple(
    "date_functions",
    """SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofweek(ts) AS w, dayofyear(ts) AS yd, ts::DATE AS dt, ts + INTERVAL 3 DAY AS plus3, ts + INTERVAL 1 MONTH AS next FROM events""",
    lambda t: t.events.select(
        "event_id",
        *(
            f("ts").cast("bigint").alias(n) for n,
            f in (("y", fn.year), ("mo", fn.month), ("d", fn.day), ("h", fn.hour), ("mi", fn.minute))
        ),
        fn.day_of_week(c("ts")).cast("bigint").alias("w"), fn.day_of_year("ts").cast("bigint").alias("yd"),
        fn.date("ts").alias("dt"), fn.add_days(c("ts"), 3).alias("plus3"), fn.add_months(c("ts"), 1).alias("next")
    )
)
simple("array_functions", """SELECT vec_id, len(embedding) AS n, list_contains(embedding, embedding[3]) AS has, len(list_filter(embedding, lambda x: x > 0)) AS pos, len(list_filter(embedding, lambda x: x > 0.25)) > 0 AS some, len(list_filter(embedding, lambda x: x <= -1)) = 0 AS every,
 round(embedding[1], 5) AS first, round(list_max(embedding), 5) AS high, round(list_sort(embedding)[1], 5) AS low FROM embeddings""",
       lambda t: t.embeddings.select("vec_id", fn.count(c("embedding")).cast("bigint").alias("n"), fn.array_contains("embedding", fn.element_at(c("embedding"), 2)).alias("has"), F.size(fn.array_where("embedding", lambda x: x > 0)).cast("bigint").alias("pos"), fn.any_of(c("embedding"), lambda x: x > 0.25).alias("some"),
                                     fn.all_of(c("embedding"), lambda x: x > -1).alias("every"), F.round(fn.first_or_default(c("embedding")), 5).alias("first"), F.round(fn.array_max("embedding"), 5).alias("high"), F.round(fn.element_at(fn.array_order("embedding"), 0), 5).alias("low")))
simple(
    "map_functions",
    "SELECT snapshot_id, sequence_number, CAST(cardinality(summary) AS BIGINT) AS n, map_contains(summary, 'added-records') AS has, summary['operation'] AS op, summary['engine-name'] AS engine FROM snapshots",
    lambda t: t.snapshots.select(
        "snapshot_id", "sequence_number", F.size("summary").cast("bigint").alias("n"),
        fn.contains_key("summary", "added-records").alias("has"),
        fn.try_value_of(c("summary"), "operation").alias("op"),
        fn.try_value_of(c("summary"), "engine-name").alias("engine")
    )
)
simple(
    "conditional",
    f"SELECT p_partkey, CASE WHEN s > 25 THEN 'big' ELSE 'small' END AS size, coalesce(n, 'none') AS name, s IS NOT NULL AS known FROM {_PART}",
    lambda t: _part(t).select(
        "p_partkey", fn.choose(c("s") > 25, F.lit("big"), F.lit("small")).alias("size"),
        fn.first_known("n", F.lit("none")).alias("name"), fn.has_value(c("s")).alias("known")
    )
)
simple(
    "json_props", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events",
    lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
)

# Whole queries

simple(
    "sql_sum_length",
    "SELECT CAST(sum(length(p_name)) AS BIGINT) AS len, CAST(sum(p_size) AS BIGINT) AS num, count(*) AS n FROM part",
    lambda t: t.part.df.agg(
        F.sum(F.length("p_name")).alias("len"), F.sum("p_size").alias("num"), F.count("*").alias("n")
    )
)
simple(
    "sql_text", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
    lambda t: t.spark.sql("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", nation=t.nation.df)
)
simple(
    "columnar_aggregate",
    "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) FILTER (substr(l_returnflag, 1, 1) = 'A') AS n, round(avg(l_quantity), 6) AS a FROM lineitem",
    lambda t: t.lineitem.df.agg(
        F.sum("l_linenumber").alias("s"), F.count_if(fn.char_at(c("l_returnflag"), 0) == "A").alias("n"),
        F.round(F.avg("l_quantity"), 6).alias("a")
    )
)
_NET = "l_extendedprice * (1 - l_discount)"


def _net() -> Column:
    return c("l_extendedprice") * (1 - c("l_discount"))


simple(
    "tpch_q1_like",
    f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_NET}), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY 1, 2",
    lambda t: t.lineitem.where(c("l_shipdate") <= F.lit("2001-01-01").cast("timestamp_ntz")).group_by("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(_net()), 2).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )
)
simple(
    "tpch_q3_like",
    f"SELECT o_orderkey, round(sum({_NET}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10",
    lambda t: t.lineitem.join(
        t.orders.where(c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).semi_join(
            t.customer.where(e.eq("c_mktsegment", "BUILDING")), [("o_custkey", "c_custkey")]
        ),
        [("l_orderkey", "o_orderkey")], "r.o_orderkey", "l.l_extendedprice", "l.l_discount"
    ).group_by("o_orderkey").agg(F.round(
        F.sum(_net()), 2
    ).alias("revenue")).order_by(c("revenue").desc(), "o_orderkey").take(10)
)
simple(
    "tpch_q5_like",
    f"SELECT n_name, round(sum({_NET}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
    lambda t: t.lineitem.join(t.orders.join(t.customer, [("o_custkey", "c_custkey")], "l.o_orderkey", "r.c_nationkey"), [("l_orderkey", "o_orderkey")], "l.*", "r.c_nationkey").join(
        t.supplier, [("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")], "l.l_extendedprice", "l.l_discount",
        "r.s_nationkey", composite=False
    ) .join(t.nation.semi_join(t.region.where(e.eq("r_name", "ASIA")), [("n_regionkey", "r_regionkey")]), [
        ("s_nationkey", "n_nationkey")
    ], "r.n_name", "l.l_extendedprice", "l.l_discount").group_by("n_name").agg(F.round(F.sum(
        _net()
    ), 2).alias("revenue"))
)
simple(
    "tpch_q6_like",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24",
    lambda t: t.lineitem.where(c("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).where(c("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).where(
        e.gt_eq("l_discount", 0.03) & e.lt_eq("l_discount", 0.07) & e.lt("l_quantity", 24.0)
    ).df.agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("revenue"))
)

# Tables


def _new_table(t: Tables, name: str) -> Transaction:
    catalog = Catalog(t.spark, fresh_dir(t.spark, "warehouse"))
    catalog.create_namespace("q")
    return Transaction(catalog, f"q.{name}")


@query("table_append_read", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def _append_read(t: Tables) -> DataFrame:
    return _new_table(t, "orders").append(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").df
    ).commit().to_df()


@query("table_time_travel", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000")
def _time_travel(t: Tables) -> DataFrame:
    tx, o = _new_table(t, "orders"), t.orders.select("o_orderkey", "o_totalprice")
    first = tx.append(o.where(e.lt("o_totalprice", 100000.0)).df).commit()
    last = tx.append(o.where(e.gt_eq("o_totalprice", 100000.0)).df).commit()
    return last.to_df(snapshot_id=first.metadata["current-snapshot-id"])


@query("table_incremental", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000")
def _incremental(t: Tables) -> DataFrame:
    tx, o = _new_table(t, "orders"), t.orders.select("o_orderkey", "o_totalprice")
    first = tx.append(o.where(e.lt("o_totalprice", 100000.0)).df).commit()
    return tx.append(
        o.where(e.gt_eq("o_totalprice", 100000.0)).df
    ).commit().incremental(first.metadata["current-snapshot-id"])


@query("table_schema_rename", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def _renamed(t: Tables) -> DataFrame:
    table = _new_table(t, "orders").append(t.orders.select("o_orderkey", "o_totalprice").df).commit()
    return table.evolve(rename_column(table.schema, "o_totalprice", "price")).to_df()


@query(
    "table_delete_antijoin",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice <= 400000"
)
def _deleted(t: Tables) -> DataFrame:
    tx = _new_table(t, "orders")
    tx.append(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").df).commit()
    tx.delete_equal(t.orders.where(e.eq("o_orderstatus", "F")).select("o_orderstatus").distinct().df).commit()
    return tx.delete_where(e.gt("o_totalprice", 400000.0)).commit().to_df(select=["o_orderkey", "o_orderstatus"])


@query("table_filtered_scan", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def _filtered(t: Tables) -> DataFrame:
    return _new_table(t, "orders").append(t.orders.select("o_orderkey", "o_totalprice").df).commit().to_df(
        where=e.gt("o_totalprice", 300000.0), select=["o_orderkey"]
    )


@query("table_metadata_files", "SELECT count(*) AS records FROM orders")
def _files(t: Tables) -> DataFrame:
    return _new_table(t, "orders").append(
        t.orders.select("o_orderkey", "o_totalprice").df
    ).commit().files().agg(F.sum("record_count").alias("records"))


@query("table_overwrite", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def _overwrite(t: Tables) -> DataFrame:
    tx, rows = _new_table(t, "customers"), t.customer
    tx.append(rows.select("c_custkey", "c_name").df).commit()
    return tx.overwrite(rows.where(e.gt("c_acctbal", 0.0)).select("c_custkey", "c_name").df).commit().to_df()


# Extensions beside the reference's surface

simple(
    "ext_rollup",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    lambda t: t.lineitem.df.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
)
simple(
    "ext_window_counts",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    lambda t: streams.windowed(
        t.events.df.withColumn("ts", c("ts").cast("timestamp")), "ts", "1 hour", "1 hour", ["event_type"],
        F.count("*").alias("n")
    ).select(c("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
)
