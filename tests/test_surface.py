"""The query surface, predicates, functions, tables, records and streams."""

import dataclasses
import datetime as dt
import decimal
import enum
import io
import json
import math
import struct
import threading
import uuid

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from quern.functions import scalars as fn
from quern.functions import transforms as tr
from quern.plans import expr as e
from quern.plans.query import CardinalityError, EmptySequenceError, Query, indexed
from quern.sources import avrofile, manifest, model
from quern.sources import metadata as md
from quern.sources import types as qt
from quern.sources.catalog import Catalog, Identifier, NamespaceNotEmpty, NoSuchNamespace, NoSuchTable
from quern.sources.storage import AlreadyExists
from quern.sources.transaction import Transaction
from quern.streaming import tables as streams

SF = "/root/testdata/sf0.001"

# Predicates

ROWS = [
    (1, 5, "red ring", 1.0), (2, None, "redo", float("nan")), (3, 7, None, None), (4, 5, "", 2.5), (5, None, None, -1.0)
]


def py(p, r):
    """The algebra over Python values, in two-valued logic."""
    if p.op in ("true", "false"):
        return p.op == "true"
    if p.op == "and":
        return py(p.args[0], r) and py(p.args[1], r)
    if p.op == "or":
        return py(p.args[0], r) or py(p.args[1], r)
    if p.op == "not":
        return not py(p.args[0], r)
    v = r[p.args[0].name]
    x = p.args[1] if len(p.args) > 1 else None
    return {
        "is-null": lambda: v is None, "not-null": lambda: v is not None, "is-nan": lambda: v is not None and v != v,
        "not-nan": lambda: not (v is not None and v != v), "in": lambda: v in x, "not-in": lambda: v not in x,
        "eq": lambda: v == x, "not-eq": lambda: v != x, "starts-with": lambda: v is not None and v.startswith(x),
        "not-starts-with": lambda: not (v is not None and v.startswith(x)), "lt": lambda: v is not None and v < x,
        "lt-eq": lambda: v is not None and v <= x, "gt": lambda: v is not None and v > x,
        "gt-eq": lambda: v is not None and v >= x
    }[p.op]()


LEAVES = [
    e.lt("s", 6), e.lt_eq("s", 5), e.gt("s", 5), e.gt_eq("s", 7), e.eq("s", 5), e.eq("s", None), e.not_eq("s", 5),
    e.not_eq("s", None), e.is_in("s", [5, 9]), e.is_in("s", [None, 7]), e.is_in("s", []), e.not_in("s", [5]),
    e.not_in("s", [None]), e.starts_with("n", "red"), e.not_starts_with("n", "red"), e.is_null("n"), e.not_null("n"),
    e.is_nan("x"), e.not_nan("x"), e.TRUE, e.FALSE
]
TREES = st.recursive(
    st.sampled_from(LEAVES),
    lambda k: st.one_of(
        st.builds(lambda a, b: a & b, k, k), st.builds(lambda a, b: a | b, k, k), st.builds(lambda a: ~a, k)
    ),
    max_leaves=5
)


@pytest.fixture(scope="session")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, s int, n string, x double").cache()


@settings(max_examples=40, deadline=None)
@given(st.lists(TREES, min_size=10, max_size=10))
def test_predicates_follow_two_valued_logic(frame, preds):
    got = frame.select("id", *(p.column().alias(f"p{i}") for i, p in enumerate(preds))).collect()
    for r in got:
        row = dict(zip(("id", "s", "n", "x"), ROWS[r.id - 1], strict=True))
        assert [r[f"p{i}"] for i in range(10)] == [py(p, row) for p in preds]
    for p in preds[:2]:
        assert {r.id for r in frame.where(p.filter()).collect()} == {
            r[0] for r in ROWS if py(p, dict(zip(("id", "s", "n", "x"), r, strict=True)))
        }
        assert e.from_json(p.to_json()) == p


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/lineitem.parquet").where(
        (e.gt("l_quantity", 45.0) & e.starts_with("l_returnflag", "R")).filter()
    ).select("l_orderkey")
    text = plan._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in text and "StringStartsWith(l" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text


def test_arithmetic_of_the_surface(spark):
    r = spark.range(1).select(
        e.divide(F.lit(-7), F.lit(2)).alias("d"), e.wrap_add(F.lit((1 << 31) - 1), F.lit(1)).alias("w"),
        e.join_text(F.lit("a"), F.lit(None), F.lit(1)).alias("t"), fn.round_even(F.lit(2.5)).alias("r"),
        fn.modulo(F.lit(-7), F.lit(2)).alias("m"), fn.utf16_length(F.lit("a🚀")).alias("u"),
        fn.truncate(F.lit(-1.5)).alias("tr")
    ).first()
    assert (r.d, r.w, r.t, r.r, r.m, r.u, r.tr) == (-3, -(1 << 31), "a1", 2.0, -1, 3, -1)


def test_bucket_values(spark):
    """Values given with the format: the hash of 34 is checked against the plain function."""
    assert tr.murmur3(struct.pack("<q", 34)) == 2017239379
    nums = [0, 1, -1, 34, 2**31, -(2**40), 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(n,) for n in nums], "n bigint").select(
        "n", tr.hash_long(F.col("n")).alias("h"), tr.bucket(16, F.col("n")).alias("b")
    ).collect()
    for r in got:
        h = tr.murmur3(struct.pack("<q", r.n))
        assert r.h == h and r.b == (h & 0x7FFFFFFF) % 16
    r = spark.createDataFrame([("abc", None)], "t string, z string").select(
        tr.bucket(7, F.col("t"), "text").alias("b"), tr.bucket(7, F.col("z"), "text").alias("z")
    ).first()
    assert r.b == (tr.murmur3(b"abc") & 0x7FFFFFFF) % 7 and r.z is None


def test_maps_and_arrays(spark):
    df = spark.createDataFrame([({"a": 1}, [3, None, 1])], "m map<string,int>, a array<int>")
    r = df.select(
        fn.try_value_of(F.col("m"), "b").alias("t"), fn.value_of(F.col("m"), "a").alias("v"),
        fn.total(F.col("a")).alias("s"), fn.any_of(F.col("a"), lambda x: x > 2).alias("any"),
        fn.all_of(F.col("a"), lambda x: x > 0).alias("all")
    ).first()
    assert (r.t, r.v, r.s, r["any"], r["all"]) == (None, 1, 4, True, False)
    with pytest.raises(Exception, match="not in the map"):
        df.select(fn.value_of(F.col("m"), "b")).collect()


# Query


def test_positions(spark):
    df = spark.range(1000).repartition(9).withColumn("k", F.col("id") % 7)
    got = indexed(df, [F.col("k"), F.col("id")]).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(1000)) and [(r.k, r.id) for r in got] == sorted(
        (i % 7, i) for i in range(1000)
    )
    q = Query(df).order_by("id")
    assert [r.id for r in q.take_last(3).to_list()] == [997, 998, 999]
    assert q.skip_last(990).count() == 10
    assert [
        r.id for r in q.take_while(e.lt("id", 5)).to_list()
    ] == list(range(5)) and q.skip_while(e.lt("id", 5)).count() == 995
    assert q.take_while(e.TRUE).count() == 1000 and q.skip_while(e.TRUE).count() == 0
    assert [len(r["items"]) for r in q.chunk(300, "id").to_df().orderBy("chunk").collect()] == [300, 300, 300, 100]
    assert q.element_at(10).id == 10 and q.element_at(-1).id == 999 and q.element_at_or_default(5000) is None
    with pytest.raises(ValueError, match="order"):
        Query(df).take_last(1)
    with pytest.raises(IndexError):
        q.element_at(5000)


def test_terminals(spark):
    none, one, two = (Query(spark.range(n)).order_by("id") for n in (0, 1, 2))
    for call in (
        none.first, none.last, none.single, lambda: none.average("id"), lambda: none.min("id"),
        lambda: none.min_by("id")
    ):
        with pytest.raises(EmptySequenceError):
            call()
    with pytest.raises(CardinalityError):
        two.single()
    with pytest.raises(CardinalityError):
        two.single_or_default()
    assert one.single().id == 0 and two.last().id == 1 and none.single_or_default() is None and none.first_or_default(
        default=9
    ) == 9
    assert none.sum("id") == 0 and two.sum("id") == 1 and two.average("id") == 0.5 and two.max_by("id").id == 1
    assert not none.any() and none.all(
        e.lt("id", 0)
    ) and two.any(e.gt("id", 0)) and not two.all(e.gt("id", 0)) and two.contains(id=1) and not two.contains(id=7)
    assert two.sequence_equal(
        Query(spark.range(2)).order_by("id")
    ) and not two.sequence_equal(one) and not two.sequence_equal(two.reverse(F.col("id").desc()))
    assert two.aggregate(F.lit(1).cast("bigint"), lambda a, x: a * 10 + x, F.col("id")) == 101
    assert two.to_dictionary("id")[1].id == 1 and len(two.to_lookup("id")) == 2 and len(two.to_set()) == 2
    with pytest.raises(OverflowError):
        Query(spark.createDataFrame([((1 << 31) - 1,), (1,)], "i int")).sum("i")
    assert Query(spark.range(3).limit(0)).default_if_empty(id=4).to_list()[0].id == 4


def test_join_keys_and_nulls(spark):
    a = Query(spark.createDataFrame([(1, 1), (None, 1), (2, None)], "k int, j int"))
    b = Query(spark.createDataFrame([(1, 1, "x"), (None, 1, "y"), (2, None, "z")], "k int, j int, v string"))
    assert {r.v for r in a.join(b, "k", "r.v").to_list()} == {"x", "z"}
    assert {r.v for r in a.join(b, ["k", "j"], "r.v").to_list()} == {"x", "y", "z"}
    assert sorted(len(r.g) for r in a.group_join(b, "k", "g", "v").to_list()) == [0, 1, 1]
    assert a.left_join(b, "k", "l.k", "r.v").count() == 3 and a.right_join(b, "k", "r.v").count() == 3
    assert a.semi_join(b, "k").count() == 2 and a.anti_join(b, "k").count() == 1


def test_reverse_turns_every_key(spark):
    rows = [(1, None), (1, 2), (2, 1), (None, 5), (2, None)]
    df = spark.createDataFrame(rows, "a int, b int")
    for keys in (
        ["a", F.col("b").desc()], [F.col("a").desc_nulls_first(), F.col("b").asc_nulls_last()],
        [(F.col("a") + 1).asc(), F.col("b").desc_nulls_last()]
    ):
        q = Query(df).order_by(*keys)
        assert [tuple(r) for r in q.reverse().to_list()] == [tuple(r) for r in q.to_list()][::-1]
        assert q.reverse().to_df().columns == ["a", "b"]


def test_ranges_of_any_length(spark):
    import random

    rnd = random.Random(3)
    points = [(i, rnd.choice([None, rnd.uniform(-500, 500), rnd.uniform(-5, 5)])) for i in range(300)]
    ranges = [
        (i, lo, lo + rnd.choice([-1, 0, 0.5, 3, 70, 900])) for i,
        lo in enumerate(rnd.uniform(-500, 500) for _ in range(60))
    ] + [(99, None, 5.0)]
    a, b = Query(spark.createDataFrame(points, "i int, x double")), Query(
        spark.createDataFrame(ranges, "j int, lo double, hi double")
    )
    for width in (1, 0.25, 100):
        got = sorted(tuple(r) for r in a.range_join(b, "x", "lo", "hi", width, "l.i", "r.j").to_list())
        assert got == sorted(
            (i, j) for i, x in points for j, lo, hi in ranges if x is not None and lo is not None and lo <= x <= hi
        )


def test_joins_without_equal_columns_need_a_small_side(spark, monkeypatch):
    from quern.plans import query

    monkeypatch.setattr(query, "LOCAL_ROWS", 5)
    small, large = Query(spark.range(3)), Query(spark.range(10))
    less = F.col("l.id") < F.col("r.id")
    assert large.theta_join(
        small, less, F.col("l.id")
    ).count() == 3 and small.theta_join(large, less, F.col("l.id")).count() == 24
    with pytest.raises(ValueError, match="range_join"):
        large.theta_join(large, less, F.col("l.id"))


def test_flattening_and_group_joins(spark):
    a = Query(spark.createDataFrame([(1, "x y"), (2, ""), (3, None)], "k int, t string"))
    got = a.select_many_with(lambda t: [(w,) for w in (t or "").split()], "w string", "t", keep=["k"])
    assert sorted(tuple(r) for r in got.to_list()) == [(1, "x"), (1, "y")]
    g = a.group_join_agg(
        Query(spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "k int, v int")), "k", n=F.count("*"), s=F.sum("v")
    )
    assert sorted((r.k, r.n, r.s) for r in g.to_list()) == [(1, 2, 11), (2, None, None), (3, None, None)]


def test_values_as_text_and_other_types(spark):
    from quern.functions import values

    row = (
        1.5, bytes(range(20)), dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 6),
        dt.timedelta(days=1, microseconds=5), [1, None], {"b": 1, "a": None}, (True, None), None,
        decimal.Decimal("1.20")
    )
    df = spark.createDataFrame(
        [row],
        "f double, b binary, d date, t timestamp_ntz, i interval day to second, a array<int>, m map<string,int>, s struct<x: boolean, y: string>, n int, c decimal(9,2)"
    )
    r = df.select(*(values.format_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).first()
    assert tuple(r) == (
        "1.5", "0x000102030405060708090a0b0c0d0e0f… (20 bytes)", "2020-01-02", "2020-01-02T03:04:05.000006",
        "86400.000005 s", "[1, null]", "{a: null, b: 1}", "{x: true, y: null}", "null", "1.20"
    )
    n = spark.createDataFrame([(300, 1.0), (7, 2.5), (None, None)], "i int, x double")
    got = n.select(
        values.read_as(F.col("i"), T.IntegerType(), "tinyint", False),
        values.read_as(F.col("x"), T.DoubleType(), "bigint", False),
        values.read_as(F.col("i"), T.IntegerType(), "string")
    ).collect()
    assert [tuple(r) for r in got] == [(None, 1, "300"), (7, None, "7"), (None, None, None)]
    with pytest.raises(Exception, match="no tinyint: 300"):
        n.select(values.read_as(F.col("i"), T.IntegerType(), "tinyint")).collect()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=23), max_size=20))
def test_many_hashes_at_once(texts):
    assert tr.murmur3_many(texts).tolist() == [tr.murmur3(x) for x in texts]


def test_c_stream(spark):
    import pyarrow as pa

    df = spark.range(1000).select("id", F.array("id").alias("a"))
    assert sorted(pa.table(model.CStream(df)).column("id").to_pylist()) == list(range(1000))
    assert pa.table(model.CStream(df.limit(0))).num_rows == 0


# Every registered query against its SQL, on the smallest tables


def test_catalogue_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    import os

    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    for name, text in sql.items():
        df = queries[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[k]) for k in cols) for r in df.collect())
        cur = con.execute(text)
        at = [[d[0] for d in cur.description].index(k) for k in cols]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall()), name
    assert __spark_entry__.entry(spark).count() > 0


# Types and codec


def test_types_parse_and_convert(spark):
    for t in (
        "boolean", "int", "long", "float", "double", "date", "time", "timestamp", "timestamptz", "timestamp_ns",
        "timestamptz_ns", "string", "uuid", "binary", "decimal(9,2)", "fixed[6]"
    ):
        p = qt.Primitive.parse(t)
        assert qt.type_from_json(qt.type_to_json(p)) == p and qt.to_spark(p) is not None
    for bad in ("decimal(39,2)", "decimal(2,3)", "blob"):
        with pytest.raises(qt.SchemaError):
            qt.Primitive.parse(bad)
    s, nxt = qt.from_spark(T.DataType.fromDDL("a int, b struct<c: array<map<string, bigint>>>, d date"))
    assert [i for i, *_ in qt.walk(s)] == list(range(1, nxt)) and [p for _, p, _ in qt.walk(s)] == [
        "a", "b", "b.c", "b.c.element", "b.c.element.key", "b.c.element.value", "d"
    ]
    schema = qt.Schema(s)
    assert qt.Schema.from_json(schema.to_json()) == schema and qt.name_mapping(schema)[1]["fields"][0]["names"] == ["c"]
    with pytest.raises(qt.SchemaError):
        qt.widen_column(schema, "a", "string")
    assert qt.widen_column(schema, "a", "long").find("a").type.name == "long"


VALUES = st.recursive(st.none() | st.integers(-(2**63), 2**63 - 1), lambda k: st.lists(k, max_size=3), max_leaves=6)


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(-(2**63), 2**63 - 1), st.none() | st.integers(-(2**31), 2**31 - 1), st.text(),
            st.none() | st.binary(), st.none() | st.lists(st.integers(-9, 9)),
            st.dictionaries(st.text(), st.floats(allow_nan=False)), st.booleans()
        ),
        max_size=20
    ),
    st.sampled_from(["null", "deflate"])
)
def test_codec_round_trip(rows, codec):
    schema = {
        "type": "record", "name": "r",
        "fields": [
            {"name": "a", "type": "long"}, {"name": "b", "type": ["null", "int"]}, {"name": "c", "type": "string"},
            {"name": "d", "type": ["null", "bytes"]},
            {"name": "e", "type": ["null", {"type": "array", "items": "int"}]},
            {"name": "f", "type": {"type": "map", "values": "double"}}, {"name": "g", "type": "boolean"}
        ]
    }
    recs = [dict(zip("abcdefg", r, strict=True)) for r in rows]
    head, got = avrofile.decode(avrofile.encode(schema, recs, {"k": "v"}, codec, block=3))
    assert head == {"k": "v"} and list(got) == recs


def test_codec_is_read_by_the_java_library(spark, tmp_path):
    rows = [
        {
            "manifest_path": f"p{i}", "manifest_length": 1 << 40, "partition_spec_id": 0, "content": 0,
            "sequence_number": i, "min_sequence_number": 0, "added_snapshot_id": -5, "added_files_count": 1,
            "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": 2, "existing_rows_count": 0,
            "deleted_rows_count": 0, "partitions": None, "key_metadata": b"k"
        } for i in range(3)
    ]
    path = tmp_path / "list.avro"
    path.write_bytes(avrofile.encode(manifest.LIST_SCHEMA, rows))
    avro = spark._jvm.org.apache.avro
    reader = avro.file.DataFileReader(spark._jvm.java.io.File(str(path)), avro.generic.GenericDatumReader())
    seen = []
    while reader.hasNext():
        seen.append(reader.next().get("manifest_path").toString())
    assert seen == ["p0", "p1", "p2"]
    with pytest.raises(ValueError):
        avrofile.decode(b"nope")


# Catalog and tables


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/wh")
    c.create_namespace("db", {"owner": "me"})
    return c


def test_namespaces(catalog):
    catalog.create_namespace("db.inner")
    catalog.create_namespace("db", if_not_exists=True)
    with pytest.raises(AlreadyExists):
        catalog.create_namespace("db")
    with pytest.raises(NoSuchNamespace):
        catalog.create_namespace("no.where")
    catalog.create_table("db.inner.t", "id int")
    assert catalog.tree() == {"db": {"inner": {"t": None}}} and "inner/" in catalog.print_tree()
    assert [str(i) for i in catalog.list_namespaces("db")] == ["db.inner"] and catalog.tables("db.inner").count() == 1
    assert catalog.update_namespace_properties("db", {"a": "1"}, ["owner", "nope"]) == {
        "updated": ["a"], "removed": ["owner"], "missing": ["nope"]
    }
    assert catalog.namespace_properties("db") == {"a": "1"}
    with pytest.raises(NamespaceNotEmpty):
        catalog.drop_namespace("db")
    catalog.drop_namespace("db", recursive=True, purge=True)
    assert not catalog.namespace_exists("db")
    assert Identifier.of("a.b") == Identifier.of(["a", "b"]) == Identifier.of("a\x1fb") and hash(
        Identifier.of("a.b")
    ) == hash(Identifier.of(("a", "b")))


def test_table_life(spark, catalog):
    t = catalog.create_table("db.t", "id int, name string", properties={"p": "1"})
    assert t.to_df().count() == 0 and catalog.table_exists("db.t") and t.metadata["properties"] == {"p": "1"}
    with pytest.raises(AlreadyExists):
        catalog.create_table("db.t", "id int")
    with pytest.raises(NoSuchTable):
        catalog.load_table("db.nope")
    catalog.rename_table("db.t", "db.u")
    assert [i.name for i in catalog.list_tables("db")] == ["u"]
    catalog.register_table("db.again", catalog.load_table("db.u").location)
    catalog.drop_table("db.u")
    with Transaction(catalog, "db.again") as tx:
        tx.append(spark.createDataFrame([(1, "x")], "id int, name string"))
    assert catalog.load_table("db.again").to_df().count() == 1
    assert Transaction(catalog, "db.again").commit() is None
    with pytest.raises(RuntimeError):
        with Transaction(catalog, "db.again") as tx:
            tx.append(spark.createDataFrame([(2, "y")], "id int, name string"))
            raise RuntimeError
    assert catalog.load_table("db.again").to_df().count() == 1
    with pytest.raises(ValueError, match="no columns"):
        Transaction(catalog, "db.again").append(spark.createDataFrame([(1,)], "other int"))
    empty = catalog.create_table("db.zero", T.StructType([]))
    assert empty.to_df().columns == []


def test_snapshots_refs_and_travel(spark, catalog):
    tx = Transaction(catalog, "db.t")
    rows = lambda a, b: spark.range(a, b).select(F.col("id"), F.col("id").cast("string").alias("s"))
    a = tx.append(rows(0, 10)).commit()
    first = a.metadata["current-snapshot-id"]
    a.tag("v1")
    b = tx.append(rows(10, 30), files=1).commit()
    second = b.metadata["current-snapshot-id"]
    assert b.to_df().count() == 30 and b.to_df(snapshot_id=first).count() == 10 and b.to_df(
        ref="v1"
    ).count() == 10 and b.incremental(first).count() == 20 and b.incremental(None).count() == 30
    assert b.to_df(as_of_ms=md.now_ms()).count() == 30
    with pytest.raises(LookupError):
        b.to_df(snapshot_id=1)
    with pytest.raises(LookupError):
        b.to_df(ref="nope")
    snap = md.snapshot_by_id(b.metadata, second)
    assert snap["parent-snapshot-id"] == first and snap["summary"]["operation"] == "append" and snap["summary"][
        "added-records"
    ] == "20" and snap["summary"]["total-records"] == "30"
    Transaction(catalog, "db.t", branch="dev").append(rows(50, 51)).commit()
    now = catalog.load_table("db.t")
    assert now.to_df().count() == 30 and now.to_df(ref="dev").count() == 1
    o = tx.overwrite(rows(0, 3)).commit()
    assert o.to_df().count() == 3 and o.to_df(snapshot_id=second).count() == 30
    assert o.rollback(second).to_df().count() == 30
    kept = catalog.load_table("db.t").expire(md.now_ms() + 1).metadata
    assert {s["snapshot-id"] for s in kept["snapshots"]} == {first, second, kept["refs"]["dev"]["snapshot-id"]}
    assert b.snapshots().count() == 2 and b.manifests().count() == 2 and b.files().agg(
        F.sum("record_count")
    ).first()[0] == 30
    assert [r.id for r in b.to_df(ordered=True).collect()][10:] == list(range(10, 30))


def test_skipping_deletes_and_evolution(spark, catalog):
    tx = Transaction(catalog, "db.t")
    for k in range(4):
        tx.append(
            spark.range(k * 100, k * 100 + 100).select(
                "id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("n"), "id")).alias("s"), F.lit(float(k)).alias("x")
            ),
            files=1
        ).commit()
    t = catalog.load_table("db.t")
    p, _ = t.plan(where=e.gt("id", 250) & e.lt("id", 260))
    assert len(p.tasks) == 1 and p.skipped == 3
    assert t.to_df(where=e.gt("id", 250) & e.lt("id", 260), select=["id"]).count() == 9
    assert t.plan(where=e.starts_with("s", "n30"))[0].skipped == 2 and t.plan(
        where=e.is_null("id")
    )[0].skipped == 4 and t.plan(where=e.eq("id", 5) | e.eq("id", 105))[0].skipped == 2
    tx.delete_where(e.eq("s", None)).commit()
    assert catalog.load_table("db.t").to_df().count() == 360
    tx.delete_equal(spark.createDataFrame([(1,), (2,)], "id bigint")).commit()
    tx.append(spark.createDataFrame([(1, "back", 9.0)], "id bigint, s string, x double")).commit()
    t = catalog.load_table("db.t")
    assert t.to_df().count() == 359 and [r.s for r in t.to_df(where=e.eq("id", 1)).collect()] == ["back"]
    s, last = qt.add_column(qt.rename_column(t.schema, "s", "label"), "extra", "string", t.metadata["last-column-id"])
    t = t.evolve(qt.drop_column(s, "x"))
    row = t.to_df(where=e.eq("id", 1)).first()
    assert row.asDict() == {"id": 1, "label": "back", "extra": None}
    assert t.to_df(snapshot_id=t.metadata["current-snapshot-id"], use_snapshot_schema=True).columns == ["id", "s", "x"]


def test_long_texts_are_not_skipped_by_their_cut_bounds(spark, catalog):
    texts = ["曲" * 40, "é" * 33 + "x", "a" + "д" * 40, "ab" + "🚀" * 17, "x" * 70]
    for k, s in enumerate(texts):
        tx = Transaction(catalog, f"db.cut{k}")
        tx.append(spark.createDataFrame([(1, s), (2, s + "z")], "id int, s string").coalesce(1)).commit()
        t = catalog.load_table(f"db.cut{k}")
        for p in (e.eq("s", s), e.is_in("s", [s]), e.lt_eq("s", s), e.starts_with("s", s)):
            assert 1 in {r.id for r in t.query(where=p).to_df().collect()}, (s, p)
        Transaction(catalog, f"db.cut{k}").delete_where(e.eq("s", s)).commit()
        assert [r.id for r in catalog.load_table(f"db.cut{k}").to_df().collect()] == [2]


def test_commits_conflict_and_are_tried_again(spark, catalog):
    Transaction(catalog, "db.t").append(spark.range(1)).commit()
    stale = catalog.load_table("db.t")
    threads = [
        threading.Thread(
            target=lambda k=k: Transaction(catalog, "db.t", retries=20).append(
                spark.range(10 * k, 10 * k + 10)
            ).commit()
        ) for k in range(1, 5)
    ]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = catalog.load_table("db.t")
    assert now.to_df().count() == 41 and len(now.metadata["snapshots"]) == 5
    with pytest.raises(md.CommitConflict):
        catalog.commit(
            stale, [],
            [{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": stale.metadata["current-snapshot-id"]}]
        )
    with pytest.raises(md.CommitConflict):
        catalog.commit(catalog.stage_table("db.t", "id int"), [], [{"type": "assert-create"}])


def test_updates_and_requirements():
    m = md.new_table("loc")
    ups = [
        {
            "action": "add-schema",
            "schema": {"type": "struct", "schema-id": 0, "fields": [{"id": 3, "name": "a", "type": "int"}]}
        },
        {"action": "set-current-schema", "schema-id": -1},
        {"action": "set-properties", "updates": {"a": "1", "b": "2"}},
        {"action": "remove-properties", "removals": ["a"]}, {"action": "upgrade-format-version", "format-version": 3},
        {"action": "set-location", "location": "new"}, {"action": "assign-uuid", "uuid": "u"},
        {
            "action": "add-spec",
            "spec": {"spec-id": 1, "fields": [{"source-id": 3, "field-id": 1000, "name": "p", "transform": "identity"}]}
        },
        {"action": "set-default-spec", "spec-id": 1},
        {"action": "add-sort-order", "sort-order": {"order-id": 1, "fields": []}},
        {"action": "set-default-sort-order", "sort-order-id": -1},
        {
            "action": "add-snapshot",
            "snapshot": {"snapshot-id": 1, "sequence-number": 1, "timestamp-ms": 1, "manifest-list": "x"}
        },
        {"action": "set-snapshot-ref", "ref-name": "main", "type": "branch", "snapshot-id": 1},
        {"action": "set-statistics", "snapshot-id": 1, "statistics": {"snapshot-id": 1}},
        {"action": "remove-statistics", "snapshot-id": 1},
        {"action": "set-partition-statistics", "partition-statistics": {"snapshot-id": 1}},
        {"action": "remove-partition-statistics", "snapshot-id": 1},
        {"action": "add-encryption-key", "encryption-key": {"key-id": "k"}},
        {"action": "remove-encryption-key", "key-id": "k"},
        {"action": "add-view-version", "view-version": {"version-id": 1}},
        {"action": "set-current-view-version", "view-version-id": -1},
        {"action": "remove-partition-specs", "spec-ids": [0]}
    ]
    new = md.apply(m, ups)
    assert m["schemas"] == [] and new["last-column-id"] == 3 and new["properties"] == {"b": "2"} and new[
        "current-snapshot-id"
    ] == 1 and new["last-sequence-number"] == 1 and new["default-spec-id"] == 1
    md.check(
        new,
        [
            {"type": "assert-table-uuid", "uuid": "u"},
            {"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 1},
            {"type": "assert-last-assigned-field-id", "last-assigned-field-id": 3},
            {"type": "assert-current-schema-id", "current-schema-id": 0},
            {"type": "assert-last-assigned-partition-id", "last-assigned-partition-id": 1000},
            {"type": "assert-default-spec-id", "default-spec-id": 1},
            {"type": "assert-default-sort-order-id", "default-sort-order-id": 1}
        ]
    )
    for bad in ({"type": "assert-create"}, {"type": "assert-current-schema-id", "current-schema-id": 7}):
        with pytest.raises(md.CommitConflict):
            md.check(new, [bad])
    for bad in (
        {"action": "set-current-schema", "schema-id": 9}, {"action": "nope"},
        {"action": "remove-schemas", "schema-ids": [0]}, {"action": "upgrade-format-version", "format-version": 1}
    ):
        with pytest.raises(ValueError):
            md.apply(new, [bad])


def test_views_and_many_commits(spark, catalog):
    Transaction(catalog, "db.nums").append(spark.range(5)).commit()
    catalog.register_views("db")
    catalog.create_view("db.small", "SELECT id FROM nums WHERE id < 2")
    assert catalog.view("db.small").count() == 2
    catalog.create_view("db.small", "SELECT id FROM nums WHERE id < 3", replace=True)
    assert catalog.view("db.small").count() == 3 and len(catalog.load_view("db.small")["versions"]) == 2
    catalog.rename_view("db.small", "db.tiny")
    assert [i.name for i in catalog.list_views("db")] == ["tiny"]
    catalog.create_view("db.foreign", "SELECT 1", dialect="other")
    with pytest.raises(ValueError):
        catalog.view("db.foreign")
    catalog.drop_view("db.tiny")
    a, b = catalog.load_table("db.nums"), catalog.create_table("db.other", "id int")
    up = [{"action": "set-properties", "updates": {"x": "1"}}]
    with pytest.raises(ValueError):
        catalog.commit_many([(a, up, []), (b, [{"action": "nope"}], [])])
    assert "x" not in catalog.load_table("db.nums").metadata["properties"]
    catalog.commit_many([(catalog.load_table("db.nums"), up, []), (b, up, [])])
    assert catalog.load_table("db.other").metadata["properties"]["x"] == "1"


def test_defaults_and_foreign_files(spark, catalog, tmp_path):
    t = Transaction(catalog, "db.d").append(spark.createDataFrame([(1,), (2,)], "id int")).commit()
    s, last = qt.add_column(t.schema, "label", "string", t.metadata["last-column-id"], default="it's")
    s, last = qt.add_column(s, "price", "decimal(9,2)", last, default="1.50")
    t = t.evolve(s)
    assert {tuple(r) for r in t.to_df().collect()} == {
        (1, "it's", decimal.Decimal("1.50")), (2, "it's", decimal.Decimal("1.50"))
    }
    t = Transaction(catalog, "db.d").append(
        spark.createDataFrame([(3, None), (4, "x")], "id int, label string")
    ).commit()
    assert {tuple(r) for r in t.to_df(where=e.gt("id", 2)).collect()} == {
        (3, None, decimal.Decimal("1.50")), (4, "x", decimal.Decimal("1.50"))
    }
    spark.createDataFrame([(5, "old name", 9)], "nr int, tag string, other int").write.parquet(f"{tmp_path}/foreign")
    mapping = [{"field-id": 1, "names": ["id", "nr"]}, {"field-id": 2, "names": ["label", "tag"]}]
    t = Transaction(catalog, "db.d").import_files([f"file://{tmp_path}/foreign"], mapping).commit()
    assert [tuple(r) for r in t.to_df(where=e.eq("id", 5)).collect()] == [(5, "old name", decimal.Decimal("1.50"))]


def test_batches(spark, catalog):
    t = Transaction(catalog, "db.b").append(
        spark.createDataFrame(
            [(i, [i], {"k": i}, (i,)) for i in range(10)], "i int, a array<int>, m map<string,int>, s struct<q: int>"
        )
    ).commit()
    got = list(t.batches(4, select=["i", "a", "m", "s"]))
    assert [b.num_rows for b in got] == [4, 4, 2] and sorted(
        r["s"]["q"] for b in got for r in b.to_pylist()
    ) == list(range(10))


def test_partitioned_and_sorted_writes(spark, catalog):
    schema = T.DataType.fromDDL("id bigint, k string")
    spec = {"spec-id": 1, "fields": [{"source-id": 2, "field-id": 1000, "name": "k", "transform": "identity"}]}
    order = {
        "order-id": 1,
        "fields": [{"source-id": 1, "transform": "identity", "direction": "desc", "null-order": "nulls-last"}]
    }
    t = catalog.create_table("db.p", schema, spec=spec, sort_order=order)
    t = Transaction(catalog, "db.p").append(
        spark.range(1000).select("id", F.concat(F.lit("k"), F.col("id") % 5).alias("k"))
    ).commit()
    assert t.to_df().count() == 1000
    one = spark.read.parquet(t.files().first().file_path).collect()
    assert [r.id for r in one] == sorted((r.id for r in one), reverse=True)


def test_partitions_are_recorded_and_pruned(spark, catalog):
    schema = T.DataType.fromDDL("id bigint, d date, ts timestamp, k string, n int")
    fields = [
        ("month", 2, "month"), ("day", 3, "day"), ("k", 4, "identity"), ("b", 1, "bucket[4]"), ("t", 5, "truncate[10]"),
        ("v", 5, "void")
    ]
    spec = {
        "spec-id": 1,
        "fields": [
            {"source-id": s, "field-id": 1000 + i, "name": n, "transform": tf} for i, (n, s, tf) in enumerate(fields)
        ]
    }
    catalog.create_table("db.p", schema, spec=spec)
    rows = [
        (
            i, dt.date(2019, 11 + i % 2, 3), dt.datetime(1969, 12, 30 + i % 2, 23), [None, "", "a b/c%=é", "x"][i % 4],
            [None, -1, 5, 15][i % 4]
        ) for i in range(24)
    ]
    for part in (rows[:12], rows[12:]):
        Transaction(catalog, "db.p").append(spark.createDataFrame(part, schema)).commit()
    t = catalog.load_table("db.p")
    assert t.to_df().count() == 24
    known = [json.loads(r.partition) for r in t.files().collect()]
    assert {x["k"] for x in known} == {None, "", "a b/c%=é", "x"} and {
        x["month"] for x in known
    } == {598, 599} and {x["day"] for x in known} == {-2, -1} and {x["t"] for x in known} == {None, -10, 0, 10}
    assert all("v" not in x or x["v"] is None for x in known)
    tests = [
        e.eq("k", "x"), e.eq("k", ""), e.is_null("k"), e.eq("k", None), e.not_null("k"), e.starts_with("k", "a b"),
        e.is_in("k", ["x", None]), e.eq("d", dt.date(2019, 11, 3)), e.lt("d", dt.date(2019, 12, 1)),
        e.gt("d", dt.date(2019, 12, 1)), e.gt_eq("ts", dt.datetime(1969, 12, 31)), e.lt("n", 0), e.lt_eq("n", -1),
        e.gt("n", 5), e.eq("n", 15), e.eq("id", 7), e.is_in("id", [7, 8]), e.not_eq("k", "x"), ~e.eq("k", "x"),
        e.eq("k", "x") | e.eq("n", 5), e.eq("k", "nope"), e.FALSE
    ]
    every = t.to_df()
    for p in tests:
        want = sorted(r.id for r in every.where(p.filter()).collect())
        assert sorted(r.id for r in t.to_df(where=p).collect()) == want, p
    files = len(t.plan()[0].tasks)
    for p in (
        e.eq("k", "x"), e.is_null("k"), e.eq("d", dt.date(2019, 11, 3)), e.eq("n", 15), e.eq("id", 7),
        e.gt_eq("ts", dt.datetime(1969, 12, 31))
    ):
        assert len(t.plan(where=p)[0].tasks) < files
    assert t.plan(where=e.eq("k", "zzz"))[0].skipped_manifests == 2
    with pytest.raises(Exception, match="longer than 100 bytes"):
        Transaction(catalog, "db.p").append(spark.createDataFrame([(1, None, None, "y" * 101, 1)], schema))
    Transaction(catalog, "db.p").delete_equal(spark.createDataFrame([(7,)], "id bigint")).commit()
    o = Transaction(catalog, "db.p").overwrite(spark.createDataFrame(rows[:3], schema)).commit()
    assert o.to_df().count() == 3 and o.to_df(where=e.eq("k", "")).count() == 1


def test_instants_are_partitioned_in_utc(spark, catalog):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        schema = T.DataType.fromDDL("id int, ts timestamp")
        spec = {"spec-id": 1, "fields": [{"source-id": 2, "field-id": 1000, "name": "d", "transform": "day"}]}
        catalog.create_table("db.z", schema, spec=spec)
        rows = [(i, dt.datetime(2020, 1, 1, 22, tzinfo=dt.UTC) + dt.timedelta(hours=i)) for i in range(8)]
        t = Transaction(catalog, "db.z").append(spark.createDataFrame(rows, schema)).commit()
        assert {json.loads(r.partition)["d"] for r in t.files().collect()} == {18262, 18263}
        p = e.gt_eq("ts", dt.datetime(2020, 1, 2, tzinfo=dt.UTC))
        assert sorted(r.id for r in t.to_df(where=p).collect()) == [2, 3, 4, 5, 6, 7] and len(t.plan(where=p)[0].tasks) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_deletes_by_sequence_number():
    from quern.sources import planner

    entry = lambda n, content, path=None: {
        "sequence_number": n,
        "data_file": {"content": content, "file_path": f"d{n}{content}{path}", "referenced_data_file": path}
    }
    d = planner.Deletes([entry(5, 2), entry(3, 1), entry(7, 1, "a"), entry(9, 2), entry(4, 1)])
    names = lambda s, p: sorted(f["file_path"] for f in d.of(s, p))
    assert names(4, "a") == [
        "d41None", "d52None", "d71a", "d92None"
    ] and names(5, "b") == ["d92None"] and names(9, "a") == [] and names(8, "a") == ["d92None"]
    assert all(d.any_of(s, p) == bool(d.of(s, p)) for s in range(12) for p in "ab")


def test_many_manifests_are_read_by_tasks(spark, catalog):
    for k in range(5):
        Transaction(catalog, "db.m").append(spark.range(10 * k, 10 * k + 10), files=1).commit()
    t = catalog.load_table("db.m")
    rows = manifest.read_list(catalog.storage, md.resolve(t.metadata)["manifest-list"])
    keep = lambda x: x["sequence_number"] > 2
    near, far = (manifest.live_entries(spark, catalog.storage, rows, many=n, keep=keep, stats=False) for n in (64, 1))
    assert near[1] == far[1] == 2 and sorted(
        map(str, near[0])
    ) == sorted(map(str, far[0])) and len(far[0]) == 3 and "lower_bounds" not in far[0][0]["data_file"]


def test_overwrite_after_deletes(spark, catalog):
    tx = Transaction(catalog, "db.o")
    tx.append(spark.range(10), files=1).commit()
    tx.delete_equal(spark.createDataFrame([(3,)], "id bigint")).commit()
    t = tx.overwrite(spark.range(5).repartition(3)).commit()
    s = md.resolve(t.metadata)["summary"]
    assert (
        s["deleted-records"], s["total-records"], s["total-data-files"], s["total-delete-files"]
    ) == ("10", "5", str(len(t.plan()[0].tasks)), "0") and t.to_df().count() == 5
    assert {(r.content, r.deleted_files_count) for r in t.manifests().collect()} == {(0, 0), (0, 1), (1, 1)}


def test_streams_into_one_table_count_apart(spark, catalog):
    a, b = (streams.append_sink(catalog, "db.two", n) for n in ("a", "b"))
    rows = lambda k: spark.range(10 * k, 10 * k + 5)
    for n in range(3):
        a(rows(n), n)
    for n in range(2):
        b(rows(10 + n), n)
        b(rows(10 + n), n)
    assert catalog.load_table("db.two").to_df().count() == 25


def test_commits_of_several_tables_are_seen_whole(spark, catalog, monkeypatch):
    up = lambda v: [{"action": "set-properties", "updates": {"x": v}}]
    names = ("db.a", "db.b")
    for n in names:
        catalog.create_table(n, "id int")
    load = lambda: [catalog.load_table(n) for n in names]
    seen = []
    decide = catalog._decide
    monkeypatch.setattr(
        catalog, "_decide", lambda t,
        d: (seen.append([x.metadata["properties"].get("x") for x in load()]), decide(t, d))[1]
    )
    made = catalog.stage_table("db.c", "id int")
    catalog.commit_many([(x, up("1"), []) for x in load()] + [(made, [], [{"type": "assert-create"}])])
    assert seen == [[None, None]] and [
        x.metadata["properties"]["x"] for x in load()
    ] == ["1", "1"] and catalog.table_exists("db.c")
    # Another writer comes between: it decides against the commit that is still open, whose writer is told.
    other = Catalog(spark, catalog.warehouse)
    monkeypatch.setattr(
        catalog, "_decide", lambda t, d: (other.load_table("db.b").update(*up("other")), decide(t, d))[1]
    )
    with pytest.raises(md.CommitConflict):
        catalog.commit_many([(x, up("2"), []) for x in load()])
    monkeypatch.undo()
    assert [x.metadata["properties"]["x"] for x in load()] == ["1", "other"]
    fresh, (a, _) = catalog.stage_table("db.d", "id int"), load()
    with pytest.raises(md.CommitConflict):  # the name taken for a new table is given free
        catalog.commit_many([
            (fresh, [], [{"type": "assert-create"}]), (a, up("4"), [{"type": "assert-current-schema-id", "current-schema-id": 9}])
        ])
    assert not catalog.table_exists("db.d") and catalog.create_table("db.d", "id int")
    with pytest.raises(ValueError, match="twice"):
        catalog.commit_many([(a, up("5"), []), (a, up("6"), [])])
    catalog.commit_many([(x, up("3"), []) for x in load()])
    assert [x.metadata["properties"]["x"] for x in load()] == ["3", "3"]


def test_stores_without_exclusive_creation_are_refused(spark, monkeypatch):
    from quern.sources.storage import Storage

    class Fs:
        able = False

        def hasPathCapability(self, p, name):  # noqa: N802
            return self.able

    fs, s = Fs(), Storage(spark)
    monkeypatch.setattr(s, "_fs", lambda path: (path, fs))
    assert s.exclusive("hdfs://n/x") and not s.exclusive("s3a://b/x")
    with pytest.raises(NotImplementedError):
        s.create("s3a://b/x", b"")
    fs.able = True
    assert s.exclusive("s3a://b/x")
    assert Storage(spark, single_writer=True).exclusive("s3a://b/x")


def test_tokens_and_vended_credentials(spark, tmp_path):
    from quern.sources.service import RestCatalog, Service, serve

    service = Service(Catalog(spark, f"file://{tmp_path}/wh"), clients={"id": "pw"})
    server = serve(service)
    try:
        uri = f"http://127.0.0.1:{server.server_port}"
        with pytest.raises(RuntimeError, match="no valid token"):
            RestCatalog(spark, uri, f"file://{tmp_path}/wh")
        with pytest.raises(Exception, match="401"):
            RestCatalog(spark, uri, f"file://{tmp_path}/wh", {"credential": "id:wrong"})
        c = RestCatalog(spark, uri, f"file://{tmp_path}/wh", {"credential": "id:pw"})
        c.create_namespace("a")
        assert RestCatalog(spark, uri, f"file://{tmp_path}/wh", {"token": c.token()}).namespace_exists("a")
        c.apply_credentials(
            [
                {"prefix": "s3://bucket-q/x", "config": {"s3.access-key-id": "k2"}},
                {"prefix": "s3", "config": {"s3.access-key-id": "k1"}}
            ]
        )
        conf = spark._jsc.hadoopConfiguration()
        assert conf.get("fs.s3a.bucket.bucket-q.access.key") == "k2" and conf.get("fs.s3a.access.key") == "k1"
        conf.unset("fs.s3a.access.key")
    finally:
        server.shutdown()


# Records


class Color(enum.Enum):
    RED = 1
    BLUE = 2


class PointText:
    spark_type = T.StringType()

    def to_column(self, v):
        return f"{v[0]},{v[1]}"

    def from_column(self, v):
        return tuple(int(x) for x in v.split(","))


@dataclasses.dataclass
class Inner:
    id: int
    name: str | None = None


@dataclasses.dataclass
class Record:
    flag: bool
    when: dt.datetime
    day: dt.date
    clock: dt.time
    took: dt.timedelta
    price: decimal.Decimal = dataclasses.field(metadata=model.column(type="decimal(10,2)"))
    key: uuid.UUID = dataclasses.field(default_factory=uuid.uuid4)
    color: Color = Color.RED
    tags: list[str | None] = dataclasses.field(default_factory=list)
    ids: set[int] = dataclasses.field(default_factory=set)
    inner: Inner | None = None
    table: dict[str, list[Inner]] = dataclasses.field(default_factory=dict)
    data: bytes = b""
    local: dt.datetime = dataclasses.field(
        default=dt.datetime(2020, 1, 1), metadata=model.column(type=T.TimestampNTZType())
    )
    point: tuple = dataclasses.field(
        default=(0, 0), metadata=model.column(name="pt", order=0, converter=PointText(), metadata={"unit": "px"})
    )
    double: int = dataclasses.field(default=0, metadata=model.column(ignore=True))
    hooks: list[str] = dataclasses.field(default_factory=list, metadata=model.column(ignore=True))
    size: float | None = None

    def before_serialize(self):
        self.hooks.append("out")

    def after_deserialize(self):
        self.double = len(self.tags) * 2


def record(**more):
    return Record(
        True, dt.datetime(2021, 2, 3, 4, 5, 6, 7), dt.date(2020, 2, 29), dt.time(1, 2, 3, 4),
        dt.timedelta(days=-1, microseconds=5), decimal.Decimal("12.50"), tags=["a", None, ""], ids={1, 2},
        inner=Inner(7), table={"x": [Inner(1, "q")], "": []}, data=b"\x00\xff", point=(3, 4), **more
    )


def same(a, b):
    da, db = (dataclasses.asdict(x) for x in (a, b))
    return all(da[k] == db[k] for k in da if k not in ("double", "hooks"))


def test_records_round_trip(spark, catalog):
    recs = [record(), record(size=math.inf, color=Color.BLUE)]
    assert model.schema_of(Record).names[0] == "pt" and model.schema_of(Record)["pt"].metadata == {"unit": "px"}
    back = model.from_df(model.to_df(spark, recs), Record)
    assert all(same(a, b) for a, b in zip(recs, back, strict=True)) and back[0].double == 6 and recs[0].hooks == ["out"]
    again = model.from_bytes(Record, model.to_bytes(recs))
    assert all(same(a, b) for a, b in zip(recs, again, strict=True))
    out = io.BytesIO()
    model.to_stream(recs, out)
    assert len(model.from_stream(Record, io.BytesIO(out.getvalue()))) == 2
    with pytest.raises(qt.SchemaError):  # tables have no type for a span of time
        Transaction(catalog, "db.recs").append(model.to_df(spark, recs))
    plain = [Inner(1), Inner(2, "b"), Inner(0, "")]
    t = Transaction(catalog, "db.inner").append(model.to_df(spark, plain), files=1).commit()
    assert model.from_df(t.to_df(ordered=True), Inner) == plain
    assert '"attribute": "point"' in model.describe(Record)


def test_families(spark):
    @dataclasses.dataclass
    class Circle:
        radius: float

    @dataclasses.dataclass
    class Box:
        width: float
        inner: Inner | None = None

    f = model.Family({"circle": Circle, "box": Box}, tag_column="kind")
    things = [Circle(1.0), Box(2.0, Inner(3, "z")), Circle(4.0)]
    df = f.to_df(spark, things)
    assert f.from_df(df) == things and df.columns == ["kind", "radius", "width", "inner"]
    assert f.union(
        {"circle": model.to_df(spark, [Circle(5.0)]), "box": model.to_df(spark, [Box(1.0)], Box)}
    ).count() == 2
    with pytest.raises(qt.SchemaError):
        f.from_df(df.withColumn("kind", F.lit("line")))
    with pytest.raises(qt.SchemaError):
        f.to_df(spark, [Inner(1)])


def test_record_errors():
    @dataclasses.dataclass
    class Twice:
        a: int = dataclasses.field(metadata=model.column(name="x"))
        b: int = dataclasses.field(metadata=model.column(name="x"))

    @dataclasses.dataclass
    class NoDefault:
        a: int = dataclasses.field(metadata=model.column(ignore=True))

    @dataclasses.dataclass
    class Odd:
        a: complex

    for cls, code in ((Twice, "R004"), (NoDefault, "R002"), (Odd, "R003"), (int, "R001")):
        with pytest.raises(qt.SchemaError) as err:
            model.schema_of(cls)
        assert err.value.code == code


def test_class_from_schema(spark):
    df = spark.createDataFrame(
        [(1, "x", [1, 2], {"k": 2.5}, (3,))], "a int, b string, c array<int>, d map<string,double>, s struct<q: int>"
    )
    cls = model.make_class("Made", df.schema)
    rec = model.from_df(df, cls)[0]
    assert (rec.a, rec.c, rec.d, rec.s.q) == (1, [1, 2], {"k": 2.5}, 3)
    assert model.to_df(spark, [rec]).schema.simpleString() == df.schema.simpleString()


FIXTURE = """c_int int, deep struct<nested_list: array<string>, nested_map: map<string,bigint>>, list_of_list array<array<int>>, list_of_map array<map<string,int>>, map_of_list map<string,array<int>>,
map_of_map map<string,map<string,string>>, list_of_struct array<struct<id: int, name: string>>, deep_map_list_struct map<string,array<struct<id: int, name: string>>>, c_decimal decimal(21,2), c_ts timestamp_ntz, c_tstz timestamp, c_bin binary, c_date date"""


def test_nested_rows_round_trip_in_order(spark, catalog):
    rows = [
        (
            1, (["a", None], {"k": 1}), [[1], [], None], [{"x": 1}], {"l": [1, 2]}, {"m": {"n": "o"}},
            [(1, "a"), (2, None)], {"z": [(3, "c")]}, decimal.Decimal("1.25"), dt.datetime(2020, 1, 1, 1),
            dt.datetime(2020, 1, 1, 1), b"\x01", dt.date(2020, 1, 1)
        ),
        (None,) * 13, (3, ([], {}), [], [], {}, {}, [], {}, decimal.Decimal("-0.01"), None, None, b"", None)
    ]
    df = spark.createDataFrame(rows, FIXTURE)
    t = Transaction(catalog, "db.nested").append(df, files=1).commit()
    assert t.to_df(ordered=True).collect() == df.collect()


# Streams


def test_stream_into_a_table_and_back(spark, catalog, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(
        [(dt.datetime(2020, 1, 1, 0, m), "a", m) for m in range(60)], "ts timestamp, k string, v int"
    ).repartition(3).write.parquet(src)
    stream = streams.file_stream(spark, src, "ts timestamp, k string, v int", per_batch=1)
    q = stream.writeStream.foreachBatch(
        streams.append_sink(catalog, "db.live", "s")
    ).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    t = catalog.load_table("db.live")
    assert t.to_df().count() == 60 and len(t.metadata["snapshots"]) == 3
    streams.append_sink(catalog, "db.live", "s")(  # batch 2 again
        spark.createDataFrame([(None, "x", 1)], "ts timestamp, k string, v int"), 2
    )
    assert catalog.load_table("db.live").to_df().count() == 60
    first = t.metadata["snapshots"][0]["snapshot-id"]
    rows, end = streams.changed_since(catalog, "db.live", first)
    assert 0 < rows.count() < 60 and end == t.metadata["current-snapshot-id"]
    w = streams.windowed(
        t.to_df(), "ts", "1 hour", "10 minutes", ["k"], F.count("*").alias("n"), F.sum("v").alias("total")
    ).collect()
    assert sorted(r.n for r in w) == [10] * 6
    s = streams.sessions(
        t.to_df().where("v < 20 or v > 40"), "ts", "1 hour", "5 minutes", ["k"], F.count("*").alias("n")
    ).collect()
    assert sorted(r.n for r in s) == [19, 20]


# Other files, metadata files, and the catalog protocol


def test_other_formats(spark, tmp_path):
    from quern.sources import files

    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "i int, s string, a array<int>")
    for kind in ("parquet", "orc", "json"):
        files.write_files(df, f"{tmp_path}/{kind}", kind)
        assert sorted(r.i for r in files.read_files(spark, f"{tmp_path}/{kind}", kind, df.schema).collect()) == [1, 2]
    schema = {
        "type": "record", "name": "r",
        "fields": [
            {"name": "i", "type": "int"}, {"name": "s", "type": ["null", "string"]},
            {"name": "a", "type": {"type": "array", "items": "int"}}
        ]
    }
    (tmp_path / "avro").mkdir()
    for k in range(3):
        (tmp_path / "avro" / f"{k}.avro").write_bytes(
            avrofile.encode(schema, [{"i": 10 * k + j, "s": None if j else "x", "a": [j]} for j in range(4)])
        )
    got = files.read_files(spark, f"file://{tmp_path}/avro", "avro")
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(r.i for r in got.collect()) == sorted(
        10 * k + j for k in range(3) for j in range(4)
    )
    with pytest.raises(ValueError):
        files.read_files(spark, "x", "blob")


def test_database_on_a_cluster(spark, tmp_path):
    """Executors that are JVMs of their own read the table that the driver made."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    names = [
        None, "", " a ", 'q"uo"te, comma\nline\r\nend', '"', '",', '""', "\\n", "NULL", "\n", "\x00z", "äöü€😀", "x" * 40_000
    ]
    rows = [(k, n, None if k == 1 else k - 5) for k, n in enumerate(names)] + [(None, None, None), (3_000, "far", 1)]
    kinds = "n_nationkey int, n_name string, n_regionkey int"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/sf/nation.parquet")
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = """if True:
        import sys
        from pyspark.sql import SparkSession
        import __spark_entry__
        at = sys.argv[1]
        spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map={
            "spark.checkpoint.dir": f"file://{at}/shared", "spark.ui.enabled": "false", "spark.executor.memory": "600m"
        }).getOrCreate()
        __spark_entry__.queries()["files_database"](spark, f"{at}/sf").write.parquet(f"{at}/out")
        spark.stop()
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = {
        "PYTHONPATH": root, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1",
        "PYSPARK_PYTHON": sys.executable
    }
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | own
    ran = subprocess.run(
        [sys.executable, "-c", code, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert ran.returncode == 0, "\n".join(x for x in ran.stderr.splitlines() if "Caused by" in x or "Error: " in x)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.schema.simpleString() == f"struct<{kinds}>".replace(", ", ",").replace(" ", ":")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_metadata_files(catalog):
    t = catalog.create_table("db.m", "id int")
    path = md.write_file(catalog.storage, t.metadata, 7)
    assert md.read_file(catalog.storage, path) == t.metadata and md.parse_file_name(path)[0] == 7
    with pytest.raises(ValueError):
        md.parse_file_name("v1.metadata.json")


def test_catalog_protocol(spark, tmp_path):
    from quern.sources.service import RestCatalog, Service, serve

    service = Service(Catalog(spark, f"file://{tmp_path}/wh", {"s3.endpoint": "http://localhost:1"}), tasks_per_plan=2)
    server = serve(service)
    try:
        c = RestCatalog(spark, f"http://127.0.0.1:{server.server_port}", f"file://{tmp_path}/wh")
        c.create_namespace("a")
        c.create_namespace("a", if_not_exists=True)
        for k in range(13):
            c.create_namespace(f"a.n{k:02d}")
        assert len(c.list_namespaces("a")) == 13 and c.namespace_exists("a.n03") and not c.namespace_exists("b")
        assert c.update_namespace_properties(
            "a", {"x": "1"}
        )["updated"] == ["x"] and c.namespace_properties("a") == {"x": "1"}
        with pytest.raises(AlreadyExists):
            c.create_namespace("a")
        with pytest.raises(NoSuchTable):
            c.load_table("a.none")
        tx = Transaction(c, "a.t")
        for k in range(5):
            tx.append(spark.range(10 * k, 10 * k + 10), files=1).commit()
        t = c.load_table("a.t")
        assert t.to_df().count() == 50 and [i.name for i in c.list_tables("a")] == ["t"] and len(
            c.load_table("a.t", snapshots="refs").metadata["snapshots"]
        ) == 1
        p = c.plan_scan("a.t", filter=e.gt_eq("id", 10).to_json(), stats_fields=["id"])
        assert p["status"] == "completed" and len(
            p["file-scan-tasks"]
        ) == 2 and len(p["plan-tasks"]) == 1 and p["file-scan-tasks"][0]["data-file"]["value-counts"]["values"] == [10]
        assert len(
            c.fetch_tasks("a.t", p["plan-tasks"][0])["file-scan-tasks"]
        ) == 2 and c.fetch_plan("a.t", p["plan-id"])["status"] == "completed"
        c.cancel_plan("a.t", p["plan-id"])
        assert c.fetch_plan("a.t", p["plan-id"])["status"] == "cancelled"
        s = [x["snapshot-id"] for x in t.metadata["snapshots"]]
        assert len(
            c.plan_scan("a.t", start_snapshot_id=s[1], end_snapshot_id=s[2])["file-scan-tasks"]
        ) == 1 and len(c.plan_scan("a.t", min_rows_requested=5)["file-scan-tasks"]) == 1
        c.report("a.t", {"report-type": "scan-report"})
        assert service.reports[0]["table"] == "a.t" and c.credentials("a.t")[0]["config"] == {
            "s3.endpoint": "http://localhost:1"
        }
        with pytest.raises(md.CommitConflict):
            c.commit(t, [], [{"type": "assert-current-schema-id", "current-schema-id": 99}])
        c.rename_table("a.t", "a.u")
        c.register_table("a.again", t.location)
        c.commit_many([(c.load_table("a.u"), [{"action": "set-properties", "updates": {"k": "v"}}], [])])
        assert c.load_table("a.again").metadata["properties"]["k"] == "v"
        c.create_view("a.v", "SELECT 1 AS one")
        c.create_view("a.v", "SELECT 2 AS two", replace=True)
        c.rename_view("a.v", "a.w")
        assert c.view("a.w").first().two == 2 and c.view_exists("a.w") and [i.name for i in c.list_views("a")] == ["w"]
        c.drop_view("a.w")
        c.drop_namespace("a", recursive=True)
        assert c.list_namespaces() == []
    finally:
        server.shutdown()


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(
        subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    ) > 100
