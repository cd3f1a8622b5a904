"""Queries over what lies round the query surface: tables, partitions, the catalog and its protocol, records, files.
Each with the SQL that gives the same rows."""

from __future__ import annotations

import csv
import dataclasses
import decimal
import io
import json
import os
import tempfile
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalogue import Tables, query
from quern.functions import values
from quern.plans import expr as e
from quern.session import fresh_dir
from quern.sources import avrofile, files, manifest, model
from quern.sources import metadata as md
from quern.sources.catalog import Catalog, NoSuchTable, s3a_settings
from quern.sources.service import RestCatalog, Service, serve
from quern.sources.storage import AlreadyExists, Storage
from quern.sources.transaction import Transaction
from quern.sources.types import SchemaError
from quern.streaming import tables as streams

c = F.col
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _catalog(t: Tables, **conf: str) -> Catalog:
    catalog = Catalog(t.spark, fresh_dir(t.spark, "warehouse"), conf)
    catalog.create_namespace("q")
    return catalog


def _nation(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name", "n_regionkey").df


def _made(t: Tables, *rows: tuple, schema: str) -> DataFrame:
    return t.spark.createDataFrame(list(rows), schema)


# Tables


@query("table_batches", NATION)
def _batches(t: Tables) -> DataFrame:
    """A table read as Arrow batches by the driver."""
    import pyarrow as pa

    table = Transaction(_catalog(t), "q.nation").append(_nation(t)).commit()
    return t.spark.createDataFrame(pa.Table.from_batches(list(table.batches(rows=7))))


@query("table_c_stream", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _c_stream(t: Tables) -> DataFrame:
    """A table handed to another library through Arrow's C stream."""
    import pyarrow as pa

    table = Transaction(_catalog(t), "q.nation").append(_nation(t)).commit()
    return t.spark.createDataFrame(
        pa.table(model.CStream(table.to_df()))
    ).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query(
    "table_query",
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY 1"
)
def _table_query(t: Tables) -> DataFrame:
    table = Transaction(_catalog(t), "q.orders").append(
        t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").df
    ).commit()
    q = table.query(where=e.gt("o_totalprice", 1000.0)).where(~e.eq("o_orderstatus", "P"))
    return q.group_by("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    ).to_df()


@query("table_dispose", NATION)
def _dispose(t: Tables) -> DataFrame:
    """A transaction that commits on leaving; one that an error leaves commits nothing."""
    catalog = _catalog(t)
    with Transaction(catalog, "q.nation") as tx:
        tx.append(_nation(t))
    try:
        with Transaction(catalog, "q.nation") as tx:
            tx.append(_nation(t))
            raise RuntimeError
    except RuntimeError:
        pass
    return catalog.load_table("q.nation").to_df()


@query(
    "table_partition_pruning",
    "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-09-01' AND o_orderstatus = 'F'"
)
def _pruned(t: Tables) -> DataFrame:
    """A table partitioned by month and status, appended by years: a scan reads the manifests and files of the months
    asked for only."""
    catalog = _catalog(t)
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus").df
    spec = {
        "spec-id": 1,
        "fields": [
            {"source-id": 2, "field-id": 1000, "name": "o_orderdate_month", "transform": "month"},
            {"source-id": 3, "field-id": 1001, "name": "o_orderstatus", "transform": "identity"}
        ]
    }
    catalog.create_table("q.orders", rows.schema, spec=spec)
    half = F.lit("1997-01-01").cast("timestamp_ntz")
    for part in (c("o_orderdate") < half, c("o_orderdate") >= half, c("o_orderdate").isNull()):
        tx = Transaction(catalog, "q.orders").append(rows.where(part))
        tx.commit()
    table = catalog.load_table("q.orders")
    where = e.gt_eq(
        "o_orderdate", "1997-06-01T00:00:00"
    ) & e.lt("o_orderdate", "1997-09-01T00:00:00") & e.eq("o_orderstatus", "F")
    plan, _ = table.plan(where=where)
    if plan.skipped_manifests < 1 or len(plan.tasks) > 12:
        raise AssertionError(f"{plan.skipped_manifests} manifests passed over, {len(plan.tasks)} files left")
    return table.to_df(where=where)


@query(
    "table_partitions",
    "SELECT CAST(year(o_orderdate) - 1970 AS INTEGER) AS y, o_orderpriority AS p, CAST(count(*) AS BIGINT) AS records FROM orders GROUP BY 1, 2"
)
def _partitions(t: Tables) -> DataFrame:
    """What the metadata says of each partition: its values and records."""
    catalog = _catalog(t)
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority").df
    spec = {
        "spec-id": 1,
        "fields": [
            {"source-id": 2, "field-id": 1000, "name": "y", "transform": "year"},
            {"source-id": 3, "field-id": 1001, "name": "p", "transform": "identity"}
        ]
    }
    catalog.create_table("q.orders", rows.schema, spec=spec)
    f = Transaction(catalog, "q.orders").append(rows).commit().files()
    return f.select(
        F.from_json("partition", "y int, p string").alias("x"), "record_count"
    ).groupBy("x.y", "x.p").agg(F.sum("record_count").alias("records"))


@query("table_bucket_pruning", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 77)")
def _bucketed(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    rows = t.orders.select("o_orderkey", "o_custkey").df
    catalog.create_table(
        "q.orders", rows.schema,
        spec={"spec-id": 1, "fields": [{"source-id": 2, "field-id": 1000, "name": "b", "transform": "bucket[16]"}]}
    )
    table = Transaction(catalog, "q.orders").append(rows).commit()
    where = e.is_in("o_custkey", [7, 77])
    if len({json.dumps(x.file["partition"]) for x in table.plan(where=where)[0].tasks}) > 2:
        raise AssertionError("more than the buckets asked for")
    return table.to_df(where=where)


@query("table_sort_order", "SELECT count(*) AS files_out_of_order FROM (SELECT 1 WHERE false)")
def _sorted(t: Tables) -> DataFrame:
    """Files of a table with a sort order in which a row comes before one it should come after."""
    from pyspark.sql import Window

    catalog = _catalog(t)
    rows = t.orders.select("o_orderkey", "o_totalprice").df
    order = {
        "order-id": 1,
        "fields": [{"source-id": 2, "transform": "identity", "direction": "desc", "null-order": "nulls-last"}]
    }
    catalog.create_table("q.orders", rows.schema, sort_order=order)
    table = Transaction(catalog, "q.orders").append(rows.repartition(8)).commit()
    read = t.spark.read.parquet(*(x.file["file_path"] for x in table.plan()[0].tasks)).select(
        "o_totalprice", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")
    )
    before = F.lag("o_totalprice").over(Window.partitionBy("f").orderBy("i"))  # a file is bounded
    return read.withColumn("b", before).where("b < o_totalprice").agg(F.count_distinct("f").alias("files_out_of_order"))


@query("table_delete_positions", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0")
def _positions(t: Tables) -> DataFrame:
    """Position deletes made from the files' own positions."""
    tx = Transaction(_catalog(t), "q.orders")
    table = tx.append(t.orders.select("o_orderkey").df).commit()
    read = t.spark.read.parquet(*(x.file["file_path"] for x in table.plan()[0].tasks))
    gone = read.where("o_orderkey % 10 = 0").select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos")
    )
    return tx.delete_positions(gone).commit().to_df()


@query(
    "table_overwrite_after_deletes",
    "SELECT 0 AS deletes, count(*) AS records, 0 AS left_over FROM customer WHERE c_acctbal > 0"
)
def _overwritten(t: Tables) -> DataFrame:
    """The totals of a snapshot that replaces files and delete files."""
    tx, rows = Transaction(_catalog(t), "q.customer"), t.customer.select("c_custkey", "c_acctbal")
    tx.append(rows.df).commit()
    tx.delete_equal(rows.select("c_custkey").where("c_custkey < 10").df).commit()
    table = tx.overwrite(rows.where(e.gt("c_acctbal", 0.0)).df).commit()
    s = md.resolve(table.metadata)["summary"]
    left = table.to_df().count() - int(s["total-records"])
    return _made(
        t, (int(s["total-delete-files"]), int(s["total-records"]), left),
        schema="deletes int, records bigint, left_over int"
    )


@query("table_import", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _imported(t: Tables) -> DataFrame:
    """Foreign files without field ids, by a name mapping."""
    at = fresh_dir(t.spark, "foreign")
    _nation(t).select(c("n_nationkey").alias("nr"), c("n_name").alias("label")).write.parquet(at)
    catalog = _catalog(t)
    catalog.create_table("q.nation", "id int, name string")
    mapping = [{"field-id": 1, "names": ["id", "nr"]}, {"field-id": 2, "names": ["name", "label"]}]
    return Transaction(catalog, "q.nation").import_files([at], mapping).commit().to_df()


@query(
    "table_branches",
    "SELECT 'dev' AS ref, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'main', count(*) FROM nation UNION ALL SELECT 'v1', count(*) FROM nation"
)
def _branches(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    Transaction(catalog, "q.n").append(_nation(t)).commit().tag("v1")
    Transaction(catalog, "q.n", branch="dev").append(_nation(t).where("n_regionkey = 1")).commit()
    now = catalog.load_table("q.n")
    return _made(t, *((r, now.to_df(ref=r).count()) for r in ("main", "v1", "dev")), schema="ref string, n bigint")


@query(
    "table_stream_sink",
    "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'click'"
)
def _sink(t: Tables) -> DataFrame:
    """Two streams into one table, each of whose batches counts once though both are run twice."""
    catalog, rows = _catalog(t), t.events.select("event_id", "event_type").df
    for name, own in (("all", rows), ("clicks", rows.where("event_type = 'click'"))):
        sink = streams.append_sink(catalog, "q.events", name)
        for batch in (0, 1):
            for _ in range(2):
                sink(own.where(F.pmod("event_id", F.lit(2)) == batch), batch)
    return catalog.load_table("q.events").to_df()


# The catalog


@query("catalog_namespaces", "SELECT * FROM (VALUES ('a'), ('a.x'), ('a.y'), ('q')) v(namespace)")
def _namespaces(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    for n in ("a", "a.x", "a.y", "gone", "gone.inner"):
        catalog.create_namespace(n)
    catalog.create_namespace("a", if_not_exists=True)
    catalog.drop_namespace("gone", recursive=True, purge=True)
    return catalog.namespaces().unionByName(catalog.namespaces("a"))


@query("catalog_tables", "SELECT 'q' AS namespace, 'nation' || r_regionkey AS \"table\" FROM region")
def _tables(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    for k in range(t.region.count()):
        catalog.create_table(f"q.nation{k}", _nation(t).schema)
    catalog.create_table("q.gone", "id int")
    catalog.drop_table("q.gone", purge=True)
    return catalog.tables("q")


@query("catalog_tree", "SELECT '{\"a\": {\"b\": {\"t\": null}}, \"q\": {}}' AS tree, true AS printed")
def _tree(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    for n in ("a", "a.b"):
        catalog.create_namespace(n)
    catalog.create_table("a.b.t", "id int")
    return _made(
        t, (json.dumps(catalog.tree(), sort_keys=True), "b/" in catalog.print_tree()),
        schema="tree string, printed boolean"
    )


@query("catalog_properties", "SELECT * FROM (VALUES ('kept', '1'), ('new', '2')) v(k, value)")
def _properties(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    catalog.create_namespace("p", {"kept": "1", "old": "0"})
    catalog.update_namespace_properties("p", {"new": "2"}, ["old", "never"])
    return _made(t, *catalog.namespace_properties("p").items(), schema="k string, value string")


@query(
    "catalog_exists",
    "SELECT * FROM (VALUES ('namespace', true), ('namespace gone', false), ('table', true), ('table gone', false), ('table renamed', true), ('table registered', true)) v(what, there)"
)
def _exists(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    at = catalog.create_table("q.old", "id int").location
    catalog.create_table("q.t", "id int")
    catalog.rename_table("q.old", "q.new")
    catalog.register_table("q.again", at)
    found = {
        "namespace": catalog.namespace_exists("q"), "namespace gone": catalog.namespace_exists("never"),
        "table": catalog.table_exists("q.t"), "table gone": catalog.table_exists("q.old"),
        "table renamed": catalog.table_exists("q.new"), "table registered": catalog.table_exists("q.again")
    }
    return _made(t, *found.items(), schema="what string, there boolean")


@query("catalog_config", "SELECT 'override' AS a, 'conf' AS b, 'default' AS c")
def _config(t: Tables) -> DataFrame:
    """Settings: what overrides wins over what is configured, which wins over defaults."""
    conf = Catalog(
        t.spark, fresh_dir(t.spark, "warehouse"), {"a": "conf", "b": "conf"},
        {"a": "default", "b": "default", "c": "default"}, {"a": "override"}
    ).conf
    return _made(t, (conf["a"], conf["b"], conf["c"]), schema="a string, b string, c string")


@query(
    "catalog_requirements",
    "SELECT * FROM (VALUES ('assert-create'), ('assert-current-schema-id'), ('assert-default-sort-order-id'), ('assert-default-spec-id'), ('assert-last-assigned-field-id'), "
    "('assert-last-assigned-partition-id'), ('assert-ref-snapshot-id'), ('assert-table-uuid')) v(refused)"
)
def _requirements(t: Tables) -> DataFrame:
    """Each requirement of a commit holds where it should and refuses where it doesn't."""
    table = Transaction(_catalog(t), "q.n").append(_nation(t)).commit()
    m = table.metadata
    right = {
        "assert-table-uuid": ("uuid", m["table-uuid"]),
        "assert-current-schema-id": ("current-schema-id", m["current-schema-id"]),
        "assert-last-assigned-field-id": ("last-assigned-field-id", m["last-column-id"]),
        "assert-last-assigned-partition-id": ("last-assigned-partition-id", m["last-partition-id"]),
        "assert-default-spec-id": ("default-spec-id", m["default-spec-id"]),
        "assert-default-sort-order-id": ("default-sort-order-id", m["default-sort-order-id"]),
        "assert-ref-snapshot-id": ("snapshot-id", m["current-snapshot-id"])
    }
    refused = []
    for kind, (key, value) in right.items():
        own = {"type": kind, "ref": "main"}
        md.check(m, [own | {key: value}])
        try:
            md.check(m, [own | {key: "no" if isinstance(value, str) else -77}])
        except md.CommitConflict:
            refused.append(kind)
    md.check(None, [{"type": "assert-create"}])
    try:
        md.check(m, [{"type": "assert-create"}])
    except md.CommitConflict:
        refused.append("assert-create")
    return _made(t, *((k,) for k in refused), schema="refused string")


@query(
    "catalog_updates",
    "SELECT 2 AS columns, 'v' AS property, 'now' AS location, 3 AS format_version, 1 AS refs, 0 AS statistics"
)
def _updates(t: Tables) -> DataFrame:
    """Updates of the protocol, one after another, on a table's metadata."""
    m = Transaction(_catalog(t), "q.n").append(_nation(t).select("n_nationkey", "n_name")).commit().metadata
    snap = m["current-snapshot-id"]
    m = md.apply(
        m,
        [
            {"action": "set-properties", "updates": {"k": "v", "x": "y"}},
            {"action": "remove-properties", "removals": ["x"]}, {"action": "set-location", "location": "now"},
            {"action": "upgrade-format-version", "format-version": 3},
            {"action": "set-snapshot-ref", "ref-name": "tmp", "type": "tag", "snapshot-id": snap},
            {"action": "remove-snapshot-ref", "ref-name": "tmp"},
            {"action": "set-statistics", "snapshot-id": snap, "statistics": {"snapshot-id": snap}},
            {"action": "remove-statistics", "snapshot-id": snap}
        ]
    )
    return _made(
        t,
        (
            len(m["schemas"][-1]["fields"]), m["properties"]["k"], m["location"], m["format-version"], len(m["refs"]),
            len(m["statistics"])
        ),
        schema="columns int, property string, location string, format_version int, refs int, statistics int"
    )


@query("catalog_views", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _views(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    Transaction(catalog, "q.nation").append(_nation(t)).commit()
    catalog.register_views("q", "v_")
    catalog.create_view("q.old", "SELECT n_regionkey, count(*) AS n FROM v_nation GROUP BY n_regionkey")
    catalog.rename_view("q.old", "q.regions")
    return catalog.view("q.regions")


@query(
    "catalog_view_versions",
    "SELECT * FROM (VALUES (1, 'spark', 'SELECT 1 AS x'), (2, 'spark', 'SELECT 2 AS x')) v(version, dialect, sql)"
)
def _view_versions(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    for k in (1, 2):
        catalog.create_view("q.v", f"SELECT {k} AS x", replace=True)
    v = catalog.load_view("q.v")
    return _made(
        t, *((x["version-id"], r["dialect"], r["sql"]) for x in v["versions"] for r in x["representations"]),
        schema="version int, dialect string, sql string"
    )


@query("catalog_commit_many", "SELECT * FROM (VALUES ('a', 'both'), ('b', 'both')) v(\"table\", property)")
def _many(t: Tables) -> DataFrame:
    """One commit to two tables; another of which one part is refused leaves both as they were."""
    catalog = _catalog(t)
    for n in ("a", "b"):
        catalog.create_table(f"q.{n}", "id int")
    load = lambda: [catalog.load_table(f"q.{n}") for n in ("a", "b")]
    up = lambda v: [{"action": "set-properties", "updates": {"p": v}}]
    catalog.commit_many([(x, up("both"), []) for x in load()])
    a, b = load()
    try:
        catalog.commit_many(
            [(a, up("half"), []), (b, up("half"), [{"type": "assert-current-schema-id", "current-schema-id": 99}])]
        )
    except md.CommitConflict:
        pass
    return _made(
        t, *((x.identifier.name, x.metadata["properties"]["p"]) for x in load()), schema="table string, property string"
    )


@query("catalog_protocol", "SELECT n_nationkey, n_name, n_regionkey, 26 AS rows_reported FROM nation")
def _protocol(t: Tables) -> DataFrame:
    """A table made, read and reported on through the protocol's client, with a token."""
    at = fresh_dir(t.spark, "warehouse")
    service = Service(Catalog(t.spark, at), clients={"me": "secret"})
    server = serve(service)
    try:
        client = RestCatalog(t.spark, f"http://127.0.0.1:{server.server_port}", at, {"credential": "me:secret"})
        client.create_namespace("q")
        table = Transaction(client, "q.nation").append(_nation(t)).commit()
        client.report("q.nation", {"report-type": "scan-report", "rows": 26})
        return client.load_table("q.nation").to_df().withColumn(
            "rows_reported", F.lit(service.reports[0]["rows"])
        ) if table else table
    finally:
        server.shutdown()


@query("catalog_scan_plan", "SELECT count(*) AS records FROM orders")
def _scan_plan(t: Tables) -> DataFrame:
    """A scan planned by the service: the files of all parts of the plan hold the table's records."""
    catalog = _catalog(t)
    Transaction(catalog, "q.orders").append(t.orders.select("o_orderkey", "o_custkey").df.repartition(5)).commit()
    service, at = Service(catalog, tasks_per_plan=2), "/v1/namespaces/q/tables/orders"
    plan = service.handle("POST", f"{at}/plan", body={"stats-fields": ["o_orderkey"]})[1]
    tasks = list(plan["file-scan-tasks"])
    for more in plan["plan-tasks"]:
        tasks += service.handle("POST", f"{at}/tasks", body={"plan-task": more})[1]["file-scan-tasks"]
    return _made(t, (sum(x["data-file"]["record-count"] for x in tasks),), schema="records bigint")


@query(
    "catalog_credentials",
    "SELECT * FROM (VALUES ('fs.s3a.bucket.b.access.key', 'k'), ('fs.s3a.bucket.b.aws.credentials.provider', 'org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider'), "
    "('fs.s3a.bucket.b.endpoint', 'http://localhost:1'), ('fs.s3a.bucket.b.secret.key', 's'), ('fs.s3a.bucket.b.session.token', 't')) v(setting, value)"
)
def _credentials(t: Tables) -> DataFrame:
    """What vended credentials for one bucket become in the S3 file system's settings."""
    vended = {
        "s3.access-key-id": "k", "s3.secret-access-key": "s", "s3.session-token": "t",
        "s3.endpoint": "http://localhost:1", "other": "x"
    }
    return _made(t, *s3a_settings(vended, "s3://b/warehouse/t").items(), schema="setting string, value string")


@query("catalog_conflicts", "SELECT 5 AS snapshots, 5 * count(*) AS n, true AS created_once FROM nation")
def _conflicts(t: Tables) -> DataFrame:
    """Commits from one stale state are tried again on what is there by then; a table is created once."""
    catalog = _catalog(t)
    waiting = [Transaction(catalog, "q.n").append(_nation(t)) for _ in range(5)]
    for tx in waiting:
        tx.commit()
    table = catalog.load_table("q.n")
    try:
        catalog.create_table("q.n", "id int")
        once = False
    except AlreadyExists:
        once = True
    return _made(
        t, (len(table.metadata["snapshots"]), table.to_df().count(), once),
        schema="snapshots int, n bigint, created_once boolean"
    )


@query("catalog_metadata_file", "SELECT true AS same, 7 AS number, true AS missing")
def _metadata_file(t: Tables) -> DataFrame:
    catalog = _catalog(t)
    table = catalog.create_table("q.n", _nation(t).schema)
    path = md.write_file(catalog.storage, table.metadata, 7)
    try:
        catalog.load_table("q.never")
        missing = False
    except NoSuchTable:
        missing = True
    return _made(
        t, (md.read_file(catalog.storage, path) == table.metadata, md.parse_file_name(path)[0], missing),
        schema="same boolean, number int, missing boolean"
    )


# Records


@dataclasses.dataclass
class Nation:
    n_nationkey: int = dataclasses.field(metadata=model.column(type="int"))
    n_name: str | None
    n_regionkey: int = dataclasses.field(metadata=model.column(type="int"))


class Upper:
    """Text kept in upper case."""

    spark_type = T.StringType()

    def to_column(self, value: str) -> str:
        return value.upper()

    def from_column(self, value: str) -> str:
        return value.lower()


@dataclasses.dataclass
class Place:
    name: str = dataclasses.field(
        metadata=model.column(name="label", order=0, converter=Upper(), metadata={"unit": "none"})
    )
    number: decimal.Decimal = dataclasses.field(metadata=model.column(type="decimal(9,2)"))
    note: str = dataclasses.field(default="", metadata=model.column(ignore=True))
    calls: int = dataclasses.field(default=0, metadata=model.column(ignore=True))

    def before_serialize(self) -> None:
        self.calls += 1

    def after_deserialize(self) -> None:
        self.note = f"{self.name}/{self.number}"


def _nations(t: Tables) -> list[Nation]:
    return model.from_df(_nation(t), Nation)


@query("records_append", NATION)
def _records(t: Tables) -> DataFrame:
    return Transaction(_catalog(t), "q.nation").append(model.to_df(t.spark, _nations(t))).commit().to_df()


@query("records_generated_class", NATION)
def _generated(t: Tables) -> DataFrame:
    """Records of a class made from a schema."""
    made = model.make_class("Made", _nation(t).schema)
    return Transaction(_catalog(t), "q.nation").append(
        model.to_df(t.spark, model.from_df(_nation(t), made))
    ).commit().to_df()


@query("records_ipc", NATION)
def _ipc(t: Tables) -> DataFrame:
    return model.to_df(t.spark, model.from_bytes(Nation, model.to_bytes(_nations(t))))


@query(
    "records_stream",
    "SELECT n_nationkey, n_name, n_regionkey, CAST(ceil((SELECT count(*) FROM nation) / 4.0) AS INTEGER) AS batches FROM nation"
)
def _stream(t: Tables) -> DataFrame:
    """Records as an Arrow stream in batches of four."""
    import pyarrow as pa

    out = io.BytesIO()
    model.to_stream(_nations(t), out, batch=4)
    n = sum(1 for _ in pa.ipc.open_stream(io.BytesIO(out.getvalue())))
    return model.to_df(t.spark, model.from_stream(Nation, io.BytesIO(out.getvalue()))).withColumn("batches", F.lit(n))


@query(
    "records_family",
    "SELECT CASE WHEN n_regionkey < 2 THEN 'near' ELSE 'far' END AS kind, CASE WHEN n_regionkey < 2 THEN n_nationkey END AS id, CASE WHEN n_regionkey >= 2 THEN n_name END AS name FROM nation"
)
def _family(t: Tables) -> DataFrame:
    near = dataclasses.make_dataclass("Near", [("id", int)])
    far = dataclasses.make_dataclass("Far", [("name", str | None)])
    f = model.Family({"near": near, "far": far}, tag_column="kind")
    things = [near(n.n_nationkey) if n.n_regionkey < 2 else far(n.n_name) for n in _nations(t)]
    df = f.to_df(t.spark, f.from_df(f.to_df(t.spark, things)))
    return df.withColumn("id", c("id").cast("int"))


@query("records_converted", "SELECT upper(n_name) AS label, CAST(n_nationkey AS DECIMAL(9, 2)) AS number FROM nation")
def _converted(t: Tables) -> DataFrame:
    """A renamed column of its own type through a converter, an overridden type, a column left out; hooks before and
    after."""
    places = [Place(n.n_name, decimal.Decimal(n.n_nationkey)) for n in _nations(t)]
    df = model.to_df(t.spark, places)
    back = model.from_df(df, Place)
    if any(p.calls != 1 for p in places) or any(
        b.note != f"{b.name}/{b.number}" for b in back
    ) or df.columns != ["label", "number"]:
        raise AssertionError("hooks, names or order")
    return model.to_df(t.spark, back)


@query(
    "records_described",
    "SELECT * FROM (VALUES ('label', 'name', 'string'), ('number', 'number', 'decimal(9,2)')) v(name, attribute, type)"
)
def _described(t: Tables) -> DataFrame:
    d = json.loads(model.describe(Place))
    return _made(
        t, *((f["name"], f["attribute"], f["type"]) for f in d["fields"]),
        schema="name string, attribute string, type string"
    )


@query("records_refused", "SELECT * FROM (VALUES ('R001'), ('R002'), ('R003'), ('R004')) v(code)")
def _refused(t: Tables) -> DataFrame:
    field = lambda **more: dataclasses.field(metadata=model.column(**more))
    bad = [
        int, dataclasses.make_dataclass("NoDefault", [("a", int, field(ignore=True))]),
        dataclasses.make_dataclass("Odd", [("a", complex)]),
        dataclasses.make_dataclass("Twice", [("a", int, field(name="x")), ("b", int, field(name="x"))])
    ]
    codes = []
    for cls in bad:
        try:
            model.schema_of(cls)
        except SchemaError as err:
            codes.append((err.code,))
    return _made(t, *codes, schema="code string")


@query("records_local", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(i, s)")
def _local(t: Tables) -> DataFrame:
    return files.local_rows(t.spark, [(1, "a"), (2, None)], "i int, s string")


# Files


@query("files_avro", NATION)
def _avro(t: Tables) -> DataFrame:
    """Avro container files, written by this package's codec and read by tasks."""
    at, storage = fresh_dir(t.spark, "avro"), _catalog(t).storage
    schema = {
        "type": "record", "name": "nation",
        "fields": [
            {"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": ["null", "string"]},
            {"name": "n_regionkey", "type": "int"}
        ]
    }
    rows = [r.asDict() for r in _nation(t).collect()]
    for k in range(3):
        storage.create(f"{at}/{k}.avro", avrofile.encode(schema, rows[k::3]))
    return files.read_files(t.spark, at, "avro")


@query("files_orc", "SELECT o_orderkey, o_totalprice FROM orders")
def _orc(t: Tables) -> DataFrame:
    at, rows = fresh_dir(t.spark, "orc"), t.orders.select("o_orderkey", "o_totalprice").df
    files.write_files(rows, at, "orc")
    return files.read_files(t.spark, at, "orc", rows.schema)


@query("files_manifest", "SELECT * FROM (VALUES ('manifest-list', 2), ('manifest', 1)) v(file, rows)")
def _manifest(t: Tables) -> DataFrame:
    """Manifest lists and manifests as written: a commit adds one manifest to the list, with one entry for its file."""
    catalog = _catalog(t)
    for _ in range(2):
        table = Transaction(catalog, "q.n").append(_nation(t), files=1).commit()
    listed = manifest.read_list(catalog.storage, md.resolve(table.metadata)["manifest-list"])
    entries = list(manifest.read_manifest(catalog.storage.read(listed[0]["manifest_path"]), listed[0]))
    return _made(t, ("manifest-list", len(listed)), ("manifest", len(entries)), schema="file string, rows int")


@query(
    "files_statistics",
    "SELECT count(*) AS records, CAST(min(o_orderkey) AS BIGINT) AS low, CAST(max(o_orderkey) AS BIGINT) AS high, CAST(0 AS BIGINT) AS nulls FROM orders"
)
def _statistics(t: Tables) -> DataFrame:
    """Counts and bounds of a column as the data files' records have them."""
    table = Transaction(_catalog(t), "q.orders").append(t.orders.select("o_orderkey").df).commit()
    fs = [x.file for x in table.plan(stats=True)[0].tasks]
    pick = lambda f, name: next(x["value"] for x in f[name] if x["key"] == 1)
    bound = lambda f, name: manifest.from_bound("long", pick(f, name))
    row = (
        sum(f["record_count"] for f in fs), min(bound(f, "lower_bounds") for f in fs),
        max(bound(f, "upper_bounds") for f in fs), sum(pick(f, "null_value_counts") for f in fs)
    )
    return _made(t, row, schema="records bigint, low bigint, high bigint, nulls bigint")


def _database_jar(t: Tables, df: DataFrame, table: str) -> str:
    """The URL of a new Derby database with the rows of ``df`` as ``table``. One in memory is seen by the JVM that made
    it only, one in a folder can be open in one JVM only; in a jar, which is read-only, every executor can open it."""
    at = Storage.local(fresh_dir(t.spark, "database"))
    if at is None:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must be a mounted folder: Derby reads a jar by its path")
        at = tempfile.mkdtemp(prefix="quern-")
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "CLOB"}
    columns = ", ".join(f"{name} {kinds[kind]}" for name, kind in df.dtypes)
    connect = t.spark._jvm.java.sql.DriverManager.getConnection
    with tempfile.TemporaryDirectory(prefix="quern-") as own:
        with open(f"{own}/rows.csv", "w", encoding="utf-8", newline="") as f:  # null is no text, "" the empty text
            csv.writer(f, quoting=csv.QUOTE_NOTNULL, lineterminator="\n").writerows(df.toLocalIterator())
        db = connect(f"jdbc:derby:{own}/db;create=true")
        try:
            s = db.createStatement()
            s.execute(f"CREATE TABLE {table} ({columns})")
            s.execute(
                f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{own}/rows.csv', ',', '\"', 'UTF-8', 0)"
            )
        finally:
            db.close()
        try:
            connect(f"jdbc:derby:{own}/db;shutdown=true")
        except Py4JJavaError as err:
            if err.java_exception.getSQLState() != "08006":  # that of a database shut down as it should be
                raise
        os.makedirs(at, exist_ok=True)
        with zipfile.ZipFile(f"{at}/db.jar", "w") as jar:  # not compressed: pages are found without reading up to them
            for folder, _, names in os.walk(f"{own}/db"):
                for name in names:
                    jar.write(f"{folder}/{name}", os.path.relpath(f"{folder}/{name}", own))
    return f"jdbc:derby:jar:({at}/db.jar)db"


@query("files_database", NATION)
def _database(t: Tables) -> DataFrame:
    """A table of a database read by JDBC, in parallel by a column; its schema is the driver's."""
    url = _database_jar(t, _nation(t), "nation")
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    got = files.read_database(t.spark, url, "nation", "n_nationkey", 0, 25, 3, **own)
    return got.toDF(*(x.lower() for x in got.columns))


# Functions


@query(
    "selectmany_function",
    "SELECT p_partkey, w AS word, CAST(length(w) AS INTEGER) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)"
)
def _select_many_with(t: Tables):
    """Flattening by a function that yields rows."""
    return t.part.select_many_with(
        lambda name: ((w, len(w)) for w in name.split(" ")), "word string, n int", "p_name", keep=["p_partkey"]
    )


@query(
    "group_join_agg",
    "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def _group_join_agg(t: Tables):
    return t.customer.group_join_agg(
        t.orders, [("c_custkey", "o_custkey")], n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2)
    ).select("c_custkey", "n", "total")


@query("reverse", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) - 1 AS i FROM orders")
def _reverse(t: Tables):
    return t.orders.order_by(c("o_totalprice").desc(), "o_orderkey").reverse().index("i").select("o_orderkey", "i")


@query(
    "join_range_long",
    "SELECT a.o_orderkey AS a, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 100 = 0) a JOIN orders b ON b.o_orderkey BETWEEN a.o_orderkey AND a.o_orderkey + a.o_custkey GROUP BY 1"
)
def _range_long(t: Tables) -> DataFrame:
    """Ranges of very different lengths: each is a bounded number of blocks."""
    wide = t.orders.where("o_orderkey % 100 = 0").let(
        hi=c("o_orderkey") + c("o_custkey")
    ).select(c("o_orderkey").alias("lo"), "hi")
    return t.orders.select("o_orderkey").range_join(
        wide, "o_orderkey", "lo", "hi", 1, c("r.lo").alias("a")
    ).df.groupBy("a").agg(F.count("*").alias("n"))


@query(
    "format_values",
    "SELECT n_nationkey, '{id: ' || n_nationkey || ', name: ' || n_name || ', list: [' || n_regionkey || ', null], map: {k: ' || n_regionkey || '}, day: 2020-01-02, bytes: 0x' || lower(hex(n_name[1:2])) || '}' AS text FROM nation"
)
def _format(t: Tables) -> DataFrame:
    """Nested values as one line of text."""
    s = F.struct(
        c("n_nationkey").alias("id"), c("n_name").alias("name"), F.array("n_regionkey", F.lit(None)).alias("list"),
        F.create_map(F.lit("k"), "n_regionkey").alias("map"), F.lit("2020-01-02").cast("date").alias("day"),
        F.encode(F.substring("n_name", 1, 2), "UTF-8").alias("bytes"),
    )
    df = _nation(t).withColumn("s", s)
    return df.select("n_nationkey", values.format_value(c("s"), df.schema["s"].dataType).alias("text"))


@query(
    "read_as",
    "SELECT o_orderkey, CASE WHEN o_orderkey <= 127 THEN CAST(o_orderkey AS TINYINT) END AS small, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS whole, CAST(o_orderkey AS DOUBLE) AS wide, "
    "CAST(NULL AS INTEGER) AS number, o_orderkey <> 0 AS truth FROM orders"
)
def _read_as(t: Tables) -> DataFrame:
    """Columns read as another width or type, null where they don't fit."""
    o, kinds = t.orders.df, {f.name: f.dataType for f in t.orders.df.schema}
    as_ = lambda name, to: values.read_as(c(name), kinds[name], to, strict=False)
    return o.select(
        "o_orderkey", as_("o_orderkey", "tinyint").alias("small"), as_("o_totalprice", "bigint").alias("whole"),
        as_("o_orderkey", "double").alias("wide"), as_("o_orderpriority", "int").alias("number"),
        as_("o_orderkey", "boolean").alias("truth"),
    )


# Streams


@query(
    "stream_window_counts",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
)
def _stream_windows(t: Tables) -> DataFrame:
    """Windowed counts by Structured Streaming over all that is there, the state written whole after each batch."""
    at, cp = fresh_dir(t.spark, "windows"), fresh_dir(t.spark, "progress")
    schema = t.spark.read.parquet(f"{t.sf}/events.parquet").schema
    stream = streams.file_stream(t.spark, f"{t.sf}/events.parquet*", schema).withColumn("ts", c("ts").cast("timestamp"))
    counts = streams.windowed(stream, "ts", "1 hour", "1 hour", ["event_type"], F.count("*").alias("n"))
    sink = lambda batch, _: batch.write.mode("overwrite").parquet(at)
    q = counts.writeStream.outputMode("complete").foreachBatch(sink).option(
        "checkpointLocation", cp
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return t.spark.read.schema(
        "window_start timestamp, window_end timestamp, event_type string, n bigint"
    ).parquet(at).select(c("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_into_table", "SELECT event_id, event_type, user_id FROM events")
def _stream_into(t: Tables) -> DataFrame:
    """A stream of files into a table, a snapshot per batch."""
    catalog, cp = _catalog(t), fresh_dir(t.spark, "progress")
    schema = t.spark.read.parquet(f"{t.sf}/events.parquet").schema
    stream = streams.file_stream(t.spark, f"{t.sf}/events.parquet*", schema).select("event_id", "event_type", "user_id")
    q = stream.writeStream.foreachBatch(
        streams.append_sink(catalog, "q.events", "files")
    ).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return catalog.load_table("q.events").to_df()
