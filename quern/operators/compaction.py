"""Far too many small files: size-tiered incremental compaction with an idempotent transaction journal.

``plan`` decides on metadata alone which small items merge, level by level: at each level items of one size tier fill
bins, a bin is a transaction, and its output is an item of the next level. ``CompactionJournal`` records every
transaction of every level with its inputs before anything is written, and the outputs after it. A transaction's id
follows from its inputs, so a plan made again names the same outputs, and what the journal holds as done is not done
twice. ``compact_manifests`` and ``compact_parquet`` carry plans out; what they wrote is an item of their later calls,
so outputs climb from tier to tier as data arrives.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.snapshot_tables import location
from quern.session import fresh_dir, materialise
from quern.sources.storage import Storage

_MERGES = "array<struct<level:int,txn:string,input:string,size:bigint>>"


@dataclass(frozen=True)
class Policy:
    """``least_inputs``: a group with fewer small items is left alone. ``target``: size at which an output is full.
    ``fan``: sizes within this factor are one tier. ``levels``: how often outputs may be merged on; the last level joins
    all tiers. ``part``: items of a group planned together; a larger group is planned in so many parts, each with at
    most one output below target. ``alone``: a small item that no other joins is a transaction of its own (it is
    rewritten)."""

    least_inputs: int = 6
    target: int = 8 << 20
    fan: int = 4
    levels: int = 3
    part: int = 50_000
    alone: bool = False


def plan(
    items: DataFrame, group: Sequence[str], item: str, size: str, small: Column, policy: Policy = Policy()
) -> DataFrame:
    """``group``, ``item``, ``size``, ``level``, ``txn``, ``output_size``, ``merges`` for every small item of a group
    with enough of them.

    ``items`` has one row per item. ``merges`` lists the transactions on the item's way, lowest level first, each with
    the input by which the item came into it: the item itself, then the transaction below. ``txn`` is the last of them:
    items with the same ``txn`` become one output; ``level`` counts the merges (0: the part holds nothing to merge it
    with). Null sizes count as 0; null group values are a group. An empty input gives an empty plan. One shuffle
    distributes the parts; the windows of all levels need only sorts within them.
    """
    g = list(group)
    few = items.where(small).select(
        *g, F.col(item).alias("_item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")
    )
    counts = few.groupBy(*g).agg(F.count("*").alias("_n")).where(F.col("_n") >= policy.least_inputs)
    on = F.lit(True)
    for c in g:
        on = on & F.col(f"i.{c}").eqNullSafe(F.col(f"c.{c}"))
    rows = few.alias("i").join(counts.alias("c"), on).select("i.*", "c._n")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_item"), F.ceil(F.col("_n") / policy.part)))
    rows = rows.repartition(*g, "_part").withColumns(
        {
            "_node": F.sha2("_item", 256), "_now": F.col("_size"), "level": F.lit(0),
            "merges": F.expr(f"cast(array() as {_MERGES})")
        }
    )
    at = [*g, "_part"]
    for level in range(1, policy.levels + 1):
        log = F.floor(F.log(float(policy.fan), F.greatest(F.col("_now"), F.lit(1)).cast("double")))
        tier = log if level < policy.levels else F.lit(0).cast("bigint")
        full = F.col("_now") >= policy.target
        rows = rows.withColumn("_tier", F.when(full, F.lit(-1).cast("bigint")).otherwise(tier))
        upto = Window.partitionBy(*at, "_tier").orderBy("_now", "_node", "_item").rowsBetween(
            Window.unboundedPreceding, 0
        )
        rows = rows.withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
        first = F.min("_before").over(Window.partitionBy(*at, "_tier", "_node"))
        rows = rows.withColumn("_bin", F.floor(first / policy.target))
        bins = Window.partitionBy(*at, "_tier", "_bin")
        several = F.min("_node").over(bins) != F.max("_node").over(bins)
        last = F.lit(policy.alone and level == policy.levels) & (F.col("level") == 0)
        rows = rows.withColumn("_merge", ((F.col("_tier") >= 0) & several) | last)
        inputs = F.bit_xor(F.xxhash64("_item")).over(bins)
        names = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in g]
        merged = F.sha2(F.concat_ws("|", F.lit(level), *names, inputs, F.count("*").over(bins)), 256)
        txn = F.when((F.col("_tier") >= 0) & several, merged).otherwise(F.sha2(F.concat(F.lit("alone|"), "_node"), 256))
        total = F.when((F.col("_tier") >= 0) & several, F.sum("_size").over(bins)).otherwise(F.col("_now"))
        rows = rows.withColumns({"_txn": txn, "_sum": total})
        own = F.when(F.col("level") == 0, F.col("_item")).otherwise(F.col("_node"))
        step = F.struct(
            F.lit(level).alias("level"), F.col("_txn").alias("txn"), own.alias("input"), F.col("_now").alias("size")
        )
        rows = rows.withColumns({
            "merges": F.when(F.col("_merge"), F.concat("merges", F.array(step))).otherwise(F.col("merges")),
            "_new": F.when(F.col("_merge"), F.col("_txn")).otherwise(F.col("_node")),
            "_now2": F.when(F.col("_merge"), F.col("_sum")).otherwise(F.col("_now")),
            "level": F.when(F.col("_merge"), level).otherwise(F.col("level")),
        })
        rows = rows.drop("_node", "_now", "_tier", "_before", "_bin", "_merge", "_txn", "_sum")
        rows = rows.withColumnsRenamed({"_new": "_node", "_now2": "_now"})
    return rows.select(
        *g, F.col("_item").alias(item), F.col("_size").alias(size), "level", F.col("_node").alias("txn"),
        F.col("_now").alias("output_size"), "merges"
    )


class CompactionJournal:
    """Transactions in a shared folder: ``intents`` are written before the work, ``done`` after it.

    An intent is one input of one transaction: ``group`` columns, ``txn``, ``level``, ``input``, its ``size``, ``leaf``
    (whether the input was there before the plan; else it is a transaction of a lower level of the same plan), and
    ``final`` and ``output_size``: the plan's last transaction above it, whose output is written. ``done`` names for a
    final transaction the folder or file that holds its output; what failed runs left elsewhere is never read. Both only
    grow, one folder per call, and a folder without the mark of a finished write does not count.
    """

    _INTENT = "txn string, level int, input string, size bigint, leaf boolean, final string, output_size bigint"
    _DONE = "final string, folder string"

    def __init__(self, spark: SparkSession, path: str, group: str):
        """``group``: the columns of a group, as DDL."""
        self.spark, self.path, self.group = spark, path.rstrip("/"), T.StructType.fromDDL(group)
        self.storage = Storage(spark)

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        folders = [p for p, _, folder in self.storage.list(f"{self.path}/{part}") if folder]
        whole = [p for p in folders if self.storage.exists(f"{p}/_SUCCESS")]
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def _write(self, part: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{part}/{uuid.uuid4().hex}")

    def intents(self) -> DataFrame:
        return self._read("intents", T.StructType([*self.group, *T.StructType.fromDDL(self._INTENT)])).distinct()

    def done(self) -> DataFrame:
        """(final, folder): one output per transaction, even where two runs finished the same one."""
        return self._read(
            "done", T.StructType.fromDDL(self._DONE)
        ).groupBy("final").agg(F.min("folder").alias("folder"))

    def taken(self) -> DataFrame:
        """(input): what some transaction has taken, done or not."""
        return self.intents().where("leaf").select("input").distinct()

    def live(self) -> DataFrame:
        """(group, item, size, folder): outputs of finished transactions that no later one has taken."""
        made = self.intents().select(
            *self.group.names, F.col("final").alias("item"), F.col("output_size").alias("size")
        ).distinct()
        out = made.join(self.done().withColumnRenamed("final", "item"), "item")
        return out.join(self.taken().withColumnRenamed("input", "item"), "item", "left_anti")

    def begin(self, planned: DataFrame, item: str) -> DataFrame:
        """Record the transactions of ``planned`` that are not recorded yet; gives (input, final) of the leaves still to
        be done."""
        steps = planned.select(
            *self.group.names, F.col(item).alias("_item"), F.col("txn").alias("final"), "output_size",
            F.explode("merges").alias("m")
        )
        rows = steps.select(
            *self.group.names, "m.txn", "m.level", "m.input", "m.size",
            (F.col("m.input") == F.col("_item")).alias("leaf"), "final", "output_size"
        ).distinct()
        self._write(
            "intents", rows.join(self.intents().select("final").distinct(), "final", "left_anti").select(*rows.columns)
        )
        return self.intents().where("leaf").join(self.done(), "final", "left_anti").select("input", "final")

    def commit(self, finished: DataFrame) -> None:
        """``finished``: (final, folder)."""
        self._write("done", finished.select("final", "folder").distinct())


# Manifests

MANIFEST_GROUP = "table_id bigint, partition_spec_id int, written_day date"


def manifest_items(listed: DataFrame) -> DataFrame:
    """Each data manifest (content 0) once, with any value that one of its rows knows, and whether it is small."""
    at = listed.select(
        "table_id", location("manifest_path").alias("manifest_path"), "partition_spec_id", "content", "manifest_length",
        "added_files_count", "added_rows_count", "written_at"
    ).where("manifest_path is not null")
    known = ("partition_spec_id", "content", "manifest_length", "added_files_count", "added_rows_count")
    m = at.groupBy("table_id", "manifest_path").agg(
        *(F.max(c).alias(c) for c in known), F.to_date(F.min("written_at")).alias("written_day")
    ).where("content = 0")
    short = F.coalesce(F.col("manifest_length") < 6144, F.lit(False))
    sparse = F.coalesce(
        (F.col("added_files_count") > 0) & (
            F.col("added_rows_count") < 1000 * F.col("added_files_count").cast("bigint")
        ),
        F.lit(False)
    )
    return m.withColumn("small", short | sparse)


def plan_manifests(listed: DataFrame, policy: Policy = Policy(alone=True)) -> DataFrame:
    """The plan for the small manifests of every table, partition spec and UTC day. One that no other joins is rewritten
    by itself, since its files are merged."""
    return plan(
        manifest_items(listed), ["table_id", "partition_spec_id", "written_day"], "manifest_path", "manifest_length",
        F.col("small"), policy
    )


def recorded_manifests(
    spark: SparkSession, listed: DataFrame, journal: str | None = None, policy: Policy = Policy(alone=True)
) -> DataFrame:
    """(table_id, manifest_path, txn, level, final): the manifests that a plan takes, as the journal holds them after it
    was written ahead.

    ``journal``: its folder; by default a new one in the shared folder. Calling again with the same input records
    nothing new.
    """
    log = CompactionJournal(spark, journal or fresh_dir(spark, "journal"), MANIFEST_GROUP)
    log.begin(plan_manifests(listed, policy), "manifest_path")
    return log.intents().where("leaf").select(
        "table_id", F.col("input").alias("manifest_path"), "txn", "level", "final"
    )


def single_entries(entries: DataFrame) -> DataFrame:
    """``entries`` once each, with ``_key`` and ``_path`` (the manifest's one spelling).

    A repeated entry_id is the same change and is kept once, as it arrived first; of rows that arrived together the one
    with the most columns known. Rows without an entry_id are told apart by all their values.
    """
    cols = [c for c in entries.columns if c not in ("_key", "_path")]
    row = F.struct(*(f"`{c}`" for c in cols))
    key = F.coalesce(F.col("entry_id").cast("string"), F.concat(F.lit("row "), F.sha2(F.to_json(row), 256)))
    late = F.coalesce("arrived_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    unknown = F.lit(0)
    for c in cols:
        unknown = unknown + F.col(f"`{c}`").isNull().cast("int")
    e = entries.select(
        key.alias("_key"), late.alias("_at"), unknown.alias("_unknown"),
        F.struct(location("manifest_path").alias("_path"), row.alias("r")).alias("x")
    )
    once = e.groupBy("_key").agg(F.min_by("x", F.struct("_at", "_unknown", F.col("x._path"))).alias("x"))
    return once.select("_key", "x._path", *(F.col(f"x.r.`{c}`").alias(c) for c in cols))


class ManifestCompaction:
    """Compaction of manifests: their entries are written anew below ``target``, with ``output`` naming the new manifest
    of each.

    Every call of ``run`` finishes what a failed run has recorded, and takes what has come since: new small manifests,
    outputs that are still below the policy's target, and entries that arrived late for a manifest already taken (an
    item of their own, ``path#n``).
    """

    def __init__(
        self, spark: SparkSession, target: str, journal: str, policy: Policy = Policy(alone=True),
        entry_bytes: int = 256
    ):
        self.spark, self.target, self.policy, self.entry_bytes = spark, target.rstrip("/"), policy, entry_bytes
        self.log = CompactionJournal(spark, journal, MANIFEST_GROUP)
        self.storage = Storage(spark)

    def _written(self, like: DataFrame) -> DataFrame | None:
        """The entries in live outputs, with ``output``; None before anything is done. ``like``: what ``single_entries``
        gives."""
        runs = [r.folder for r in self.log.done().select("folder").distinct().collect()]  # one for each call that did something
        if not runs:
            return None
        schema = T.StructType([*like.schema, T.StructField("output", T.StringType())])
        read = self.spark.read.schema(schema).parquet(*(f"{self.target}/run-{r}" for r in runs))
        read = read.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"/run-([0-9a-f]+)/", 1))
        live = self.log.live().select(F.col("item").alias("output"), F.col("folder").alias("_folder"))
        return read.join(live, ["output", "_folder"], "left_semi").select(*schema.names)

    def _items(self, listed: DataFrame, late: DataFrame | None) -> DataFrame:
        """(group, item, size, small) of all that a plan may take."""
        g = self.log.group.names
        manifests = manifest_items(listed)
        fresh = manifests.select(
            *g, F.col("manifest_path").alias("item"), F.col("manifest_length").alias("size"), "small"
        )
        outputs = self.log.live().select(*g, "item", "size", (F.col("size") < self.policy.target).alias("small"))
        every = fresh.join(
            self.log.taken().withColumnRenamed("input", "item"), "item", "left_anti"
        ).unionByName(outputs)
        if late is None:
            return every
        takes = self._leaves().groupBy("_path").agg(F.count("*").alias("_n"), *(F.max(c).alias(c) for c in g))
        n = late.groupBy("_path").agg(F.count("*").alias("_late")).join(takes, "_path")
        return every.unionByName(
            n.select(
                *g, F.concat("_path", F.lit("#"), "_n").alias("item"),
                (F.col("_late") * self.entry_bytes).alias("size"), F.lit(True).alias("small")
            )
        )

    def _leaves(self) -> DataFrame:
        """(group, input, _path, final) of the manifests and late parts that transactions have taken."""
        return self.log.intents().where("leaf").withColumn("_path", F.regexp_replace("input", r"#\d+$", ""))

    def run(self, entries: DataFrame, listed: DataFrame) -> bool:
        """One round; False if there was nothing to do."""
        every = single_entries(entries)
        written, late = self._written(every), None
        if written is not None:
            open_ = self.log.intents().where("leaf").join(self.log.done(), "final", "left_anti").select(
                F.regexp_replace("input", r"#\d+$", "").alias("_path")
            )
            finished = self._leaves().select("_path").distinct().join(open_, "_path", "left_anti")
            late = every.join(finished, "_path", "left_semi").join(written.select("_key"), "_key", "left_anti")
        g = self.log.group.names
        items = materialise(self._items(listed, late), "items")
        enough = items.where("small").groupBy(*g).agg(F.count("*").alias("_n")).where(
            F.col("_n") >= self.policy.least_inputs
        )
        open_ = self.log.intents().where("leaf").join(self.log.done(), "final", "left_anti").select("input", "final")
        todo = materialise(
            open_ if enough.isEmpty() else self.log.begin(
                plan(items, g, "item", "size", F.col("small"), self.policy), "item"
            ),
            "todo"
        )
        if todo.isEmpty():
            return False
        by_path = todo.select(
            F.regexp_replace("input", r"#\d+$", "").alias("_path"), F.col("final").alias("output")
        ).distinct()
        moved = every.join(by_path, "_path")
        if written is not None:
            moved = moved.join(written.select("_key"), "_key", "left_anti")
            again = todo.select(F.col("input").alias("output"), F.col("final").alias("_final"))
            moved = moved.unionByName(
                written.join(again, "output").drop("output").withColumnRenamed("_final", "output")
            )
        run = uuid.uuid4().hex
        # An output is at most about twice the policy's target, so a task's share has a bound.
        moved.repartition("output").sortWithinPartitions("output").write.parquet(f"{self.target}/run-{run}")
        self.log.commit(todo.select("final", F.lit(run).alias("folder")))
        return True

    def entries(self, entries: DataFrame) -> DataFrame:
        """All entries, each once, with ``output``: the new manifest that holds it, or its own where that is not
        compacted."""
        every = single_entries(entries)
        written, own = self._written(every), every.withColumn("output", F.col("_path"))
        if written is not None:
            taken = self._leaves().select("_path").distinct()
            kept = own.join(taken, "_path", "left_anti")
            late = own.join(taken, "_path", "left_semi").join(written.select("_key"), "_key", "left_anti")
            own = written.unionByName(kept).unionByName(late)
        return own.drop("_key", "_path")


# Files


def _address(path: str):
    """(file system, path in it) for a location as Spark writes it."""
    import pyarrow.fs as pafs

    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _spelled(path: str, like: str) -> str:
    """``path`` inside the file system of ``like`` as a location."""
    scheme = "file" if like.startswith("file:") or "://" not in like else like.split("://")[0]
    if scheme in ("file", "s3", "s3a", "s3n"):
        return f"{scheme}://{path}"
    return f"{scheme}://{like.split('://')[1].split('/')[0]}{path}"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files below ``path``; contents are not read. A missing folder has none.

    Tasks list: one the folder itself, others the folders in it, so no listing passes through the driver.
    """

    def listed(folders: Iterator, deep: bool) -> Iterator:
        import pandas as pd
        import pyarrow.fs as pafs

        for d in folders:
            for p in d["path"]:
                fs, inner = _address(p)
                found = fs.get_file_info(pafs.FileSelector(inner, recursive=deep, allow_not_found=True))
                rows = [(_spelled(x.path, p), x.size or 0, x.type == pafs.FileType.Directory) for x in found]
                for k in range(0, len(rows), 50_000):
                    yield pd.DataFrame(
                        rows[k : k + 50_000], columns=["path", "length", "folder"]
                    ).astype({"length": "int64", "folder": bool})

    kind = "path string, length bigint, folder boolean"
    top = materialise(
        spark.createDataFrame([(path,)], "path string").mapInPandas(lambda d: listed(d, False), kind), "listing"
    )
    folders = top.where("folder").select("path").repartition(F.col("path"))
    every = top.unionByName(folders.mapInPandas(lambda d: listed(d, True), kind))
    hidden = F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]")
    return every.where(~F.col("folder") & F.col("path").endswith(".parquet") & ~hidden).select("path", "length")


FILE_GROUP = "source string"


def live_files(spark: SparkSession, source: str, journal: str) -> DataFrame:
    """(path, length) of the files that make up the table: sources and outputs that no finished transaction has
    merged."""
    log = CompactionJournal(spark, journal, FILE_GROUP)
    made = log.live().select(F.col("folder").alias("path"), F.col("size").alias("length"))
    merged = log.intents().where("leaf").join(log.done(), "final", "left_semi").select(F.col("input").alias("path"))
    return list_files(spark, source).join(merged, "path", "left_anti").unionByName(made)


def compact_parquet(
    spark: SparkSession, source: str, target: str, journal: str, policy: Policy = Policy(target=128 << 20)
) -> DataFrame:
    """Merge the small Parquet files of a table; gives the files that make it up afterwards: (path, length).

    ``source``: where new files arrive, all of one schema. Outputs go below ``target``; one that is still small is
    merged on with others of its size by a later call. No file is deleted, since readers may hold it: ``live_files``
    says what counts. A run that failed is finished by calling again. A transaction is one task: it reads its inputs
    batch by batch and writes its output, at most about twice ``policy.target`` large, so no row is shuffled and files
    of target size and more are never opened. A task that is tried again writes another file; the journal names the one
    that counts.
    """
    log = CompactionJournal(spark, journal, FILE_GROUP)
    made = log.live().select(
        "source", F.col("folder").alias("path"), F.col("size").alias("length"), F.col("item").alias("_item")
    )
    fresh = list_files(spark, source).select(
        F.lit(source).alias("source"), "path", "length", F.col("path").alias("_item")
    )
    items = fresh.unionByName(made).join(log.taken().withColumnRenamed("input", "_item"), "_item", "left_anti")
    items = materialise(items, "items")
    planned = plan(items, ["source"], "_item", "length", F.col("length") < policy.target, policy)
    todo = log.begin(planned, "_item")
    outputs = log.done().select(F.col("final").alias("input"), "folder")
    todo = materialise(
        todo.join(outputs, "input", "left").select("final", F.coalesce("folder", "input").alias("path")), "todo"
    )
    if not todo.isEmpty():
        base = f"{target.rstrip('/')}/run-{uuid.uuid4().hex}"

        def copy(rows):
            import pyarrow as pa
            import pyarrow.parquet as pq

            final = rows.column("final")[0].as_py()
            to = f"{base}/{final}-{uuid.uuid4().hex}.parquet"
            fs, inner = _address(to)
            fs.create_dir(inner.rsplit("/", 1)[0])
            writer = None
            with fs.open_output_stream(inner) as out:
                for path in sorted(rows.column("path").to_pylist()):
                    source_fs, at = _address(path)
                    with source_fs.open_input_file(at) as f:
                        file = pq.ParquetFile(f)
                        writer = writer or pq.ParquetWriter(out, file.schema_arrow, compression="zstd")
                        for batch in file.iter_batches():
                            writer.write_table(
                                pa.Table.from_batches([batch]).select(writer.schema.names).cast(writer.schema)
                            )
                writer.close()
            return pa.table({"final": [final], "folder": [to]})

        log.commit(todo.groupBy("final").applyInArrow(copy, "final string, folder string"))
    return live_files(spark, source, journal)
