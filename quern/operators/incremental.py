"""Processing only new or changed records.

The log is read by offsets: a partition of the log is a table, an offset a sequence number. ``read_until`` turns the
successful runs into one time per (table, offset), ``unread`` keeps the entries that arrived after it.
``IncrementalReader`` plans a batch by offsets, writes that plan ahead, replays it after a failure, and appends to a
sink that keeps one row per key and offset; ``unread_entries`` starts it from where the runs of a log have left off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.blocks import block_at, blocks_of
from quern.operators.snapshot_tables import headers, with_numbers
from quern.session import fresh_dir, materialise
from quern.sources.storage import Storage

def _ranges(runs: DataFrame) -> DataFrame:
    """(table_id, level, block, read_at): every run's range of offsets cut into aligned blocks, the block's latest time
    kept.

    A run costs a bounded number of rows, and a hot table's runs are combined map-side. ``lo`` is exclusive (null:
    none), ``hi`` inclusive.
    """
    r = runs.where("hi >= 0").withColumn("lo", F.greatest(F.coalesce("lo", F.lit(-1)), F.lit(-1))).where("lo < hi")
    cut = blocks_of(F.col("lo") + 1, F.least(F.col("hi"), F.lit(1 << 62)) + 1)
    return r.select(
        "table_id", "read_at", F.explode(cut).alias("b")
    ).groupBy("table_id", "b.level", "b.block").agg(F.max("read_at").alias("read_at"))


def succeeded_runs(run_log: DataFrame, heads: DataFrame) -> DataFrame:
    """(table_id, lo, hi, read_at) of the runs that succeeded; ``lo`` is null from the beginning.

    A run whose start or end names a snapshot without a number in ``heads`` has read nothing, as have those without
    read_at or table.
    """
    good = run_log.where(F.lower(F.trim("outcome")) == "succeeded").select(
        "table_id", "start_snapshot_id", "end_snapshot_id", "read_at"
    ).distinct()
    n = heads.select("snapshot_id", "sequence_number")
    s, e = n.toDF("start_snapshot_id", "lo"), n.toDF("end_snapshot_id", "hi")
    runs = good.join(e, "end_snapshot_id").join(s, "start_snapshot_id", "left")
    return runs.where("start_snapshot_id is null or lo is not null").where(
        "table_id is not null and read_at is not null"
    ).select("table_id", "lo", "hi", "read_at")


def read_until(offsets: DataFrame, runs: DataFrame) -> DataFrame:
    """(table_id, sequence_number, read_at): until when the runs have read each offset of ``offsets``; offsets never
    read are absent.

    An offset looks up the one block per level that holds it, so no range join pairs entries with runs.
    """
    return _lookup(offsets, _ranges(runs))


def _lookup(offsets: DataFrame, ranges: DataFrame) -> DataFrame:
    """``read_until`` for ranges already cut into blocks. Only levels on which some range has a block are looked up."""
    present = F.coalesce(ranges.agg(F.max("level").alias("n")).scalar() + 1, F.lit(0)).cast("int")
    levels = F.posexplode(block_at(F.col("sequence_number"), present))
    o = offsets.where("sequence_number >= 0").select("table_id", "sequence_number", levels.alias("level", "block"))
    hit = o.join(ranges, ["table_id", "level", "block"])
    return hit.groupBy("table_id", "sequence_number").agg(F.max("read_at").alias("read_at"))


def arrivals(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(entry_id, table_id, sequence_number, arrived_at): each entry once, at its first arrival; its number may come
    from the manifest."""
    e = entries.select(
        "entry_id", "table_id", "manifest_path", "snapshot_id", "sequence_number", "arrived_at"
    ).where("entry_id is not null")
    return with_numbers(e, listed).groupBy("entry_id").agg(
        F.max("table_id").alias("table_id"), F.max("sequence_number").alias("sequence_number"),
        F.min("arrived_at").alias("arrived_at")
    )


def unread(entries: DataFrame, listed: DataFrame, manifest_lists: DataFrame, run_log: DataFrame) -> DataFrame:
    """The entries, as ``arrivals``, that no successful run has read.

    An entry without a number, table or arrival can't have been read and is given. Without any run all entries are
    given.
    """
    here = arrivals(entries, listed)
    offsets = here.select("table_id", "sequence_number").where(
        "table_id is not null and sequence_number is not null"
    ).distinct()
    until = read_until(offsets, succeeded_runs(run_log, headers(manifest_lists)))
    j = here.join(until, ["table_id", "sequence_number"], "left")
    return j.where(
        ~F.coalesce(F.col("arrived_at") <= F.col("read_at"), F.lit(False))
    ).select("entry_id", "table_id", "sequence_number", "arrived_at")


class IncrementalReader:
    """Batches over a growing log, each record once, whatever fails in between and however late a record comes.

    ``log``: a frame, or a function that gives it anew, with columns ``partition``, ``offset``, ``key`` and, if there is
    one, ``arrival``. What was read is known by partition and offset: how many rows the log held there when a batch was
    planned. An offset that holds more by now, because it is new or because rows came late, is read again, and the sink
    keeps one row per key and offset.

    In ``state`` (a shared folder): ``plans/N`` is the write-ahead plan of batch N as rows (partition, offset, n,
    after), ``keys/N`` its rows without a place, both marked by ``planned/N`` once they are whole; ``done/N`` marks the
    batch as carried out. A run begins by replaying a plan without that mark. ``sink/batch=N`` is overwritten whole on
    replay. ``seed`` takes over what other runs have read, as ranges of offsets with the time up to which they read
    arrivals: of those offsets only rows that arrived after it are read (``after``); rows of unknown arrival are read.
    Rows without partition or offset have no place in a plan by offsets: they are compared with the sink by key. Plans,
    marks and batches are tables of commits, never of the driver; only their numbers are listed, and every ``fold``
    batches the offsets read so far are written together, so a plan looks at a bounded number of folders.
    """

    def __init__(
        self, spark: SparkSession, log: DataFrame | Callable[[], DataFrame], state: str, partition: str, offset: str,
        key: str, arrival: str | None = None, fold: int = 32
    ):
        self.spark, self.state, self.partition, self.offset, self.key, self.arrival, self.fold = spark, state.rstrip(
            "/"
        ), partition, offset, key, arrival, fold
        self.log = log if callable(log) else lambda: log
        self.storage = Storage(spark)

    def _names(self, part: str) -> list[int]:
        names = (p.rsplit("/", 1)[1].split("=")[-1] for p, _, _ in self.storage.list(f"{self.state}/{part}"))
        return sorted(int(n) for n in names if n.isdigit())

    def _placed(self) -> DataFrame:
        """The log's rows with a partition and an offset, as _p and _o."""
        return self.log().withColumns(
            {"_p": F.col(self.partition).cast("string"), "_o": F.col(self.offset).cast("bigint")}
        ).where("_p is not null and _o is not null")

    def seed(self, runs: DataFrame) -> None:
        """``runs``: (partition column, lo, hi, read_at), ``lo`` exclusive or null, as ``succeeded_runs`` gives them. To
        be called before the first batch."""
        ranges = _ranges(runs.withColumnRenamed(self.partition, "table_id") if self.partition != "table_id" else runs)
        ranges.select(
            F.col("table_id").cast("string").alias("table_id"), "level", "block", "read_at"
        ).write.mode("overwrite").parquet(f"{self.state}/seeded")

    def _read(self) -> DataFrame | None:
        """(_p, _o, _n): how many rows earlier plans have seen under each offset."""
        folds, plans = self._names("folded"), self._names("planned")
        paths = ([f"{self.state}/folded/{folds[-1]}"] if folds else []) + [
            f"{self.state}/plans/{n}" for n in plans if not folds or n > folds[-1]
        ]
        if not paths:
            return None
        return self.spark.read.schema(
            "_p string, _o bigint, _n bigint"
        ).parquet(*paths).groupBy("_p", "_o").agg(F.max("_n").alias("_n"))

    def _news(self) -> DataFrame:
        """(_p, _o, _n, _after): the offsets with rows that no batch and no seeded run has read."""
        last = F.max(F.col(self.arrival)) if self.arrival else F.lit(None).cast("timestamp_ntz")
        unknown = F.count_if(F.col(self.arrival).isNull()) if self.arrival else F.count("*")
        here = self._placed().groupBy("_p", "_o").agg(
            F.count("*").alias("_n"), last.alias("_last"), unknown.alias("_unknown")
        )
        none = F.lit(None).cast("timestamp_ntz")
        if self.storage.exists(f"{self.state}/seeded/_SUCCESS"):
            seeded = self.spark.read.parquet(f"{self.state}/seeded")
            until = _lookup(
                here.select(F.col("_p").alias("table_id"), F.col("_o").alias("sequence_number")), seeded
            ).toDF("_p", "_o", "_after")
            here = here.join(until, ["_p", "_o"], "left")
            here = here.where("_after is null or _unknown > 0 or _last > _after")
        else:
            here = here.withColumn("_after", none)
        read = self._read()
        if read is not None:
            here = here.join(
                read.withColumnRenamed("_n", "_seen"), ["_p", "_o"], "left"
            ).where("_seen is null or _n > _seen")
        return here.select("_p", "_o", "_n", "_after")

    def _unplaced(self) -> DataFrame:
        """Rows without partition or offset, with their key as _k, that no finished batch has delivered."""
        rows = self.log().where(F.col(self.partition).isNull() | F.col(self.offset).isNull()).withColumn(
            "_k", F.coalesce(F.col(self.key).cast("string"), F.lit("\0"))
        )
        done = self._names("done")
        if not done:
            return rows
        return rows.join(
            self.spark.read.parquet(*(f"{self.state}/keys/{n}" for n in done)).distinct(), "_k", "left_anti"
        )

    def plan(self) -> int | None:
        """The number of the next batch: a plan left by a failed run, else a new one; None if nothing is new."""
        plans, done = self._names("planned"), self._names("done")
        if plans and (not done or plans[-1] != done[-1]):
            return plans[-1]
        n = plans[-1] + 1 if plans else 0
        if n and n % self.fold == 0 and (read := self._read()) is not None:
            read.write.mode("overwrite").parquet(f"{self.state}/folding")
            self.spark.read.parquet(f"{self.state}/folding").write.mode("overwrite").parquet(
                f"{self.state}/folded/{n - 1}"
            )
        # A plan without its mark is what a failed planner left: it is planned anew.
        self._news().write.mode("overwrite").parquet(f"{self.state}/plans/{n}")
        self._unplaced().select("_k").distinct().write.mode("overwrite").parquet(f"{self.state}/keys/{n}")
        if all(self.spark.read.parquet(f"{self.state}/{part}/{n}").isEmpty() for part in ("plans", "keys")):
            return None
        self.storage.create(f"{self.state}/planned/{n}", b"")
        return n

    def batch(self, n: int) -> DataFrame:
        """The rows of plan ``n``, by one join on partition and offset. Replayed, it gives the same rows and those that
        came under its offsets since."""
        p = self.spark.read.schema("_p string, _o bigint, _after timestamp_ntz").parquet(f"{self.state}/plans/{n}")
        rows = self._placed().join(p, ["_p", "_o"])
        if self.arrival:
            rows = rows.where(
                F.col("_after").isNull() | F.col(self.arrival).isNull() | (F.col(self.arrival) > F.col("_after"))
            )
        other = self._unplaced().join(self.spark.read.parquet(f"{self.state}/keys/{n}"), "_k", "left_semi")
        return rows.select(*self.log().columns).unionByName(other.drop("_k"))

    def run(self, work: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int | None:
        """Carry out one batch; gives its number, or None if nothing is new. ``work`` keeps the key and offset
        columns."""
        n = self.plan()
        if n is not None:
            work(self.batch(n)).write.mode("overwrite").parquet(f"{self.state}/sink/batch={n}")
            self.storage.create(f"{self.state}/done/{n}", b"")
        return n

    def sink(self) -> DataFrame:
        """What the finished batches wrote, one row per key and offset."""
        done = self._names("done")
        paths = [f"{self.state}/sink/batch={n}" for n in done]
        return self.spark.read.parquet(*paths).dropDuplicates([self.key, self.offset]) if paths else self.log().limit(0)


def unread_entries(
    spark: SparkSession, entries: DataFrame, listed: DataFrame, manifest_lists: DataFrame, run_log: DataFrame,
    state: str | None = None
) -> DataFrame:
    """The rows of ``unread``, as the reader delivers them: the log of arrivals is read from where the successful runs
    left it.

    ``state``: the reader's folder; by default a new one in the shared folder. A later call with the same folder carries
    on from the batches done.
    """
    log = materialise(arrivals(entries, listed), "arrivals")
    reader = IncrementalReader(
        spark, log, state or fresh_dir(spark, "reader"), "table_id", "sequence_number", "entry_id", "arrived_at"
    )
    if not reader.storage.exists(f"{reader.state}/seeded/_SUCCESS"):
        reader.seed(succeeded_runs(run_log, headers(manifest_lists)))
    reader.run()
    return reader.sink()
