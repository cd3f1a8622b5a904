"""References to records that do not exist.

A Bloom filter of the parents' keys, built by one pass over their hashes and broadcast to the scan of the references,
proves in the scan, before anything is shuffled, that a key it doesn't hold is an orphan. Only the keys it may hold go
through an exact join: their distinct keys, combined map-side, meet the parents once. What that join finds missing or
deleted is few; a filter of it lets the second scan of the references pass over all others, and only these are
aggregated. The filters have a bound whatever the number of parents: at most ``FILTERS`` of 8 MiB, each for its share of
the keys' hashes. Where more parents make them fuller, more keys are verified and the result is the same.

Spark's own test of its filters takes them as scalar subqueries, so each place in a plan that asks one has its copy in
the driver and in the tasks it sends, several hundred MB of them at the bound. Here the driver has them once, as blocks
of a broadcast, and only the hashes go to Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.snapshot_tables import location
from quern.session import materialise

#: Most filters that one set of keys gets, the keys one filter is made for, at ten bits each (one key in a hundred that
#: isn't there passes), and the most bits of one.
FILTERS, FILTER_KEYS, FILTER_BITS = 8, 4_000_000, 8 << 23


class Filters(NamedTuple):
    """``shared``: by remainder of the keys' 64-bit hashes the filter of those that have it, none where there are no
    keys."""

    shared: Broadcast
    parts: int
    bits: int
    probes: int


def _places(h: np.ndarray, bits: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Probe by probe, the byte and the bit in it where each hash stands in a filter."""
    x = h.view(np.uint64)
    at, step = x * np.uint64(0x9E3779B97F4A7C15), (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    for _ in range(probes):
        place = (at >> np.uint64(8)) % np.uint64(bits)
        yield place >> np.uint64(3), (place & np.uint64(7)).astype(np.uint8)
        at = at + step


def _fill(parts: int, bits: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = {}
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            part = h % parts
            for k in np.unique(part).tolist():
                own = filled.setdefault(k, np.zeros(bits // 8, np.uint8))
                for byte, bit in _places(h[part == k], bits, probes):
                    np.bitwise_or.at(own, byte, np.uint8(1) << bit)
        for k, own in filled.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "filter"]
            )

    return run


def bloom(keys: DataFrame, columns: list[str], expected: int) -> Filters:
    """The filters of the keys' 64-bit hashes.

    ``expected``: how many keys there are, at most. Of the keys only the hashes are shuffled, each to the task that
    fills its filter; the driver takes the filters one after another.
    """
    parts = min(FILTERS, -(-expected // FILTER_KEYS)) or 1
    each = max(1000, -(-expected // parts))
    bits = -(-min(10 * each, FILTER_BITS) // 8) * 8
    probes = max(1, round(bits / each * 0.693))  # ln 2: what lets the fewest others pass
    hashes = keys.select(F.xxhash64(*columns).alias("h"))
    cut = hashes.repartitionById(parts, F.pmod("h", F.lit(parts)).cast("int"))
    filled = materialise(cut.mapInArrow(_fill(parts, bits, probes), "part int, filter binary"), "bloom")
    held = {r["part"]: bytes(r["filter"]) for r in filled.toLocalIterator()}
    return Filters(keys.sparkSession.sparkContext.broadcast(held), parts, bits, probes)


def might_contain(filters: Filters, columns: list[str]) -> Column:
    """False where the filters prove that the key is not among the parents; an empty filter proves it for every key."""
    shared, parts, bits, probes = filters

    def held(h: pa.Array) -> pa.Array:
        h = h.to_numpy(zero_copy_only=False)
        part, found = h % parts, np.zeros(len(h), bool)
        for k, own in shared.value.items():
            asked = np.flatnonzero(part == k)
            own, may = np.frombuffer(own, np.uint8), np.ones(len(asked), bool)
            for byte, bit in _places(h[asked], bits, probes):
                may &= (own[byte] >> bit & np.uint8(1)).astype(bool)
            found[asked] = may
        return pa.array(found)

    # Called nondeterministic so that a plan asks it once a row, not again in each filter and branch it is pushed into.
    return F.arrow_udf(held, "boolean").asNondeterministic()(F.xxhash64(*columns))


def orphans(
    refs: DataFrame, parents: DataFrame, carry: list[str], keys: list[str], ref_time: str, gone_time: str | None = None,
    expected: int | None = None
) -> DataFrame:
    """``carry``, ``keys`` and ``since`` (earliest ``ref_time`` among the orphan references), one row per carry and key.

    A reference is an orphan if no parent has its key, or if the parent's ``gone_time`` (null: it exists) is at or
    before ``ref_time``. Of several parents with one key the one that exists longest counts. Null keys refer to nothing
    and are no orphans. Null ``ref_time``: the key counts if it has no parent, with the earliest known time. Extra
    columns are not read. ``expected``: the number of parents, if it is known.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    never = F.lit("9999-12-31").cast("timestamp_ntz")
    out = list(dict.fromkeys([*carry, *keys]))
    r = refs.where(known).select(*out, F.col(ref_time).alias("_at"))
    p = parents.where(known).select(*keys, (F.coalesce(F.col(gone_time), never) if gone_time else never).alias("_gone"))

    maybe = might_contain(bloom(p, keys, parents.count() if expected is None else expected), keys)
    asked = r.where(maybe).select(*keys).distinct()
    last = p.groupBy(*keys).agg(F.max("_gone").alias("_gone"))
    bad = materialise(
        asked.join(last, keys, "left").where(
            F.col("_gone").isNull() | (F.col("_gone") < never)
        ).withColumn("_bad", F.lit(True)),
        "verified"
    )
    # Rows that the filter clears are orphans; of the others only those with a key found missing or deleted are looked
    # at again.
    named = might_contain(bloom(bad, keys, bad.count()), keys)
    again = r.withColumns({"_maybe": maybe, "_named": named}).where("not _maybe or _named").join(bad, keys, "left")
    orphan = ~F.col("_maybe") | (F.col("_bad") & (F.col("_gone").isNull() | (F.col("_gone") <= F.col("_at"))))
    return again.where(F.coalesce(orphan, F.lit(False))).groupBy(*out).agg(F.min("_at").alias("since"))


# The kinds of references, in the order of their numbers below.
KINDS = ("snapshot", "manifest", "data_file")


def snapshot_orphans(
    listed: DataFrame, entries: DataFrame, snapshots: DataFrame, manifests: DataFrame, stored: DataFrame
) -> DataFrame:
    """(ref_kind, table_id, missing_key, ref_day): references of the snapshot tables to snapshots, manifests and files
    that are missing or deleted.

    The three kinds are one set of references and one of parents, with the kind as part of the key; a snapshot's key
    also has its table.
    """
    text, nowhere = lambda c: F.col(c).cast("string"), F.lit(-1).cast("bigint")

    def ref(kind: int, scope: Column, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), key.alias("key"))

    both = F.explode(
        F.array(
            ref(0, F.col("table_id").cast("bigint"), text("added_snapshot_id")),
            ref(1, nowhere, location("manifest_path"))
        )
    )
    refs = listed.select("table_id", F.col("written_at").alias("at"), both.alias("r")).unionByName(
        entries.where("status in (0, 1)").select(
            "table_id", F.col("arrived_at").alias("at"), ref(2, nowhere, location("data_file.file_path")).alias("r")
        )
    ).select("table_id", "at", "r.*")
    none = F.lit(None).cast("timestamp_ntz")
    there = (
        snapshots.select(F.lit(0).alias("kind"), F.col("table_id").cast("bigint").alias("scope"), text("snapshot_id").alias("key"), none.alias("gone")) .unionByName(
            manifests.select(
                F.lit(1).alias("kind"), nowhere.alias("scope"), location("manifest_path").alias("key"),
                F.col("deleted_at").alias("gone")
            )
        ) .unionByName(stored.select(
            F.lit(2).alias("kind"), nowhere.alias("scope"), location("file_path").alias("key"),
            F.col("deleted_at").alias("gone")
        ))
    )
    expected = sum(x.count() for x in (snapshots, manifests, stored))  # scans without columns
    found = orphans(refs, there, ["table_id"], ["kind", "scope", "key"], "at", "gone", expected)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.select(
        kind.alias("ref_kind"), "table_id", F.col("key").alias("missing_key"),
        F.date_format("since", "yyyy-MM-dd").alias("ref_day")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_kind, table_id, ref_day, orphans): how many keys are first missed on each day."""
    return found.groupBy("ref_kind", "table_id", "ref_day").agg(F.count("*").alias("orphans"))
