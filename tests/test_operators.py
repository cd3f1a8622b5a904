"""The operators for snapshot-table data: brute force on small inputs, and the odd cases each docstring defines."""

import datetime as dt
import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import queries
from quern.operators import changefeed, compaction, drift, hierarchy, incremental, orphans
from quern.operators.snapshot_tables import headers, location, number, with_numbers

T0 = dt.datetime(2020, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_locations(spark):
    cases = {
        "s3://b/x": "s3://b/x", "s3a://b/x//y": "s3://b/x/y", "s3n:///b//x": "s3://b/x", "s3:///b/x": "s3://b/x",
        "S3://b//x": "S3://b//x", "hdfs://b//x": "hdfs://b//x", "s3://B/X": "s3://B/X", "": "", None: None,
        "s3a:/b": "s3://b", "s3://" + "a" * 100_000 + "//b": "s3://" + "a" * 100_000 + "/b"
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    for r in df.select("p", location("p").alias("q")).collect():
        assert r.q == cases[r.p]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([(" 7 ",), ("-1",), ("null",), ("",), (None,), ("9" * 30,)], "t string")
    assert [r[0] for r in df.select(number("t")).collect()] == [7, -1, None, None, None, None]


def test_headers_repeated_and_unreadable(spark):
    df = spark.createDataFrame(
        [(" 5", "", 1, "1"), ("5", None, 1, "1"), ("x", "5", 1, "2"), ("6 ", " 5", 1, "2")],
        "snapshot_id string, parent_snapshot_id string, table_id bigint, sequence_number string"
    )
    assert sorted(map(tuple, headers(df).collect())) == [(5, None, 1, 1), (6, 5, 1, 2)]


def test_numbers_filled_keeps_clashing_columns(spark):
    e = spark.createDataFrame(
        [(1, "s3a://b//m", None, 4, "x"), (2, "s3://b/m", 9, 9, "y"), (3, None, None, None, "z")],
        "id int, manifest_path string, sequence_number bigint, snapshot_id bigint, _path string"
    )
    m = spark.createDataFrame(
        [("s3://b/m", None, 8), ("s3://b/m", 3, None)],
        "manifest_path string, sequence_number bigint, added_snapshot_id bigint"
    )
    assert sorted(
        map(tuple, with_numbers(e, m).select("id", "sequence_number", "snapshot_id", "_path").collect())
    ) == [(1, 3, 4, "x"), (2, 9, 9, "y"), (3, None, None, "z")]


# Changes


CHANGES = "k string, seq bigint, op string, a int, b string, extra int"


def brute_images(rows):
    best = {}
    for k, seq, op, a, b, _ in rows:
        if seq is None:
            continue
        rank = (seq, op == "d", a if a is not None else -1, b or "")
        if k not in best or rank > best[k][0]:
            best[k] = (rank, op, a, b)
    return {(k, v[2], v[3]) for k, v in best.items() if v[1] != "d"}


def test_images_in_any_order(spark):
    rnd = random.Random(1)
    rows = [
        (
            rnd.choice(["x", "hot", "hot", "y", None]), rnd.choice([None, *range(300)]), rnd.choice("uud"),
            rnd.randrange(5), rnd.choice(["", "p", "q"]), 1
        ) for _ in range(600)
    ]
    rows += rows[:50]
    df = spark.createDataFrame(rows, CHANGES)
    empty = spark.createDataFrame([], "k string, a int, b string")
    for chunk in (1, 7, 1000):
        got = changefeed.apply_changes(empty, df, ["k"], "seq", F.col("op") == "d", ["a", "b"], chunk=chunk)
        assert {tuple(r) for r in got.collect()} == brute_images(rows)
    assert changefeed.apply_changes(empty, df.limit(0), ["k"], "seq", F.col("op") == "d", ["a", "b"]).count() == 0


def test_partial_updates_over_a_base(spark):
    base = spark.createDataFrame(
        [("x", 1, "one"), ("y", 2, "two"), ("z", 3, "three"), (None, 4, "four")], "k string, a int, b string"
    )
    rows = [
        ("x", 1, "u", None, "uno", 0), ("x", 2, "u", 7, None, 0), ("y", 3, "d", None, None, 0),
        ("z", 1, "d", None, None, 0), ("z", 2, "u", 9, None, 0), ("n", 1, "u", 5, None, 0), (None, 1, "u", 8, None, 0)
    ]
    random.Random(2).shuffle(rows)
    got = changefeed.apply_changes(
        base, spark.createDataFrame(rows, CHANGES), ["k"], "seq", F.col("op") == "d", ["a", "b"], partial=True, chunk=1
    )
    assert {tuple(r) for r in got.collect()} == {("x", 7, "uno"), ("z", 9, None), ("n", 5, None), (None, 8, "four")}


# Compaction


def test_plan_merges_each_small_item_once(spark):
    rnd = random.Random(3)
    rows = [("g", f"f{i}", rnd.choice([0, 10, 100, 900, None]), True) for i in range(400)] + [
        ("few", f"x{i}", 5, True) for i in range(5)
    ] + [(None, f"n{i}", 5, True) for i in range(6)] + [("g", "big", 10_000, False)]
    df = spark.createDataFrame(rows, "g string, f string, size bigint, small boolean").withColumn("_item", F.lit(1))
    p = compaction.Policy(target=1000, levels=3, part=150)
    got = compaction.plan(df, ["g"], "f", "size", F.col("small"), p).collect()
    assert sorted(r.f for r in got) == sorted(f for g, f, _, _ in rows if f[0] in "fn")
    sizes = {}
    for r in got:
        sizes.setdefault((r.g, r.txn), []).append(r.size)
    assert all(sum(s) < 2 * 1000 + 900 for s in sizes.values())
    assert len([s for k, s in sizes.items() if k[0] == "g"]) < 150
    assert all(r.merges[-1].txn == r.txn if r.level else not r.merges for r in got)
    again = compaction.plan(df.repartition(7), ["g"], "f", "size", F.col("small"), p).collect()
    assert {(r.f, r.txn) for r in got} == {(r.f, r.txn) for r in again}
    assert compaction.plan(df.limit(0), ["g"], "f", "size", F.col("small")).count() == 0


def test_manifests_take_values_any_row_knows(spark):
    cols = "table_id bigint, manifest_path string, partition_spec_id int, content int, manifest_length bigint, added_files_count int, added_rows_count bigint, written_at timestamp_ntz"
    rows = [(1, f"s3://b/{i}", 0, 0, None, 2, 1999, at(i)) for i in range(6)] + [
        (1, "s3a://b//0", 0, 0, 9000, None, None, at(30)), (1, "s3://b/del", 0, 1, 10, 1, 1, at(0)),
        (1, None, 0, 0, 1, 1, 1, at(0)), (1, "s3://b/zero", 0, 0, None, 0, 0, at(0))
    ]
    got = compaction.plan_manifests(spark.createDataFrame(rows, cols)).collect()
    assert sorted(r.manifest_path for r in got) == [f"s3://b/{i}" for i in range(6)]
    e = spark.createDataFrame(
        [
            (7, "s3a://b/0", at(2), "late"), (7, "s3a://b/0", at(1), "first"), (8, "s3://b/other", at(1), "o"), (8, "s3://b/a", at(1), None),
            (None, "s3://b/1", None, "n")
        ],
        "entry_id bigint, manifest_path string, arrived_at timestamp_ntz, x string"
    )
    assert sorted((r.x, r._path) for r in compaction.single_entries(e).collect()) == [
        ("first", "s3://b/0"), ("n", "s3://b/1"), ("o", "s3://b/other")
    ]


LISTED = "table_id bigint, manifest_path string, partition_spec_id int, content int, manifest_length bigint, added_files_count int, added_rows_count bigint, written_at timestamp_ntz"
ENTRIES = "entry_id bigint, manifest_path string, arrived_at timestamp_ntz"


def manifest(i, length=100, rows=1):
    return (1, f"s3://b/{i}", 0, 0, length, 1, rows, at(0))


def test_journal_names_every_level(spark, tmp_path):
    rows = [("g", f"f{i}", size) for i, size in enumerate([10, 11, 12, 900, 901, 1000, 30_000])]
    df = spark.createDataFrame(rows, "g string, f string, size bigint")
    p = compaction.Policy(target=20_000, fan=4, alone=True)
    log = compaction.CompactionJournal(spark, f"file://{tmp_path}/log", "g string")
    for _ in range(2):
        log.begin(compaction.plan(df, ["g"], "f", "size", F.lit(True), p), "f")
        steps = log.intents().collect()
        assert sorted(r.input for r in steps if r.leaf) == sorted(f for _, f, _ in rows)
        assert {r.level for r in steps} == {1, 3}  # the tiers first, then what is left of all tiers
        made = {r.txn for r in steps}
        assert all(r.input in made for r in steps if not r.leaf) and len({r.final for r in steps}) == 2
        for txn in made:
            assert len([r for r in steps if r.txn == txn]) > 1 or [r.input for r in steps if r.txn == txn] == ["f6"]
    assert log.done().count() == 0 and log.live().count() == 0


def test_manifests_are_rewritten_once(spark, tmp_path):
    work = lambda n: compaction.ManifestCompaction(spark, f"file://{tmp_path}/out{n}", f"file://{tmp_path}/log{n}")
    listed = spark.createDataFrame([manifest(i) for i in range(8)] + [manifest("big", 9999, 9999)], LISTED)
    rows = [
        (k, f"s3a://b//{k % 9 if k % 9 < 8 else 'big'}", at(k % 5)) for k in range(90)
    ] + [(3, "s3://b/3", at(9)), (None, "s3://b/3", None), (None, "s3://b/3", None)]
    entries = compaction.single_entries(
        spark.createDataFrame(rows, ENTRIES).withColumn("output", F.lit("clash")).drop("output")
    )
    w = work(1)
    assert w.run(entries, listed) and not w.run(entries, listed)
    got = w.entries(entries).collect()
    assert sorted((r.entry_id if r.entry_id is not None else -1) for r in got) == [-1, *range(90)]
    assert {r.output for r in got if (r.entry_id or 0) % 9 == 8} == {"s3://b/big"} and len({r.output for r in got}) == 2
    assert not work(2).run(entries, listed.limit(0)) and work(2).entries(entries.limit(0)).count() == 0


def test_transactions_done_twice_are_read_once(spark, tmp_path):
    listed = spark.createDataFrame([manifest(i) for i in range(8)], LISTED)
    entries = compaction.single_entries(
        spark.createDataFrame([(k, f"s3://b/{k % 8}", at(0)) for k in range(40)], ENTRIES)
    )
    w = compaction.ManifestCompaction(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    todo = w.log.begin(
        compaction.plan(w._items(listed, None), w.log.group.names, "item", "size", F.col("small"), w.policy), "item"
    ).collect()
    final = todo[0].final
    for run in ("aa", "bb"):  # two runs finish the same transaction
        entries.withColumn("output", F.lit(final)).write.parquet(f"file://{tmp_path}/out/run-{run}")
        w.log.commit(spark.createDataFrame([(final, run)], "final string, folder string"))
    assert sorted(r.entry_id for r in w.entries(entries).collect()) == list(range(40))


def test_new_manifests_and_late_entries_join_later_rounds(spark, tmp_path):
    w = compaction.ManifestCompaction(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    rows, listed = [(k, f"s3://b/{k % 8}", at(0)) for k in range(40)], [manifest(i) for i in range(8)]
    frame = lambda: (
        compaction.single_entries(spark.createDataFrame(rows, ENTRIES)), spark.createDataFrame(listed, LISTED)
    )
    assert w.run(*frame())
    rows += [(100 + k, f"s3://b/{k}", at(9)) for k in range(3)]  # late, for manifests already taken
    listed.append(manifest(8))
    rows += [(200, "s3://b/8", at(9))]
    check = lambda: sorted(r.entry_id for r in w.entries(frame()[0]).collect()) == sorted({r[0] for r in rows})
    assert check() and not w.run(*frame())  # an output, three late parts and a new manifest: too few
    listed.append(manifest(9))
    rows += [(201, "s3://b/9", at(9))]
    assert w.run(*frame()) and check()
    assert len({r.output for r in w.entries(frame()[0]).collect()}) == 1
    assert not w.run(*frame())


def test_failed_round_is_finished(spark, tmp_path):
    listed = spark.createDataFrame([manifest(i) for i in range(8)], LISTED)
    entries = compaction.single_entries(
        spark.createDataFrame([(k, f"s3://b/{k % 8}", at(0)) for k in range(40)], ENTRIES)
    )
    w = compaction.ManifestCompaction(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    w.log.begin(  # and no more
        compaction.plan(w._items(listed, None), w.log.group.names, "item", "size", F.col("small"), w.policy), "item"
    )
    assert sorted(
        r.output for r in w.entries(entries).select("output").distinct().collect()
    ) == [f"s3://b/{i}" for i in range(8)]
    assert w.run(entries, listed) and len({r.output for r in w.entries(entries).collect()}) == 1


def test_real_files_are_merged_once_even_after_a_failure(spark, tmp_path):
    src, dst, log = (f"file://{tmp_path}/{n}" for n in ("src", "dst", "log"))
    policy = compaction.Policy(target=1 << 20)
    ids = lambda files: sorted(r.id for r in spark.read.parquet(*(f.path for f in files)).select("id").collect())
    spark.range(1000).withColumn("txn", F.lit("clash")).repartition(40).write.parquet(src)
    spark.range(1000, 1100).withColumn("txn", F.lit("clash")).repartition(5).write.parquet(f"{src}/day=1")
    assert compaction.list_files(spark, src).count() == 45 and compaction.list_files(spark, src + "/none").count() == 0
    for _ in range(2):
        left = compaction.compact_parquet(spark, src, dst, log, policy).collect()
        assert len(left) == 1 and ids(left) == list(range(1100))
    # A run that failed before its commit: what it wrote is never read, what it recorded is done by the next.
    spark.range(2000, 2100).withColumn("txn", F.lit("clash")).repartition(10).write.mode("append").parquet(src)
    j = compaction.CompactionJournal(spark, log, compaction.FILE_GROUP)
    fresh = compaction.list_files(spark, src).join(
        j.taken().withColumnRenamed("input", "path"), "path", "left_anti"
    ).withColumn("source", F.lit(src))
    assert j.begin(compaction.plan(fresh, ["source"], "path", "length", F.lit(True), policy), "path").count() == 10
    spark.range(5).withColumn("txn", F.lit("dead")).write.parquet(f"{dst}/run-dead")
    for k in range(1, 4):
        left = compaction.compact_parquet(spark, src, dst, log, policy).collect()
        assert ids(left) == [*range(1100), *range(2000, 2000 + 100 * k)] and len(left) <= 4
        spark.range(
            2000 + 100 * k, 2100 + 100 * k
        ).withColumn("txn", F.lit("clash")).repartition(20).write.mode("append").parquet(src)
    spark.range(1, 2).coalesce(1).write.parquet(f"file://{tmp_path}/big")
    assert compaction.compact_parquet(spark, f"file://{tmp_path}/big", dst + "2", log + "2", policy).count() == 1


# Hierarchies


def brute_forest(links):
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = max((x for x in (parent.get(n), p) if x is not None), default=None)
    parent = {n: p if p in parent else None for n, p in parent.items()}
    out = set()
    for n in parent:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is None:
            out.add((n, parent[n], seen[-1], len(seen) - 1))
        else:
            out.add((n, parent[n], min(seen[seen.index(x):]), -1))
    return out


@pytest.mark.parametrize("most", [10_000, 40, 7])
def test_forest(spark, most):
    rnd = random.Random(most)
    links = [(i, i - 1 if i % 97 else None) for i in range(1, 300)] + [
        (1000 + i, 1000 + (i + 1) % 30) for i in range(30)
    ] + [(2000 + i, rnd.choice([1000, 5, 2000 + max(0, i - 3), 99999, None])) for i in range(1, 100)]
    links += [(5000, 5000), (None, 3), (7, 6), (7, 6)] + [(6000 + i, 50) for i in range(60)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "n bigint, p bigint").withColumn("node", F.lit(0))
    got = {tuple(r) for r in hierarchy.forest(df, "n", "p", ["p"] if most == 7 else None, most=most).collect()}
    assert got == brute_forest(links)


def test_forest_empty(spark):
    assert hierarchy.forest(spark.createDataFrame([], "n bigint, p bigint"), "n", "p").count() == 0


def test_unite_long_chain_and_loop():
    n = 5000
    node = np.random.default_rng(1).permutation(n)
    to = np.where(node == n - 1, 2500, node + 1)
    top, dist, low, kind = hierarchy.unite(node, to, np.ones(n, np.int64), node.copy(), np.zeros(n, np.int32))
    assert set(top) == {2500} and set(kind) == {hierarchy.LOOP} and set(dist) == {-1}
    to = np.where(node == n - 1, 10**9, node + 1)
    top, dist, low, kind = hierarchy.unite(node, to, np.ones(n, np.int64), node.copy(), np.zeros(n, np.int32))
    assert set(top) == {10**9} and (dist == n - node).all() and (low == node).all() and set(kind) == {hierarchy.OPEN}


@pytest.mark.parametrize("step", [1, 7919])
def test_forest_without_locality(spark, step):
    n = 3000  # a long chain and a long loop whose neighbours lie far apart
    links = [((i * step) % 3001, ((i - 1) * step) % 3001 if i > 1 else None) for i in range(1, 3001)]
    links += [(10_000 + (i * step) % 997, 10_000 + ((i + 1) * step) % 997) for i in range(997)] + [(20_000, 10_005)]
    got = {
        tuple(r) for r in hierarchy.forest(
            spark.createDataFrame(links, "n bigint, p bigint"), "n", "p", most=200
        ).collect()
    }
    assert len(got) == n + 998 and got == brute_forest(links)


def test_loops_are_cut_above_their_smallest_id(spark):
    links = [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4), (6, None), (7, 6), (8, 8)]
    trees = hierarchy.cut_loops(hierarchy.forest(spark.createDataFrame(links, "n bigint, p bigint"), "n", "p"))
    paths = {r.node: r.path for r in hierarchy.full_paths(trees, trees.select("node")).collect()}
    assert paths == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 5: [1, 2, 3, 4, 5], 6: [6], 7: [6, 7], 8: [8]}
    assert {r.node for r in trees.where("looped").collect()} == {1, 2, 3, 4, 5, 8}


@pytest.mark.parametrize("length", [4, 256])
def test_paths_and_descendants(spark, length):
    links = [
        (1, None), *((i, i - 1) for i in range(2, 200)), *((1000 + i, 150) for i in range(5)), (2000, None),
        (3000, 3001), (3001, 3000), (3002, 3000)
    ]
    trees = hierarchy.forest(spark.createDataFrame(links, "n bigint, p bigint"), "n", "p")
    assert max(len(r.segment) for r in hierarchy.path_segments(trees, length).collect()) <= length
    want = {
        1: [1], 2: [1, 2], 40: list(range(1, 41)), 199: list(range(1, 200)), 1003: [*range(1, 151), 1003], 2000: [2000],
        3000: [3000]
    }
    asked = spark.createDataFrame([(k,) for k in [*want, 40, 77777]], "node bigint")
    assert {r.node: r.path for r in hierarchy.full_paths(trees, asked, length).collect()} == want
    down = {}
    for r in hierarchy.descendants(
        trees, spark.createDataFrame([(1,), (148,), (199,), (2000,), (3000,), (1,)], "node bigint"), length
    ).collect():
        assert r.node not in down.setdefault(r.ancestor, set())
        down[r.ancestor].add(r.node)
    assert down == {1: set(range(2, 200)) | set(range(1000, 1005)), 148: set(range(149, 200)) | set(range(1000, 1005))}
    sizes = {r.node: r.descendants for r in hierarchy.subtree_sizes(trees, length).collect()}
    assert sizes == {
        i: 199 - i + (5 if i <= 150 else 0) for i in range(1, 200)
    } | dict.fromkeys([*range(1000, 1005), 2000, 3000, 3001, 3002], 0)


def test_whole_paths_and_descendants_of_every_snapshot(spark, tmp_path):
    n = 150  # a history longer than two segments, a loop and a snapshot below it; no id but 100 is divisible by 100
    links = [*((i, i - 1 if i > 1 else None) for i in range(1, n + 1)), (1001, 1002), (1002, 1001), (1003, 1002)]
    rows = [(str(k), None if up is None else str(up), 1, str(i)) for i, (k, up) in enumerate(links)]
    spark.createDataFrame(
        rows, "snapshot_id string, parent_snapshot_id string, table_id bigint, sequence_number string"
    ).write.parquet(f"{tmp_path}/manifest_lists.parquet")
    paths = {k: ",".join(map(str, range(1, k + 1))) for k in range(1, n + 1)} | {k: str(k) for k in (1001, 1002, 1003)}
    assert sorted(map(tuple, queries.QUERIES["p3_all_paths"](spark, str(tmp_path)).collect())) == sorted(paths.items())
    below = [(a, k) for a in range(1, n + 1) for k in range(a + 1, n + 1)]
    assert sorted(map(tuple, queries.QUERIES["p3_all_below"](spark, str(tmp_path)).collect())) == below


# Incremental


def test_ranges_cover_exactly(spark):
    rnd = random.Random(5)
    runs = [
        (
            rnd.choice([1, 2]), rnd.choice([None, rnd.randrange(60), -5]), rnd.randrange(70), at(rnd.randrange(50))
        ) for _ in range(40)
    ] + [(3, None, (1 << 62) + 5, at(1)), (3, 9, 9, at(40)), (3, 9, None, at(40))]
    offs = [(t, s) for t in (1, 2, 3) for s in [*range(75), 1 << 50]]
    got = {
        (r.table_id, r.sequence_number): r.read_at for r in incremental.read_until(
            spark.createDataFrame(offs, "table_id bigint, sequence_number bigint"),
            spark.createDataFrame(runs, "table_id bigint, lo bigint, hi bigint, read_at timestamp_ntz")
        ).collect()
    }
    want = {}
    for t, s in offs:
        hits = [r for k, lo, hi, r in runs if k == t and hi is not None and (lo is None or lo < s) and s <= hi]
        if hits:
            want[t, s] = max(hits)
    assert got == want


def test_unread(spark):
    heads = spark.createDataFrame(
        [("10", None, 1, "1"), ("20", "10", 1, "2"), ("30", "20", 1, "3")],
        "snapshot_id string, parent_snapshot_id string, table_id bigint, sequence_number string"
    )
    listed = spark.createDataFrame(
        [("s3://b/m", 2, 20)], "manifest_path string, sequence_number bigint, added_snapshot_id bigint"
    )
    entries = spark.createDataFrame(
        [
            (1, 1, "s3://b/x", 10, 1, at(1)), (2, 1, "s3a://b//m", None, None, at(1)),
            (2, 1, "s3a://b//m", None, None, at(9)), (3, 1, "s3://b/x", 30, 3, at(1)), (4, 1, "s3://b/x", 10, 1, at(6)),
            (5, 1, "?", None, None, at(0)), (6, 2, "s3://b/x", 1, 1, at(0)), (None, 1, "s3://b/x", 1, 1, at(0))
        ],
        "entry_id bigint, table_id bigint, manifest_path string, snapshot_id bigint, sequence_number bigint, arrived_at timestamp_ntz",
    ).withColumn("_path", F.lit(0))
    log = spark.createDataFrame(
        [
            (1, None, 20, at(5), " SUCCEEDED "), (1, 20, 30, at(5), "failed"), (1, 77, 30, at(50), "succeeded"),
            (1, 20, 30, at(50), None), (1, None, 20, at(5), "succeeded")
        ],
        "table_id bigint, start_snapshot_id bigint, end_snapshot_id bigint, read_at timestamp_ntz, outcome string"
    )
    assert sorted(r.entry_id for r in incremental.unread(entries, listed, heads, log).collect()) == [3, 4, 5, 6]
    assert sorted(
        r.entry_id for r in incremental.unread_entries(spark, entries, listed, heads, log).collect()
    ) == [3, 4, 5, 6]
    assert sorted(
        r.entry_id for r in incremental.unread_entries(spark, entries, listed, heads, log.limit(0)).collect()
    ) == [1, 2, 3, 4, 5, 6]
    assert incremental.unread_entries(spark, entries.limit(0), listed, heads, log).count() == 0
    assert sorted(
        r.entry_id for r in incremental.unread(entries, listed, heads, log.limit(0)).collect()
    ) == [1, 2, 3, 4, 5, 6]


LOG = "p string, o bigint, k string"


def test_reader_replays_and_skips_nothing(spark, tmp_path):
    rows = [(p, o, f"{p}-{o}") for p in ("a", "b") for o in range(5)]
    state = f"file://{tmp_path}/state"
    make = lambda n: incremental.IncrementalReader(
        spark, lambda: spark.createDataFrame([r for r in rows if r[1] < n], LOG), state, "p", "o", "k", fold=2
    )
    assert make(2).run() == 0
    with pytest.raises(Exception, match="boom"):
        make(4).run(lambda d: d.withColumn("k", F.raise_error(F.lit("boom"))))
    assert make(5).run() == 1  # the plan of the failed run, as it was
    assert make(5).sink().count() == 8
    assert make(5).run() == 2
    assert make(5).run() is None
    assert sorted(r.k for r in make(5).sink().collect()) == sorted(r[2] for r in rows)
    assert incremental.IncrementalReader(
        spark, spark.createDataFrame([], LOG), state + "2", "p", "o", "k"
    ).run() is None


def test_reader_delivers_late_repeated_and_unplaced_records(spark, tmp_path):
    rows, state = [("a", 1, "k1"), ("a", 2, "k2"), ("a", 1, "k1"), (None, 7, "nowhere")], f"file://{tmp_path}/state"
    make = lambda: incremental.IncrementalReader(
        spark, spark.createDataFrame(rows, LOG).withColumn("_n", F.lit(0)), state, "p", "o", "k", fold=2
    )
    keys = lambda: sorted(r.k for r in make().sink().collect())
    assert make().run() == 0 and make().run() is None and keys() == ["k1", "k2", "nowhere"]
    rows += [("a", 2, "late"), ("a", 3, "k3"), ("b", None, "no offset"), ("a", 2, "late")]
    assert make().run() == 1 and make().run() is None
    for n in range(2, 6):
        rows.append(("a", 0, f"earlier {n}"))
        assert make().run() == n
    assert make().run() is None and keys() == sorted({r[2] for r in rows})


def test_reader_starts_where_others_left_off(spark, tmp_path):
    rows = [
        ("a", 1, "old", at(1)), ("a", 1, "late", at(9)), ("a", 5, "new", at(1)), ("a", 2, "unknown", None),
        ("b", 1, "other", at(1))
    ]
    log = spark.createDataFrame(rows, LOG + ", t timestamp_ntz")
    r = incremental.IncrementalReader(spark, log, f"file://{tmp_path}/state", "p", "o", "k", "t")
    r.seed(spark.createDataFrame([("a", None, 3, at(5))], "p string, lo bigint, hi bigint, read_at timestamp_ntz"))
    assert r.run() == 0 and r.run() is None
    assert sorted(x.k for x in r.sink().collect()) == ["late", "new", "other", "unknown"]


# Orphans


def test_orphans_against_brute_force(spark):
    rnd = random.Random(6)
    parents = [(k, None if k % 3 else at(k % 7)) for k in range(50)] + [(51, at(1)), (51, None), (None, at(0))]
    refs = [
        (
            rnd.choice([1, 2, None]), rnd.choice([None, *range(60)]), rnd.choice([at(rnd.randrange(9)), None]), "x"
        ) for _ in range(500)
    ]
    got = orphans.orphans(
        spark.createDataFrame(refs, "t int, k int, w timestamp_ntz, since string"),
        spark.createDataFrame(parents, "k int, gone timestamp_ntz"), ["t"], ["k"], "w", "gone"
    )
    alive = {}
    for k, g in parents:
        if k is not None:
            alive[k] = max(alive.get(k, dt.datetime.min), g or dt.datetime.max)
    want = {}
    for t, k, w, _ in refs:
        if k is not None and (k not in alive or (w is not None and alive[k] <= w)):
            old = want.get((t, k))
            want[t, k] = min(x for x in (old, w) if x is not None) if (old or w) else None
    assert {(r.t, r.k): r.since for r in got.collect()} == want


def test_orphans_without_parents_and_without_references(spark):
    refs, parents = spark.createDataFrame(
        [(1, 5, at(0))], "t int, k int, w timestamp_ntz"
    ), spark.createDataFrame([], "k int, gone timestamp_ntz")
    assert [tuple(r) for r in orphans.orphans(refs, parents, ["t"], ["k"], "w", "gone").collect()] == [(1, 5, at(0))]
    assert orphans.orphans(refs.limit(0), parents, ["t"], ["k"], "w").count() == 0


FULL_FILTERS = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
from quern.operators import orphans

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2"
).config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
refs = spark.range(1000).selectExpr("1 as t", "id as k", "timestamp_ntz'2024-01-01' as w")
parents = spark.range(0, 1000, 2).selectExpr("id as k", "cast(null as timestamp_ntz) as gone")
got = orphans.orphans(refs.unionByName(refs), parents, ["t"], ["k"], "w", "gone", 40_000_000)
print("found", sorted(r.k for r in got.collect()) == list(range(1, 1000, 2)))
"""


def test_orphans_with_filters_at_their_bound_fit_a_small_driver(tmp_path):
    # 64 MiB of filters, as tens of millions of parents have them, in a heap of 450 MB
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 450m pyspark-shell"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run(
        [sys.executable, "-c", FULL_FILTERS, root, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300
    )
    assert "found True" in ran.stdout, ran.stderr[-2000:]


# Drift


S0 = '{"type":"struct","schema-id":0,"fields":[{"id":1,"name":"a","required":true,"type":"int"},{"id":2,"name":"m","type":{"type":"map","key-id":3,"key":"string","value-id":4,"value":"decimal(9, 2)"}},{"id":5,"name":"gone","type":"date"}]}'
S1 = '{"fields":[{"type":"long","id":1,"name":"A"},{"id":2,"name":"m","type":{"type":"map","key-id":3,"key":"string","value-id":4,"value":"decimal(9,2)"}},{"id":6,"name":"l","type":{"type":"list","element-id":7,"element":{"type":"struct","fields":[{"id":8,"name":"x","type":"int"}]}}}]}'


def manifests(spark):
    return spark.createDataFrame(
        [
            ("s3://b/0", 1, S0, "0"), ("s3a://b//0", 1, S0, None), ("s3://b/1", 1, S1, " 1"),
            ("s3://b/bad", 1, S1[:50], "2"), ("s3://b/none", 1, None, "3"), ("s3://b/noid", 1, S1, None),
            ("s3://b/t2", 2, S0, "x"), ("s3://b/arr", 3, "[1]", "0"), ("s3://b/odd", 3, '{"fields":[{"id":1}]}', "1"),
            ("s3://b/0", None, S0, "0")
        ],
        "manifest_path string, table_id bigint, schema string, schema_id string",
    )


def test_changes_of_fields(spark):
    got = sorted(tuple(r) for r in drift.changes(manifests(spark)).collect())
    assert got == [
        (1, 0, 1, 1, "renamed"), (1, 0, 1, 1, "retyped"), (1, 0, 1, 5, "removed"), (1, 0, 1, 6, "added"),
        (1, 0, 1, 7, "added"), (1, 0, 1, 8, "added")
    ]
    assert drift.changes(manifests(spark).limit(0)).count() == 0


def test_unreadable_schemas_are_reported(spark):
    bad = {(r.table_id, r.header_id): (r.failed, r.files) for r in drift.unreadable_schemas(manifests(spark)).collect()}
    assert bad == {(1, 2): (["$"], 1), (1, 3): (["$"], 1), (3, 0): (["$"], 1), (3, 1): (["fields[0]"], 1)}
    inner = [
        ('{"fields":[{"id":1,"name":"a","type":{"type":"list","element":"int"}}]}', ["fields[0].type"]),
        ('{"fields":[{"id":"x","name":"a","type":"int"}]}', ["fields[0]"]), ('{"fields":[]}', []),
        ('{"fields":[{"id":1,"name":"a","type":"int","doc":{"id":[1]}}]}', [])
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(inner)], "header_id bigint, schema string")
    assert [r.failed for r in drift.schema_documents(df).orderBy("header_id").collect()] == [f for _, f in inner]


def test_path_values_keep_json_types(spark):
    text = '{"a.b":"123","n":123,"x":1.50,"t":true,"z":null,"l":[1,"2",{"y":[]}],"e":{}}'
    rows = spark.createDataFrame(
        [("m", 0, text), ("m", 0, text), ("m", 1, "[1]"), ("m", 2, None), ("m", 3, "{")],
        "manifest_path string, row_pos int, payload string"
    )
    got = {r.row_pos: r["values"] for r in drift.path_values(rows).collect()}
    assert {k: tuple(v) for k, v in got[0].items()} == {
        "a\\.b": ("string", "123"), "n": ("integer", "123"), "x": ("number", "1.50"), "t": ("boolean", "true"),
        "z": ("null", None), "l": ("array", None), "l[0]": ("integer", "1"), "l[1]": ("string", "2"),
        "l[2]": ("object", None), "l[2].y": ("array", None), "e": ("object", None)
    }
    assert got[1] is None and got[2] is None and got[3] is None
    stats = {(r.path, r.raw_type): r.n for r in drift.path_statistics(rows).collect()}
    assert stats["l[]", "integer"] == 1 and stats["l[]", "string"] == 1 and stats["a\\.b", "string"] == 1


def test_consistent_rows(spark):
    rows = spark.createDataFrame(
        [
            ("s3://b/0", 0, '{"a": 5, "gone": "2020-01-02"}'), ("s3://b/0", 0, '{"a": 5, "gone": "2020-01-02"}'),
            ("s3://b/1", 1, '{"A": "many"}'), ("s3://b/1", 2, "not json"), ("s3://b/1", 3, None),
            ("s3://b/bad", 4, '{"q": "1"}')
        ],
        "manifest_path string, row_pos int, payload string"
    ).withColumn("values", F.lit(1))
    got = {r.row_pos: r for r in drift.consistent_rows(rows, manifests(spark)).collect()}
    assert len(got) == 5
    assert got[0]["values"] == {"A": "5", "m": None, "gone#5": "2020-01-02", "l": None} and got[0].failed == []
    assert got[1]["values"]["A"] is None and [tuple(f) for f in got[1].failed] == [("A", "long", "string", "many")]
    assert got[2]["values"]["A"] is None and got[3].failed == []
    assert got[4]["values"] == {"q": "1"}
    t = drift.typed_table(drift.consistent_rows(rows, manifests(spark)), manifests(spark), 1)
    assert t.schema["A"].dataType.simpleString() == "bigint" and sorted(r.A for r in t.collect() if r.A) == [5]
    assert drift.consistent_rows(
        rows.limit(0), manifests(spark)
    ).count() == 0 and drift.consistent_rows(rows, manifests(spark).limit(0)).count() == 5


def test_nested_fields_follow_their_ids(spark):
    def doc(*fields):
        return json.dumps(
            {
                "fields": [
                    {
                        "id": 1, "name": "s",
                        "type": {"type": "struct", "fields": [{"id": i, "name": n, "type": k} for i, n, k in fields]}
                    },
                    {
                        "id": 9, "name": "m",
                        "type": {
                            "type": "map", "key-id": 10, "key": "int", "value-id": 11,
                            "value": {"type": "list", "element-id": 12, "element": fields[0][2]}
                        }
                    }
                ]
            }
        )

    old, new = doc((2, "weight", "int"), (3, "flag", "string"), (4, "gone", "string")), doc(
        (2, "flag", "decimal(20,15)"), (3, "weight", "string"), (5, "more", "date")
    )
    m = spark.createDataFrame(
        [("s3://b/0", 1, old, "0"), ("s3://b/1", 1, new, "1")],
        "manifest_path string, table_id bigint, schema string, schema_id string"
    )
    rows = spark.createDataFrame(
        [
            ("s3://b/0", 0, '{"s":{"weight":7,"flag":"f","gone":"g"},"m":{"1":[1,2],"x":[null]}}'),
            ("s3://b/1", 1, '{"s":{"flag":0.123456789012345},"m":{}}'),
            ("s3://b/1", 2, '{"s":{"flag":99999,"more":"2020-02-30"}}'), ("s3://b/1", 3, '{"s":5}')
        ],
        "manifest_path string, row_pos int, payload string",
    )
    c = drift.consistent_rows(rows, m)
    got = {r.row_pos: r for r in c.collect()}
    assert got[0]["values"] == {
        "s.flag": "7.000000000000000", "s.weight": "f", "s.gone#4": "g", "s.more": None, "m{1}[0]": "1.000000000000000",
        "m{1}[1]": "2.000000000000000", "m{x}[0]": None
    }
    assert [tuple(f) for f in got[0].failed] == [("m{x}", "int", "string", "x")]
    assert got[1]["values"]["s.flag"] == "0.123456789012345"
    assert got[2]["values"]["s.flag"] == "99999.000000000000000" and [f.path for f in got[2].failed] == ["s.more"]
    assert [tuple(f) for f in got[3].failed] == [("s", "struct", "integer", "5")]
    t = {r._row_pos: r for r in drift.typed_table(c, m, 1).collect()}
    assert t[0].s.flag == 7 and t[0].s.weight == "f" and t[0].m["1"][1] == 2 and t[2].s.more is None
    assert {
        (r.path, r.type, r.n) for r in drift.failed_casts(c).collect()
    } == {("m{}", "int", 1), ("s.more", "date", 1), ("s", "struct", 1)}


def test_decimals_keep_their_scale_or_fail(spark):
    cases = [
        ("12.345", "decimal(5,2)", None), ("12.3400", "decimal(5,2)", "12.34"), ("99999", "decimal(3,0)", None),
        ("-0.00", "decimal(3,1)", "0.0"), ("1e2", "decimal(3,0)", "100"), ("-999", "decimal(3,0)", "-999"),
        ("abc", "decimal(3,0)", None), ("9" * 38, "decimal(38,0)", "9" * 38), (None, "decimal(3,0)", None)
    ]
    df = spark.createDataFrame([(v, k) for v, k, _ in cases], "v string, k string")
    assert [r[0] for r in df.select(drift._casts(F.col("v"), F.col("k"))).collect()] == [w for _, _, w in cases]


@pytest.mark.parametrize("partial", [False, True])
def test_changes_carry_maps(spark, partial):
    rows = [
        (1, 1, {1: 5}, False), (1, 70, {2: 6, 3: 7}, False), (1, 70, {3: 7, 2: 6}, False), (2, 3, {1: 1}, False),
        (2, 4, None, True), (3, 2, {9: 9}, False), (3, 2, {8: 8}, False)
    ]
    df = spark.createDataFrame(rows, "k int, n bigint, m map<int,bigint>, gone boolean")
    got = [
        {
            r.k: r.m for r in changefeed.compose(
                d, ["k"], "n", F.col("gone"), ["m"], partial
            ).where("not _deleted").collect()
        } for d in (df, df.orderBy(F.desc("n")).coalesce(1))
    ]
    assert got[0] == got[1] and set(got[0]) == {1, 3} and got[0][1] == {2: 6, 3: 7}


SF = "/root/testdata/sf0.001"


def test_current_files_have_every_field(spark):
    from quern import queries

    full, two = queries.p2_files(spark, SF), queries.p2_current(spark, SF)
    fields = set(
        spark.read.parquet(f"{SF}/manifest_entries.parquet").schema["data_file"].dataType.names
    ) - {"file_path"}
    assert set(full.columns) == {"table_id", "file_path", "sequence_number"} | fields
    assert sorted(map(str, full.select(two.columns).collect())) == sorted(map(str, two.collect()))
    assert full.where("lower_bounds is not null and column_sizes is not null").count() > 0


def brute_layout(value, own, latest, path=""):
    """(path, raw value) of the leaves of ``value``, laid out from one schema type to another by plain recursion."""
    kind = lambda t: t if isinstance(t, str) else t["type"]
    if latest is None:
        latest = own
    if value is None or isinstance(own, str) or isinstance(latest, str) or kind(own) != kind(latest):
        return [(path, value)]
    if kind(own) == "struct" and isinstance(value, dict):
        out, now = [], {f["id"]: f for f in latest["fields"]}
        for f in own["fields"]:
            g = now.get(f["id"])
            name = g["name"] if g else f"{f['name']}#{f['id']}"
            at = f"{path}.{name}" if path else name
            out += brute_layout(value.get(f["name"]), f["type"], g["type"] if g else None, at)
        have = {f["id"] for f in own["fields"]}
        return out + [(f"{path}.{f['name']}" if path else f["name"], None) for i, f in now.items() if i not in have]
    if kind(own) == "list" and isinstance(value, list):
        return [x for i, v in enumerate(value) for x in brute_layout(v, own["element"], latest["element"], f"{path}[{i}]")]
    if kind(own) == "map" and isinstance(value, dict):
        return [x for k, v in value.items() for x in brute_layout(v, own["value"], latest["value"], f"{path}{{{k}}}")]
    return [(path, value)]


def test_rows_of_the_test_data_are_laid_out_as_by_hand(spark):
    m, rows = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("manifests", "file_rows"))
    texts = {}
    for r in drift.schema_documents(drift.schema_texts(m)).where("size(failed) = 0 and schema_id is not null").collect():
        texts[r.table_id, r.schema_id] = min(texts.get((r.table_id, r.schema_id), r.schema), r.schema)
    last = {t: texts[t, max(s for u, s in texts if u == t)] for t, _ in texts}
    at = {
        r.p: (r.t, r.s) for r in m.groupBy(location("manifest_path").alias("p")).agg(
            F.max("table_id").alias("t"), F.max(F.coalesce(number("schema_id"), F.get_json_object("schema", "$.schema-id").try_cast("bigint"))).alias("s")
        ).collect()
    }
    payload = {}
    for r in rows.select(location("manifest_path").alias("p"), "row_pos", "payload").collect():
        payload.setdefault((r.p, r.row_pos), []).append(r.payload)
    seen = 0
    for r in drift.consistent_rows(rows, m).collect():
        texts_here = set(payload[r.manifest_path, r.row_pos])
        if at.get(r.manifest_path) not in texts or len(texts_here) > 1:
            continue
        own, latest = (json.loads(x) | {"type": "struct"} for x in (texts[at[r.manifest_path]], last[r.table_id]))
        try:
            value = json.loads(texts_here.pop())
        except (TypeError, ValueError):
            value = {}
        want = dict(brute_layout(value if isinstance(value, dict) else {}, own, latest))
        failed = {f.path for f in r.failed}
        assert set(r["values"]) == set(want)
        for path, raw in want.items():
            assert (r["values"][path] is None) == (raw is None or path in failed), path
            if isinstance(raw, str) and r["values"][path] is not None:
                assert r["values"][path].replace(" ", "T")[:10] == raw.replace(" ", "T")[:10], path
        seen += 1
    assert seen > 40
