"""The pN_ queries of the core problems, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import changefeed, compaction, drift, hierarchy, incremental, orphans
from quern.operators.snapshot_tables import headers
from quern.session import fresh_dir, materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The manifests that the journal of a compaction names as inputs, once it is written ahead."""
    return compaction.recorded_manifests(
        spark, table(spark, sf, "manifest_list_entries")
    ).select("table_id", "manifest_path")


def p1_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What each table's manifests hold after compaction in three rounds: over the first half of the time, over all of
    it, and once more with nothing to do."""
    listed = table(spark, sf, "manifest_list_entries")
    fields = table(spark, sf, "manifest_entries").select(
        "entry_id", "table_id", "manifest_path", "arrived_at", F.col("data_file.record_count").alias("record_count")
    )
    entries = materialise(compaction.single_entries(fields), "entries")
    low, high = listed.agg(F.min("written_at"), F.max("written_at")).first()
    work = compaction.ManifestCompaction(spark, fresh_dir(spark, "manifests"), fresh_dir(spark, "journal"))
    if low is not None:
        half = F.lit(low + (high - low) / 2)
        work.run(entries.where(F.col("arrived_at") <= half), listed.where(F.col("written_at") <= half))
    for _ in range(2):
        work.run(entries, listed)
    return work.entries(entries).groupBy("table_id").agg(
        F.count("*").alias("entries"), F.sum("record_count").alias("records")
    )


def p1_files(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of stored_files, written as many small files that arrive in two lots, each followed by a compaction, as
    the live files then hold them."""
    rows = table(spark, sf, "stored_files").select("file_path", "size_in_bytes")
    at, to, log = (fresh_dir(spark, n) for n in ("small", "merged", "journal"))
    policy = compaction.Policy(target=16 << 20)
    for lot in (0, 1):
        rows.where(
            F.pmod(F.hash("file_path"), F.lit(2)) == lot
        ).repartition(24, "file_path").write.mode("append").parquet(at)
        files = compaction.compact_parquet(spark, at, to, log, policy)
    return spark.read.schema(rows.schema).parquet(*(r.path for r in files.select("path").collect()))  # as many as the merged files


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.current_files(table(spark, sf, "manifest_entries"), table(spark, sf, "manifest_list_entries"))


def p2_current(spark: SparkSession, sf: str) -> DataFrame:
    """The current files with the two values that the SQL has; ``p2_files`` has all."""
    return changefeed.current_files(
        table(spark, sf, "manifest_entries"), table(spark, sf, "manifest_list_entries"),
        ["record_count", "file_size_in_bytes"]
    )


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    """The current files with every field of their data_file. At equal numbers the values that ``p2_current`` compares
    come first."""
    e = table(spark, sf, "manifest_entries")
    first = ["record_count", "file_size_in_bytes"]
    return changefeed.current_files(
        e, table(spark, sf, "manifest_list_entries"),
        [*first, *(n for n in e.schema["data_file"].dataType.names if n not in ("file_path", *first))]
    )


def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    """``p2_files`` with maps, arrays and binary values as text, so that results compare."""
    f = p2_files(spark, sf)

    def text(c: T.StructField) -> Column:
        x, kind = F.col(c.name), c.dataType
        if isinstance(kind, T.MapType):
            plain = F.hex if isinstance(kind.valueType, T.BinaryType) else lambda v: v.cast("string")
            x = F.array_join(
                F.array_sort(
                    F.transform(
                        F.map_entries(x), lambda e: F.concat(e["key"].cast("string"), F.lit("="), plain(e["value"]))
                    )
                ),
                ","
            )
        elif isinstance(kind, T.ArrayType):
            x = F.array_join(x.cast("array<string>"), ",")
        elif isinstance(kind, T.BinaryType):
            x = F.hex(x)
        return x.alias(c.name)

    return f.select(*map(text, f.schema))


def p2_increments(spark: SparkSession, sf: str) -> DataFrame:
    """The same files, from the patches of the first half of the numbers, kept, and those of all entries from a table's
    last eighth on, which repeats some."""
    values = ["record_count", "file_size_in_bytes"]
    c = changefeed.file_changes(table(spark, sf, "manifest_entries"), table(spark, sf, "manifest_list_entries"), values)
    top = c.agg(F.max("sequence_number")).first()[0] or 0
    some = lambda rows: changefeed.patches(rows, changefeed.FILE_KEYS, "sequence_number", F.col("status") == 2, values)
    kept = materialise(some(c.where(F.col("sequence_number") <= top // 2)), "patches")
    late = some(c.where(F.col("sequence_number") > top // 2 - top // 8))
    both = changefeed.combine([late, kept], changefeed.FILE_KEYS)
    got = changefeed.apply_patches(
        changefeed.no_files(c, values), both, changefeed.FILE_KEYS, values, position="sequence_number"
    )
    return got.select(*changefeed.FILE_KEYS, "sequence_number", *values)


def p2_on_base(spark: SparkSession, sf: str) -> DataFrame:
    """The same files, from a base that holds what was added up to the middle number, with all changes applied to it:
    those that the base has seen change nothing."""
    values = ["record_count", "file_size_in_bytes"]
    e, listed = table(spark, sf, "manifest_entries"), table(spark, sf, "manifest_list_entries")
    top = e.agg(F.max("sequence_number")).first()[0] or 0
    base = materialise(changefeed.current_files(e.where(F.col("sequence_number") <= top // 2), listed, values), "base")
    return changefeed.current_files(e, listed, values, base)


def p2_partial(spark: SparkSession, sf: str) -> DataFrame:
    """The files where a null value leaves what an earlier change has set since the last deletion."""
    return changefeed.current_files(
        table(spark, sf, "manifest_entries"), table(spark, sf, "manifest_list_entries"),
        ["record_count", "file_size_in_bytes"], partial=True
    )


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.forest(
        headers(table(spark, sf, "manifest_lists")), "snapshot_id", "parent_snapshot_id",
        ["table_id", "sequence_number"]
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _trees(spark, sf).select(
        F.col("node").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), "depth"
    )


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every snapshot's path, in segments that its anchor carries on; loops are cut above their smallest id."""
    trees = materialise(hierarchy.cut_loops(_trees(spark, sf)), "cut")
    s = hierarchy.path_segments(trees).join(trees.select("node", "looped"), "node")
    return s.select(
        F.col("node").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), "depth", "looped",
        F.col("anchor").alias("anchor_snapshot_id"), F.array_join("segment", ",").alias("segment")
    )


def _asked(trees: DataFrame) -> DataFrame:
    """The snapshots that ``p3_full_paths`` and ``p3_below`` are asked for, as their SQL has them; ``p3_all_paths`` and
    ``p3_all_below`` give those of every snapshot."""
    return trees.where("node % 100 = 0").select("node")


def _full_paths(trees: DataFrame, asked: DataFrame) -> DataFrame:
    return hierarchy.full_paths(trees, asked).select(
        F.col("node").alias("snapshot_id"), F.array_join("path", ",").alias("path")
    )


def _below(trees: DataFrame, asked: DataFrame) -> DataFrame:
    return hierarchy.descendants(trees, asked).select(
        F.col("ancestor").alias("snapshot_id"), F.col("node").alias("descendant_id")
    )


def p3_full_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path, from the root down, of the snapshots whose id is divisible by 100."""
    trees = materialise(_trees(spark, sf), "trees")
    return _full_paths(trees, _asked(trees))


def p3_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path, from the root down, of every snapshot: as many ids as the depths add up to."""
    trees = materialise(_trees(spark, sf), "trees")
    return _full_paths(trees, trees)


def p3_below(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of the snapshots whose id is divisible by 100."""
    trees = materialise(_trees(spark, sf), "trees")
    return _below(trees, _asked(trees))


def p3_all_below(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of every snapshot: as many rows as the depths add up to."""
    trees = materialise(_trees(spark, sf), "trees")
    return _below(trees, trees)


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """How many descendants every snapshot has."""
    return hierarchy.subtree_sizes(_trees(spark, sf)).withColumnRenamed("node", "snapshot_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entries that the reader delivers when it starts from where the successful runs have left off."""
    tables = (table(spark, sf, n) for n in ("manifest_entries", "manifest_list_entries", "manifest_lists", "run_log"))
    return incremental.unread_entries(spark, *tables).select("entry_id")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.snapshot_orphans(
        *(
            table(spark, sf, n) for n in (
                "manifest_list_entries", "manifest_entries", "snapshots", "manifests", "stored_files"
            )
        )
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "manifests"))


def p6_rows(spark: SparkSession, sf: str) -> DataFrame:
    """file_rows in one layout per table, at all levels; the map as sorted JSON text, so that results compare."""
    r = drift.consistent_rows(table(spark, sf, "file_rows"), table(spark, sf, "manifests"))
    by_path = F.map_from_entries(F.array_sort(F.map_entries("values")))
    return r.select(
        "table_id", "manifest_path", "row_pos", F.to_json(by_path).alias("values"),
        F.to_json(F.array_sort("failed")).alias("failed")
    )


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """How often each path of a file's rows holds which raw type."""
    return drift.path_statistics(table(spark, sf, "file_rows"))


def p6_casts(spark: SparkSession, sf: str) -> DataFrame:
    """The casts that failed, by table, path and types."""
    return drift.failed_casts(drift.consistent_rows(table(spark, sf, "file_rows"), table(spark, sf, "manifests")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_outputs, p1_files, p2_found, p2_current, p2_files, p2_fields, p2_increments, p2_on_base,
        p2_partial, p3_found, p3_paths, p3_full_paths, p3_all_paths, p3_below, p3_all_below, p3_descendants, p4_found,
        p5_found, p5_report, p6_found, p6_rows, p6_paths, p6_casts
    )
}

_LOC = "CASE WHEN regexp_matches({0}, '^s3[an]?:/') THEN 's3://' || regexp_replace(regexp_replace({0}, '^s3[an]?:/+', ''), '/+', '/', 'g') ELSE {0} END"
_NUMBERS = f"nums AS (SELECT {_LOC.format('manifest_path')} p, max(sequence_number) s, max(added_snapshot_id) a FROM manifest_list_entries GROUP BY 1)"
_HEADS = "heads AS (SELECT CAST(trim(snapshot_id) AS BIGINT) id, max(TRY_CAST(trim(parent_snapshot_id) AS BIGINT)) par, max(CAST(trim(sequence_number) AS BIGINT)) seq FROM manifest_lists GROUP BY 1)"
_CUT = f"""{_HEADS}, l AS (SELECT h.id, p.id par FROM heads h LEFT JOIN heads p ON h.par = p.id),
 t AS (SELECT id FROM l WHERE par IS NULL UNION ALL SELECT l.id FROM l JOIN t ON l.par = t.id),
 b AS (SELECT id, par FROM l WHERE id NOT IN (SELECT id FROM t)), r AS (SELECT id start, par here FROM b UNION SELECT r.start, b.par FROM r JOIN b ON r.here = b.id),
 onloop AS (SELECT start, min(here) low FROM r WHERE start IN (SELECT start FROM r r2 WHERE r2.here = r2.start) GROUP BY 1),
 cut AS (SELECT id, CASE WHEN id NOT IN (SELECT low FROM onloop) THEN par END par FROM l),
 w AS (SELECT id, 0 d, [id] p, id IN (SELECT id FROM b) looped FROM cut WHERE par IS NULL UNION ALL SELECT cut.id, d + 1, list_append(p, cut.id), looped FROM cut JOIN w ON cut.par = w.id)"""
_P1_MEMBERS = f"""
m AS (SELECT table_id, {_LOC.format('manifest_path')} manifest_path, max(partition_spec_id) spec, max(content) content, max(manifest_length) len, max(added_files_count) af,
 max(added_rows_count) ar, CAST(min(written_at) AS DATE) d FROM manifest_list_entries GROUP BY 1, 2),
s AS (SELECT * FROM m WHERE content = 0 AND (coalesce(len < 6144, false) OR coalesce(af > 0 AND ar < 1000 * af, false)))"""
_P2 = f"""WITH {_NUMBERS}, e AS (SELECT table_id, {_LOC.format('data_file.file_path')} file_path, coalesce(sequence_number, s) q, status, data_file.record_count rc, data_file.file_size_in_bytes sz
 FROM manifest_entries LEFT JOIN nums ON p = {_LOC.format('manifest_path')}),
h AS (SELECT *, row_number() OVER (PARTITION BY table_id, file_path ORDER BY q DESC, (status = 2) DESC, rc DESC NULLS LAST, sz DESC NULLS LAST) n FROM e WHERE q IS NOT NULL)"""
_MAPS = ("column_sizes", "value_counts", "null_value_counts", "nan_value_counts", "lower_bounds", "upper_bounds")
_MAP_TEXT = "array_to_string(list_sort(list_transform(map_entries({0}), lambda e: CAST(e.key AS VARCHAR) || '=' || {1})), ',') AS {0}"
_P2_FIELDS = f"""WITH {_NUMBERS}, e AS (SELECT table_id, {_LOC.format('data_file.file_path')} file_path, coalesce(sequence_number, s) q, status, data_file f FROM manifest_entries LEFT JOIN nums ON p = {_LOC.format('manifest_path')}),
h AS (SELECT *, row_number() OVER (PARTITION BY table_id, file_path ORDER BY q DESC, (status = 2) DESC, f.record_count DESC NULLS LAST, f.file_size_in_bytes DESC NULLS LAST, f.content DESC NULLS LAST, f.file_format DESC NULLS LAST,
 {', '.join(f'(f.{m} IS NOT NULL) DESC' for m in _MAPS)}, {', '.join(f'f.{m} DESC NULLS LAST' for m in ('key_metadata', 'split_offsets', 'equality_ids', 'sort_order_id', 'referenced_data_file'))}) n FROM e WHERE q IS NOT NULL),
x AS (SELECT table_id, file_path, q AS sequence_number, unnest(f) FROM (SELECT * EXCLUDE (f), struct_pack(record_count := f.record_count, file_size_in_bytes := f.file_size_in_bytes, content := f.content, file_format := f.file_format,
 {', '.join(f'{m} := f.{m}' for m in (*_MAPS, 'key_metadata', 'split_offsets', 'equality_ids', 'sort_order_id', 'referenced_data_file'))}) f FROM h WHERE n = 1 AND status <> 2))
SELECT table_id, file_path, sequence_number, record_count, file_size_in_bytes, content, file_format, {', '.join(_MAP_TEXT.format(m, 'hex(e.value)' if 'bounds' in m else 'CAST(e.value AS VARCHAR)') for m in _MAPS)},
 hex(key_metadata) AS key_metadata, array_to_string(split_offsets, ',') AS split_offsets, array_to_string(equality_ids, ',') AS equality_ids, sort_order_id, referenced_data_file FROM x"""
_ORPHANS = f"""WITH refs AS (
 SELECT 'snapshot' k, l.table_id, CAST(added_snapshot_id AS VARCHAR) key, written_at t FROM manifest_list_entries l
  WHERE added_snapshot_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.table_id = l.table_id AND s.snapshot_id = l.added_snapshot_id)
 UNION ALL SELECT 'manifest', l.table_id, l.p, written_at FROM (SELECT *, {_LOC.format('manifest_path')} p FROM manifest_list_entries) l
  LEFT JOIN (SELECT {_LOC.format('manifest_path')} p, max(coalesce(deleted_at, TIMESTAMP '9999-12-31')) d FROM manifests GROUP BY 1) m ON m.p = l.p WHERE m.p IS NULL OR m.d <= l.written_at
 UNION ALL SELECT 'data_file', e.table_id, e.p, arrived_at FROM (SELECT *, {_LOC.format('data_file.file_path')} p FROM manifest_entries WHERE status IN (0, 1)) e
  LEFT JOIN (SELECT {_LOC.format('file_path')} p, max(coalesce(deleted_at, TIMESTAMP '9999-12-31')) d FROM stored_files GROUP BY 1) f ON f.p = e.p WHERE f.p IS NULL OR f.d <= e.arrived_at),
o AS (SELECT k ref_kind, table_id, key missing_key, strftime(min(t), '%Y-%m-%d') ref_day FROM refs GROUP BY 1, 2, 3)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_P1_MEMBERS} SELECT table_id, manifest_path FROM s QUALIFY count(*) OVER (PARTITION BY table_id, spec, d) >= 6",
    "p1_outputs": f"""SELECT table_id, count(*) AS entries, CAST(sum(rc) AS BIGINT) AS records FROM (SELECT table_id, data_file.record_count rc FROM manifest_entries
 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY arrived_at NULLS LAST, data_file.record_count IS NULL, {_LOC.format('manifest_path')}) = 1) GROUP BY 1""",
    "p1_files": "SELECT file_path, size_in_bytes FROM stored_files",
    "p2_found": f"{_P2} SELECT table_id, file_path, q AS sequence_number FROM h WHERE n = 1 AND status <> 2",
    **dict.fromkeys(("p2_current", "p2_increments", "p2_on_base"), f"{_P2} SELECT table_id, file_path, q AS sequence_number, rc AS record_count, sz AS file_size_in_bytes FROM h WHERE n = 1 AND status <> 2"),
    "p2_fields": _P2_FIELDS,
    "p2_partial": f"""{_P2}, g AS (SELECT table_id, file_path, max(q) FILTER (status = 2) gone FROM e GROUP BY ALL),
 x AS (SELECT table_id, file_path, arg_max(rc, (q, rc)) FILTER (rc IS NOT NULL AND status <> 2 AND q > coalesce(gone, -1)) rc, arg_max(sz, (q, sz)) FILTER (sz IS NOT NULL AND status <> 2 AND q > coalesce(gone, -1)) sz
  FROM e JOIN g USING (table_id, file_path) GROUP BY ALL)
 SELECT table_id, file_path, q AS sequence_number, x.rc AS record_count, x.sz AS file_size_in_bytes FROM h JOIN x USING (table_id, file_path) WHERE n = 1 AND status <> 2""",
    "p3_found": f"""WITH RECURSIVE {_HEADS}, l AS (SELECT h.id, p.id par FROM heads h LEFT JOIN heads p ON h.par = p.id),
 t AS (SELECT id, id root, 0 depth FROM l WHERE par IS NULL UNION ALL SELECT l.id, t.root, t.depth + 1 FROM l JOIN t ON l.par = t.id),
 b AS (SELECT id, par FROM l WHERE id NOT IN (SELECT id FROM t)),
 w AS (SELECT id start, par here FROM b UNION SELECT w.start, b.par FROM w JOIN b ON w.here = b.id),
 onloop AS (SELECT start, min(here) low FROM w WHERE start IN (SELECT start FROM w w2 WHERE w2.here = w2.start) GROUP BY 1)
 SELECT id AS snapshot_id, root AS root_snapshot_id, CAST(depth AS INTEGER) AS depth FROM t
 UNION ALL SELECT w.start, min(o.low), -1 FROM w JOIN onloop o ON w.here = o.start GROUP BY 1""",
    "p3_paths": f"""WITH RECURSIVE {_CUT}, s AS (SELECT *, CASE WHEN d > 0 THEN (d - 1) // 64 * 64 END a FROM w)
 SELECT id AS snapshot_id, p[1] AS root_snapshot_id, CAST(d AS INTEGER) AS depth, looped, p[a + 1] AS anchor_snapshot_id,
 array_to_string(list_reverse(p[coalesce(a + 2, 1):]), ',') AS segment FROM s""",
    "p3_full_paths": f"""WITH RECURSIVE {_CUT} SELECT id AS snapshot_id, CASE WHEN looped THEN CAST(id AS VARCHAR) ELSE array_to_string(p, ',') END AS path FROM w WHERE id % 100 = 0""",
    "p3_all_paths": f"""WITH RECURSIVE {_CUT} SELECT id AS snapshot_id, CASE WHEN looped THEN CAST(id AS VARCHAR) ELSE array_to_string(p, ',') END AS path FROM w""",
    "p3_below": f"""WITH RECURSIVE {_CUT} SELECT anc AS snapshot_id, id AS descendant_id FROM (SELECT id, unnest(p) anc FROM w WHERE NOT looped) WHERE anc % 100 = 0 AND anc <> id""",
    "p3_all_below": f"""WITH RECURSIVE {_CUT} SELECT anc AS snapshot_id, id AS descendant_id FROM (SELECT id, unnest(p) anc FROM w WHERE NOT looped) WHERE anc <> id""",
    "p3_descendants": f"""WITH RECURSIVE {_HEADS}, l AS (SELECT h.id, p.id par FROM heads h LEFT JOIN heads p ON h.par = p.id),
 t AS (SELECT id FROM l WHERE par IS NULL UNION ALL SELECT l.id FROM l JOIN t ON l.par = t.id), g AS (SELECT * FROM l WHERE id IN (SELECT id FROM t)),
 a AS (SELECT id, par anc FROM g WHERE par IS NOT NULL UNION ALL SELECT a.id, g.par FROM a JOIN g ON a.anc = g.id WHERE g.par IS NOT NULL)
 SELECT l.id AS snapshot_id, count(a.id) AS descendants FROM l LEFT JOIN a ON a.anc = l.id GROUP BY 1""",
    "p4_found": f"""WITH {_NUMBERS}, {_HEADS},
 e AS (SELECT entry_id, max(table_id) table_id, max(coalesce(sequence_number, s)) q, min(arrived_at) a FROM manifest_entries LEFT JOIN nums ON p = {_LOC.format('manifest_path')} GROUP BY 1),
 r AS (SELECT DISTINCT table_id, CASE WHEN start_snapshot_id IS NULL THEN -1 ELSE b.seq END lo, f.seq hi, read_at FROM run_log
  LEFT JOIN heads b ON b.id = start_snapshot_id JOIN heads f ON f.id = end_snapshot_id WHERE lower(trim(outcome)) = 'succeeded')
 SELECT entry_id FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.table_id = e.table_id AND q > lo AND q <= hi AND a <= read_at)""",
    "p5_found": f"{_ORPHANS} SELECT * FROM o",
    "p5_report": f"{_ORPHANS} SELECT ref_kind, table_id, ref_day, count(*) AS orphans FROM o GROUP BY 1, 2, 3",
    "p6_found": """WITH RECURSIVE j AS (SELECT DISTINCT table_id, TRY_CAST(trim(schema_id) AS BIGINT) h, schema::JSON s FROM manifests WHERE json_valid(schema)),
 v AS (SELECT DISTINCT table_id, coalesce(h, TRY_CAST(s->>'schema-id' AS BIGINT)) sid, s FROM j WHERE json_type(s, '$.fields') = 'ARRAY'),
 n AS (SELECT table_id, sid, (f->>'id')::INT id, f->>'name' name, f->'type' t FROM (SELECT table_id, sid, unnest(s->'$.fields[*]') f FROM v WHERE sid IS NOT NULL)
  UNION ALL SELECT table_id, sid, (c->>'id')::INT, c->>'name', c->'type' FROM (
   SELECT table_id, sid, unnest(CASE t->>'type' WHEN 'struct' THEN t->'$.fields[*]'
    WHEN 'list' THEN [json_object('id', t->'element-id', 'name', 'element', 'type', t->'element')]
    ELSE [json_object('id', t->'key-id', 'name', 'key', 'type', t->'key'), json_object('id', t->'value-id', 'name', 'value', 'type', t->'value')] END) c
   FROM n WHERE json_type(t) = 'OBJECT')),
 d AS (SELECT DISTINCT table_id, sid, id, name, CASE WHEN json_type(t) = 'OBJECT' THEN t->>'type' ELSE regexp_replace(t->>'$', '\\s+', '', 'g') END t FROM n),
 k AS (SELECT table_id, sid, lead(sid) OVER (PARTITION BY table_id ORDER BY sid) nx FROM (SELECT DISTINCT table_id, sid FROM d)),
 o AS (SELECT k.table_id, k.sid, k.nx, id, name, t FROM k JOIN d USING (table_id, sid) WHERE nx IS NOT NULL),
 w AS (SELECT k.table_id, k.sid, k.nx, id, name, t FROM k JOIN d ON d.table_id = k.table_id AND d.sid = k.nx),
 c AS (SELECT coalesce(o.table_id, w.table_id) table_id, coalesce(o.sid, w.sid) a, coalesce(o.nx, w.nx) b, coalesce(o.id, w.id) id, o.name n1, w.name n2, o.t t1, w.t t2
  FROM o FULL JOIN w ON o.table_id = w.table_id AND o.sid = w.sid AND o.id = w.id)
 SELECT table_id, a AS from_schema_id, b AS to_schema_id, id AS field_id, unnest(CASE WHEN n1 IS NULL THEN ['added'] WHEN n2 IS NULL THEN ['removed']
  ELSE list_filter([CASE WHEN n1 <> n2 THEN 'renamed' END, CASE WHEN t1 <> t2 THEN 'retyped' END], lambda x: x IS NOT NULL) END) AS change FROM c""",
    "p6_paths": f"""WITH f AS (SELECT DISTINCT {_LOC.format('manifest_path')} manifest_path, row_pos, payload FROM file_rows WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')
 SELECT manifest_path, regexp_replace(replace(substr(fullkey, 3), '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path, CASE WHEN j.type = 'VARCHAR' THEN 'string' WHEN j.type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer'
 WHEN j.type = 'DOUBLE' THEN 'number' ELSE lower(j.type) END AS raw_type, count(*) AS n FROM f, json_tree(payload) j WHERE fullkey <> '$' GROUP BY ALL""",
}
