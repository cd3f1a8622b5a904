"""Writing: append, overwrite, delete files, with optimistic commits that are tried again on what is there by then."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.transforms import in_utc, physical_column, transform
from quern.sources import manifest as mf
from quern.sources import metadata as md
from quern.sources.catalog import Catalog, NoSuchTable, Table
from quern.sources.storage import Storage
from quern.sources.types import Schema, name_mapping, sql_literal


def _partition_text(name: str, kind: str, c: Column) -> Column:
    """A partition value as a folder's name: a letter and the value's text in hex, so that any text is a name; null
    stays null."""
    kept = name == "identity" or name.startswith(("bucket", "truncate"))
    source = physical_column(kind, c) if kept else in_utc(kind, c)
    text = "text" if kind in ("string", "uuid", "binary") or kind.startswith("fixed") else None
    v = transform(name, source, text).cast("string")
    long = F.raise_error(
        F.lit("a partition value is longer than 100 bytes: truncate[W] or bucket[N] keep it short")
    ).cast("string")
    return F.when(F.octet_length(v) > 100, long).otherwise(F.concat(F.lit("v"), F.hex(F.encode(v, "UTF-8"))))


def _parquet(storage: Storage, folder: str) -> list[str]:
    return [p for p, _, d in storage.list(folder) if not d and p.endswith(".parquet")]


def _folders(storage: Storage, folder: str, depth: int) -> Iterator[tuple[list[str | None], str]]:
    """(partition values, path) of the files that a partitioned write left below ``folder``."""
    if depth == 0:
        yield from (([], p) for p in _parquet(storage, folder))
        return
    for p, _, d in storage.list(folder):
        if d and "=" in (name := p.rstrip("/").rsplit("/", 1)[1]):
            text = name.split("=", 1)[1]
            for more, path in _folders(storage, p, depth - 1):
                yield [None if text == "__HIVE_DEFAULT_PARTITION__" else bytes.fromhex(text[1:]).decode(), *more], path


class Transaction:
    """Collects changes to one table and commits them once; as a context manager it commits on leaving, unless an error
    leaves it."""

    def __init__(self, catalog: Catalog, ident: Any, branch: str = md.MAIN, retries: int = 5):
        self.catalog, self.ident, self.branch, self.retries = catalog, ident, branch, retries
        self._staged: list[tuple[str, dict]] = []
        self._new_table: Table | None = None
        self._updates: list[dict] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self.commit()

    def _table(self, df: DataFrame | None = None) -> Table:
        """The table, staged for creation from the frame's schema if there is none (only then)."""
        if self._new_table:
            return self._new_table
        try:
            return self.catalog.load_table(self.ident)
        except NoSuchTable:
            if df is None:
                raise
            self._new_table = self.catalog.stage_table(self.ident, df.schema)
            return self._new_table

    def _write(self, df: DataFrame, table: Table, schema: Schema, files: int | None = None) -> list[dict]:
        """Rows to new Parquet files of the table, written by the tasks that hold them; gives their records. Columns are
        taken by name, absent ones get their default, else null."""
        have = {f.name for f in df.schema}
        extra = have - {f.name for f in schema.struct.fields}
        if extra:
            raise ValueError(f"the table has no columns {sorted(extra)}")
        absent = {
            f.name: F.expr(
                sql_literal(f.write_default, f.type.spark)
            ) if f.write_default is not None else F.lit(None) for f in schema.struct.fields if f.name not in have
        }
        missing = [
            f.name for f in schema.struct.fields if f.required and f.name not in have and f.write_default is None
        ]
        if missing:
            raise ValueError(f"required columns are absent: {missing}")
        kind = schema.spark()
        if not kind.fields:
            return []
        rows = df.select(
            *(
                absent.get(
                    f.name, F.col(f"`{f.name}`")
                ).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in kind.fields
            )
        )
        spec = next(s for s in table.metadata["partition-specs"] if s["spec-id"] == table.metadata["default-spec-id"])
        parts = mf.partition_fields(spec, schema)
        names = [f"_p{i}" for i in range(len(parts))]
        if parts:  # rows of one partition value come together, and into files of their own
            by_id = {f.id: f.name for f in schema.struct.fields}
            for name, (p, kind, _) in zip(names, parts, strict=True):
                rows = rows.withColumn(name, _partition_text(p["transform"], kind, F.col(f"`{by_id[p['source-id']]}`")))
            # Adaptive execution splits a value that is too large for one task.
            rows = rows.hint("rebalance", *names) if files is None else rows.repartition(files, *names)
        order = next(
            o for o in table.metadata["sort-orders"] if o["order-id"] == table.metadata["default-sort-order-id"]
        )
        if order["fields"]:
            by_id = {f.id: f.name for f in schema.struct.fields}
            keys = []
            for o in order["fields"]:
                c = transform(o.get("transform", "identity"), F.col(f"`{by_id[o['source-id']]}`"))
                keys.append(
                    getattr(c, f"{o.get('direction', 'asc')}_{o.get('null-order', 'nulls-first').replace('-', '_')}")()
                )
            rows = rows.sortWithinPartitions(*names, *keys)
        if files is not None and not spec["fields"]:
            rows = rows.coalesce(files)
        folder = f"{table.location}/data/{uuid.uuid4().hex}"
        # A required column stays required in the files; the check is the writer's.
        w = rows.write.option("compression", "zstd")
        (w.partitionBy(*names) if names else w).parquet(folder)
        paths = [(p, []) for p in _parquet(self.catalog.storage, folder)] if not names else [
            (p, v) for v, p in _folders(self.catalog.storage, folder, len(names))
        ]
        records, values = mf.collect_stats(self.catalog.spark, [p for p, _ in paths], schema), dict(paths)
        for r in records:
            r["partition"] = {
                p["name"]: mf.partition_value(kind, x) for (p, _, kind),
                x in zip(parts, values[r["file_path"]], strict=True) if kind
            }
        return [r for r in records if r["record_count"]]

    def append(self, df: DataFrame, files: int | None = None) -> Transaction:
        """``files``: write at most so many files (1 for a single ordered one); else as many as there are tasks."""
        table = self._table(df)
        for f in self._write(df, table, table.schema, files):
            self._staged.append(("data", f))
        return self

    def import_files(self, paths: list[str], mapping: list[dict] | None = None) -> Transaction:
        """Append the rows of Parquet files that carry no field ids: columns are found by a name mapping (by default the
        table's property schema.name-mapping.default, else the present names); they are written anew, with ids."""
        table = self._table()
        kept = table.metadata["properties"].get("schema.name-mapping.default")
        mapping = mapping or (json.loads(kept) if kept else name_mapping(table.schema))
        names = {m["field-id"]: m["names"] for m in mapping if m.get("field-id") is not None}
        df = self.catalog.spark.read.parquet(*paths)
        found = [
            (
                next((n for n in names.get(f.id, []) if n in df.columns), None), f.name
            ) for f in table.schema.struct.fields
        ]
        return self.append(df.select(*(F.col(f"`{old}`").alias(new) for old, new in found if old)))

    def overwrite(self, df: DataFrame) -> Transaction:
        self._staged.append(("replace", {}))
        return self.append(df)

    def delete_positions(self, rows: DataFrame) -> Transaction:
        """Position deletes: ``rows`` has file_path and pos."""
        table = self._table()
        folder = f"{table.location}/data/{uuid.uuid4().hex}"
        rows.select(F.col("file_path").cast("string"), F.col("pos").cast("bigint")).write.parquet(folder)
        self._stage_deletes(folder, mf.POSITION_DELETES, None)
        return self

    def delete_equal(self, keys: DataFrame) -> Transaction:
        """Equality deletes: rows of older files that equal a row of ``keys`` in its columns, nulls included."""
        table = self._table()
        schema = table.schema
        kind = schema.spark()
        folder = f"{table.location}/data/{uuid.uuid4().hex}"
        keys.select(
            *(F.col(f"`{c}`").cast(kind[c].dataType).alias(c, metadata=kind[c].metadata) for c in keys.columns)
        ).write.parquet(folder)
        self._stage_deletes(folder, mf.EQUALITY_DELETES, [schema.find(c).id for c in keys.columns])
        return self

    def _stage_deletes(self, folder: str, content: int, ids: list[int] | None) -> None:
        paths = [p for p, _, d in self.catalog.storage.list(folder) if not d and p.endswith(".parquet")]
        for f in mf.collect_stats(self.catalog.spark, paths, self._table().schema):  # counts and sizes from the footers
            if f["record_count"]:
                kept = {k: f[k] for k in ("file_path", "file_format", "record_count", "file_size_in_bytes")}
                self._staged.append(("deletes", kept | {"content": content, "partition": {}, "equality_ids": ids}))

    def delete_where(self, p: Any) -> Transaction:
        """Rows that satisfy the predicate, as position deletes; files that can't hold any aren't read."""
        from quern.sources import planner

        table = self._table()
        plan, schema = table.plan(where=p)
        if plan.tasks:
            df = self.catalog.spark.read.schema(schema.spark()).parquet(*(t.file["file_path"] for t in plan.tasks))
            self.catalog.spark.conf.set(planner.FIELD_ID_READ, "true")
            self.delete_positions(
                df.where(p.filter()).select(
                    F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos")
                )
            )
        return self

    def set_properties(self, **updates: str) -> Transaction:
        self._updates.append({"action": "set-properties", "updates": updates})
        return self

    def commit(self) -> Table | None:
        """One snapshot with all that was staged; None if nothing was. A lost race is tried again on the new state,
        keeping the data files written."""
        if not self._staged and not self._updates:
            return self.catalog.commit(self._new_table, [], [{"type": "assert-create"}]) if self._new_table else None
        for attempt in range(self.retries + 1):
            creating = self._new_table is not None
            table = self._new_table or self.catalog.load_table(self.ident)
            updates, requirements = list(self._updates), [{"type": "assert-create"}] if creating else [
                {"type": "assert-table-uuid", "uuid": table.metadata["table-uuid"]}
            ]
            if self._staged:
                snap = self._snapshot(table)
                updates += [
                    {"action": "add-snapshot", "snapshot": snap},
                    {
                        "action": "set-snapshot-ref", "ref-name": self.branch, "type": "branch",
                        "snapshot-id": snap["snapshot-id"]
                    }
                ]
                if not creating:
                    requirements.append(
                        {
                            "type": "assert-ref-snapshot-id", "ref": self.branch,
                            "snapshot-id": table.metadata["refs"].get(self.branch, {}).get("snapshot-id")
                        }
                    )
            try:
                done = self.catalog.commit(table, updates, requirements)
                self._staged, self._updates, self._new_table = [], [], None
                return done
            except md.CommitConflict:
                if creating and self.catalog.table_exists(self.ident):
                    self._new_table = None  # another writer created it; its schema decides from now on
                if attempt == self.retries:
                    raise
        return None

    def _snapshot(self, table: Table) -> dict:
        storage, meta = self.catalog.storage, table.metadata
        parent = meta["refs"].get(self.branch, {}).get("snapshot-id")
        old = mf.read_list(storage, md.snapshot_by_id(meta, parent)["manifest-list"]) if parent is not None else []
        sid, seq = random.getrandbits(62), meta["last-sequence-number"] + 1
        base = f"{table.location}/metadata"
        spec = next(s for s in meta["partition-specs"] if s["spec-id"] == meta["default-spec-id"])
        groups = {k: [f for kind, f in self._staged if kind == k] for k in ("data", "deletes")}
        replace = any(k == "replace" for k, _ in self._staged)
        rows, kept, gone = [], old, []
        if replace:
            kept = []
            gone, _ = mf.live_entries(self.catalog.spark, storage, old)
        entry = lambda f: {
            "status": mf.ADDED, "snapshot_id": sid, "sequence_number": None, "file_sequence_number": None,
            "data_file": f
        }
        specs = {s["spec-id"]: s for s in meta["partition-specs"]}
        whole = next((s for s in specs.values() if not s["fields"]), {"spec-id": 0, "fields": []})  # delete files concern all partitions
        new = [
            ([entry(f) for f in groups["data"]], mf.DATA, spec),
            ([entry(f) for f in groups["deletes"]], mf.DELETES, whole)
        ]
        # What an overwrite removes: data files and delete files each in manifests of their kind, by the spec they were
        # written with.
        for content in (mf.DATA, mf.DELETES):
            for k in sorted({e["spec_id"] for e in gone}):
                removed = [
                    e | {"status": mf.DELETED, "snapshot_id": sid} for e in gone if e["spec_id"] == k and (
                        e["data_file"]["content"] != mf.DATA
                    ) == (content == mf.DELETES)
                ]
                new.append((removed, content, specs.get(k, whole)))
        for n, (entries, content, own) in enumerate(new):
            if entries:
                rows.append(
                    mf.write_manifest(
                        storage, f"{base}/{uuid.uuid4()}-m{n}.avro", entries, table.schema, sid, seq, content, own
                    )
                )
        path = f"{base}/snap-{sid}-{seq}-{uuid.uuid4()}.avro"
        mf.write_list(storage, path, [*rows, *kept], sid, parent, seq)
        total = lambda fs, key: sum(f[key] for f in fs)
        gone_files = [e["data_file"] for e in gone if e["data_file"]["content"] == mf.DATA]
        before = (md.snapshot_by_id(meta, parent).get("summary") or {}) if parent is not None else {}
        summary = {
            "operation": "overwrite" if replace else "delete" if groups["deletes"] and not groups["data"] else "append"
        }
        summary |= {
            "added-data-files": len(groups["data"]), "added-records": total(groups["data"], "record_count"),
            "added-files-size": total(groups["data"], "file_size_in_bytes"),
            "added-delete-files": len(groups["deletes"])
        }
        summary |= {
            "deleted-data-files": len(gone_files), "deleted-records": total(gone_files, "record_count"),
            "removed-delete-files": len(gone) - len(gone_files)
        }
        totals = (
            ("data-files", "added-data-files", "deleted-data-files"), ("records", "added-records", "deleted-records"),
            ("delete-files", "added-delete-files", "removed-delete-files")
        )
        for name, added, removed in totals:
            summary[f"total-{name}"] = int(before.get(f"total-{name}", 0)) + summary[added] - summary[removed]
        summary = {
            k: v if k == "operation" else str(v) for k,
            v in summary.items() if v or k.startswith("total") or k == "operation"
        }
        out = {
            "snapshot-id": sid, "sequence-number": seq, "timestamp-ms": md.now_ms(), "manifest-list": path,
            "summary": summary, "schema-id": meta["current-schema-id"]
        }
        return out | ({"parent-snapshot-id": parent} if parent is not None else {})
