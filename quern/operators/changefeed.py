"""Applying a stream of inserts, updates and deletes.

A change is a patch: a function from a row to a row. Patches on one key compose associatively once every patch carries
the position of its change: of two images the later one holds, a deletion empties what lies before it, and of two
partial updates each column keeps its later value. All of these are maxima over positions, so composing can begin in any
chunk of the feed. ``patches`` therefore reduces as a tree: within each map task, then over range chunks of the
positions of each key (a hot key is spread over its chunks), then over the keys. ``combine`` composes patches with
patches kept from before, ``apply_changes`` applies them to a base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.snapshot_tables import location, with_numbers


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t)
    return isinstance(t, T.MapType) or (isinstance(t, T.ArrayType) and _has_map(t.elementType))


def _plain(c: Column, t: T.DataType) -> Column:
    """``c`` with maps as sorted entries, whatever order they were written in."""
    if not _has_map(t):
        return c
    if isinstance(t, T.MapType):
        return F.array_sort(
            F.transform(
                F.map_entries(c),
                lambda e: F.struct(e["key"].alias("key"), _plain(e["value"], t.valueType).alias("value"))
            )
        )
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, t.elementType))
    return F.struct(*(_plain(c[f.name], f.dataType).alias(f.name) for f in t))


def _rank(at: Column, values: Sequence[tuple[Column, T.DataType]]) -> Column:
    """What images are compared by: their position, then their values, nulls least; Spark doesn't order maps, so a hash
    stands for values that hold any."""
    hashed = lambda c, t: F.when(c.isNotNull(), F.xxhash64(_plain(c, t)))
    return F.struct(
        at.alias("_at"), *((hashed(c, t) if _has_map(t) else c).alias(f"_{k}") for k, (c, t) in enumerate(values))
    )


def _position(order: str, deletes: Column) -> Column:
    """Fixed-width rank of a change: by its number, a deletion last among equals. Null numbers give null."""
    return F.col(order).cast("bigint") * 2 + F.coalesce(deletes, F.lit(False)).cast("bigint")


def patches(
    changes: DataFrame, keys: Sequence[str], order: str, deletes: Column, values: Sequence[str] = (),
    partial: bool = False, chunk: int = 64
) -> DataFrame:
    """One patch per key: ``keys`` and the function that all its changes amount to, for ``combine`` and ``settle``.

    ``partial=False``: every change carries the whole row; the one with the highest ``order`` holds, deletions first
    among equals, whenever it arrived. ``partial=True``: a null value leaves the column as it was; each column holds its
    latest value after the last deletion. Repeated changes change nothing. Changes with a null ``order`` have no place
    in the sequence and are ignored; null keys are keys of their own. Equal numbers with different values: the greatest
    value holds (of values that hold maps, the one with the greatest hash), so results don't depend on the input's
    order. ``chunk``: how many neighbouring numbers make one range chunk of a key.
    """
    at = _position(order, deletes)
    rows = changes.select(
        *(F.col(k) for k in keys), at.alias("_at"), *(F.col(v).alias(v) for v in values)
    ).where("_at is not null")
    chunked = rows.withColumn("_chunk", F.floor(F.col("_at") / (2 * chunk)))
    if partial:
        sets = lambda v: F.when((F.col("_at") % 2 == 0) & F.col(v).isNotNull(), F.struct("_at", v))
        single = chunked.select(
            *keys, "_chunk", "_at", F.when(F.col("_at") % 2 == 1, F.col("_at")).alias("_gone"),
            *(sets(v).alias(v) for v in values)
        )
    elif values:
        single = chunked.select(*keys, "_chunk", F.struct("_at", *values).alias("_image"))
    else:
        single = chunked.select(*keys, "_chunk", "_at")
    return _reduce(_reduce(single, [*keys, "_chunk"], partial), list(keys), partial)


def _reduce(some: DataFrame, by: Sequence[str], partial: bool) -> DataFrame:
    """The patches of each ``by`` composed into one: whichever of two came later decides, for the row or for each of its
    columns."""
    if "_image" in some.columns:
        image = some.schema["_image"].dataType
        rank = _rank(
            F.col("_image._at"), [(F.col("_image")[f.name], f.dataType) for f in image.fields if f.name != "_at"]
        )
        latest = F.max_by("_image", rank) if _has_map(image) else F.max("_image")
        return some.groupBy(*by).agg(latest.alias("_image"))
    if not partial:
        return some.groupBy(*by).agg(F.max("_at").alias("_at"))  # fixed width: stays in the hash aggregate
    values = [c for c in some.columns if c not in (*by, "_at", "_gone", "_chunk")]

    def latest(v: str) -> Column:
        kind = some.schema[v].dataType[v].dataType
        return F.max_by(v, F.when(F.col(v).isNotNull(), _rank(F.col(v)["_at"], [(F.col(v)[v], kind)])))

    return some.groupBy(*by).agg(
        F.max("_at").alias("_at"), F.max("_gone").alias("_gone"), *(latest(v).alias(v) for v in values)
    )


def combine(some: Sequence[DataFrame], keys: Sequence[str], partial: bool = False) -> DataFrame:
    """Patches composed with patches of the same kind, in any order: composing is associative, and each patch carries
    its positions.

    Patches kept from earlier runs, deletions among them, are a state that late and repeated changes can still be
    composed with.
    """
    every = some[0]
    for x in some[1:]:
        every = every.unionByName(x)
    return _reduce(every, list(keys), partial)


def settle(some: DataFrame, keys: Sequence[str], partial: bool = False) -> DataFrame:
    """What the patches do: ``keys``, ``_at`` (position of the holding change), ``_deleted`` and the values; with
    ``partial``, ``_reset``: what was before is gone."""
    if not partial:
        flat = some.select(*keys, "_image.*") if "_image" in some.columns else some
        return flat.withColumn("_deleted", F.col("_at") % 2 == 1)
    since = F.coalesce("_gone", F.lit(-(1 << 62)))
    values = [c for c in some.columns if c not in (*keys, "_at", "_gone")]
    return some.select(
        *keys, "_at", (F.col("_at") % 2 == 1).alias("_deleted"), F.col("_gone").isNotNull().alias("_reset"),
        *(F.when(F.col(f"{v}._at") > since, F.col(f"{v}.{v}")).alias(v) for v in values),
    )


def compose(
    changes: DataFrame, keys: Sequence[str], order: str, deletes: Column, values: Sequence[str] = (),
    partial: bool = False, chunk: int = 64
) -> DataFrame:
    """``patches``, settled."""
    return settle(patches(changes, keys, order, deletes, values, partial, chunk), keys, partial)


def apply_changes(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, deletes: Column, values: Sequence[str],
    partial: bool = False, chunk: int = 64, position: str | None = None,
) -> DataFrame:
    """The state of ``base`` after ``changes``: ``keys`` and ``values``, one row per key that is alive.

    ``base`` has one row per key. Its other columns, and those of ``changes``, are not read. Null keys match each other.
    Either side may be empty. ``position``: a column of base with the number of the change that made the row (null:
    none), which the result carries on; a change that base has seen, or one before it, then changes nothing. Deletions
    leave no row: changes that may come late for them are composed with patches kept (``combine``).
    """
    return apply_patches(
        base, patches(changes, keys, order, deletes, values, partial, chunk), keys, values, partial, position
    )


def apply_patches(
    base: DataFrame, some: DataFrame, keys: Sequence[str], values: Sequence[str], partial: bool = False,
    position: str | None = None
) -> DataFrame:
    """``apply_changes`` for changes that are patches already."""
    number = F.col(position).cast("bigint") if position else F.lit(None).cast("bigint")
    b = base.select(*keys, *values, number.alias("_number"), F.lit(True).alias("_there")).alias("b")
    p = settle(some, keys, partial).alias("p")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}"))
    j = b.join(p, on, "full")
    patched = F.col("p._at").isNotNull() & (F.col("b._number").isNull() | (F.col("p._at") > F.col("b._number") * 2))
    out = []
    for v in values:
        old, new = F.col(f"b.{v}"), F.col(f"p.{v}")
        kept = F.coalesce(new, F.when(~F.col("p._reset"), old)) if partial else new
        out.append(F.when(patched, kept).otherwise(old).alias(v))
    if position:
        out.append(F.when(patched, F.expr("p._at div 2")).otherwise(F.col("b._number")).alias(position))
    alive = F.when(patched, ~F.col("p._deleted")).otherwise(F.lit(True))
    there = F.col("b._there").isNotNull()
    return j.where(alive).select(
        *(F.when(there, F.col(f"b.{k}")).otherwise(F.col(f"p.{k}")).alias(k) for k in keys), *out
    )


FILE_KEYS = ["table_id", "file_path"]


def file_changes(entries: DataFrame, listed: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """(table_id, file_path, sequence_number, status, values): ``entries`` as changes to the files of tables.

    ``values`` are columns of ``entries`` or fields of data_file. A null sequence_number is the manifest's in
    ``listed``.
    """
    inner = {v: F.col(v) if v in entries.columns else F.col(f"data_file.{v}") for v in values}
    e = entries.select(
        "table_id", "manifest_path", "status", "snapshot_id", "sequence_number",
        location("data_file.file_path").alias("file_path"), *(c.alias(f"v_{v}") for v, c in inner.items())
    ).where("file_path is not null")
    named = with_numbers(e, listed)
    return named.select(*FILE_KEYS, "sequence_number", "status", *(F.col(f"v_{v}").alias(v) for v in values))


def no_files(changes: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """The state of tables before any change."""
    return changes.select(*FILE_KEYS, "sequence_number", *values).limit(0)


def current_files(
    entries: DataFrame, listed: DataFrame, values: Sequence[str] = (), base: DataFrame | None = None,
    partial: bool = False
) -> DataFrame:
    """(table_id, file_path, sequence_number, values): the files that the changes of ``entries`` leave in each table,
    applied to ``base`` (none: empty tables)."""
    c = file_changes(entries, listed, values)
    got = apply_changes(
        no_files(c, values) if base is None else base, c, FILE_KEYS, "sequence_number", F.col("status") == 2, values,
        partial, position="sequence_number"
    )
    return got.select(*FILE_KEYS, "sequence_number", *values)
