"""Extension: streams over tables. The reference data model has no streams; these use Structured Streaming beside it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.catalog import Catalog
from quern.sources.transaction import Transaction


def append_sink(catalog: Catalog, ident: Any, stream: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each micro-batch is one snapshot. A batch that is run again finds its number in
    the table's properties and does nothing.

    ``stream`` names the stream for good: streams into one table count their batches apart, and one that is started anew
    with its checkpoint keeps its name.
    """
    key = f"stream.batch.{stream}"

    def write(batch: DataFrame, number: int) -> None:
        done = catalog.load_table(ident).metadata["properties"].get(key) if catalog.table_exists(ident) else None
        if done is not None and int(done) >= number:
            return
        tx = Transaction(catalog, ident)
        tx.append(batch)
        tx.set_properties(**{key: str(number)})
        tx.commit()

    return write


def changed_since(catalog: Catalog, ident: Any, start: int | None) -> tuple[DataFrame, int | None]:
    """(rows appended after snapshot ``start``, the snapshot they reach to): one step of a snapshot-by-snapshot
    reader."""
    t = catalog.load_table(ident)
    end = t.metadata["current-snapshot-id"]
    return (t.incremental(start, end) if end is not None and end != start else t.to_df().limit(0)), end


def windowed(
    stream: DataFrame, time: str, late: str, width: str, keys: list[str], *aggs: Column, slide: str | None = None
) -> DataFrame:
    """Aggregates by time window and keys; rows later than ``late`` behind the newest are left out. Works on a batch
    frame alike."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *_names(aggs)
    )


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by session: rows of a key no further apart than ``gap``."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *_names(aggs)
    )


def _names(aggs: tuple[Column, ...]) -> list[str]:
    import re

    return [re.search(r" AS `?(\w+)`?'", str(a))[1] for a in aggs]


def file_stream(spark: SparkSession, path: str, schema: Any, per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_batch) if per_batch else r).parquet(path)
