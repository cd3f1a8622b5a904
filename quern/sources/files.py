"""Files and databases outside tables: Parquet, ORC, JSON, CSV and text by Spark's own sources, Avro by the codec of
this package, databases by JDBC."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.sources import avrofile
from quern.sources.storage import Storage

FORMATS = ("parquet", "orc", "avro", "json", "csv", "text")


def avro_type(schema: Any, named: dict[str, Any] | None = None) -> T.DataType:
    """The column type of an Avro schema; a union with null is the other branch."""
    named = avrofile._names(schema, {}) if named is None else named
    if isinstance(schema, str) and schema in named:
        schema = named[schema]
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1:
            raise ValueError(f"a union of {rest} has no column type")
        return avro_type(rest[0], named)
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(kind, (dict, list)):
        return avro_type(kind, named)
    simple = {
        "null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(),
        "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(),
        "fixed": T.BinaryType(), "enum": T.StringType()
    }
    if kind in simple:
        return simple[kind]
    if kind == "array":
        return T.ArrayType(avro_type(schema["items"], named))
    if kind == "map":
        return T.MapType(T.StringType(), avro_type(schema["values"], named))
    return T.StructType([T.StructField(f["name"], avro_type(f["type"], named)) for f in schema["fields"]])


def read_avro(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Avro container files below ``path``, each decoded by one task; columns are those of ``sample``, the first file by
    name if not given."""
    storage = Storage(spark)
    first = sample or next((p for p, _, d in storage.list(path) if not d and p.endswith(".avro")), path)
    schema = json.loads(avrofile._HEADER.read(_after_magic(storage.read(first)))["avro.schema"])
    kind = avro_type(schema)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = kind.names
        for d in parts:
            for c in d["content"]:
                batch: list[tuple] = []
                for r in avrofile.decode(bytes(c))[1]:
                    batch.append(tuple(r.get(n) for n in names))
                    if len(batch) == 10_000:
                        yield pd.DataFrame(batch, columns=names, dtype=object)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option(
        "recursiveFileLookup", True
    ).option("pathGlobFilter", "*.avro").load(path).select("content")
    return files.mapInPandas(rows, kind)


def _after_magic(data: bytes):
    import io

    src = io.BytesIO(data)
    if src.read(4) != avrofile.MAGIC:
        raise ValueError("no Avro container file")
    return src


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: Any = None, **options: Any) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    if kind == "avro":
        return read_avro(spark, path)
    r = spark.read.options(**options)
    return (r.schema(schema) if schema is not None else r).format(kind).load(path)


def write_files(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: Any) -> None:
    if kind not in FORMATS or kind == "avro":
        raise ValueError(f"{kind} can't be written")
    own = {"compression": "zstd"} if kind in ("parquet", "orc") else {}
    df.write.mode(mode).options(**own, **options).format(kind).save(path)


def read_database(
    spark: SparkSession, url: str, table: str, split: str | None = None, low: Any = None, high: Any = None,
    parts: int = 1, **options: Any
) -> DataFrame:
    """A table or query by JDBC, its schema taken from the driver; ``split`` with its bounds reads it in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split:
        r = r.option(
            "partitionColumn", split
        ).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def local_rows(spark: SparkSession, rows: list[Any], schema: Any = None) -> DataFrame:
    """A local list as a frame."""
    return spark.createDataFrame(rows, schema)
