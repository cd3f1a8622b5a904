"""Typed records: dataclasses to Spark and Arrow schemas, rows to records and back, polymorphic families, converters,
hooks, Arrow streams.

Declared on a field with ``dataclasses.field(metadata=column(...))``: another name, a position, another type, metadata,
a converter, or leaving it out.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import io
import json
import types
import typing
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Any, Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.sources.types import FIELD_ID, Primitive, SchemaError, from_spark, to_spark

R = TypeVar("R")


class Converter(Protocol):
    """Between a Python object and the value of one column."""

    spark_type: T.DataType

    def to_column(self, value: Any) -> Any: ...

    def from_column(self, value: Any) -> Any: ...


def column(
    name: str | None = None, order: int | None = None, type: T.DataType | str | None = None, ignore: bool = False,
    metadata: dict[str, str] | None = None, converter: Converter | None = None
) -> dict:
    """``type``: a Spark type, or the name of a logical type such as decimal(10,2) or timestamptz."""
    return {
        "quern": {
            "name": name, "order": order, "type": Primitive.parse(type).spark if isinstance(type, str) else type,
            "ignore": ignore, "metadata": metadata or {}, "converter": converter
        }
    }


# The column type of each Python type.
_SIMPLE: dict[Any, T.DataType] = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    bytearray: T.BinaryType(), memoryview: T.BinaryType(), decimal.Decimal: T.DecimalType(38, 18),
    dt.datetime: T.TimestampType(), dt.date: T.DateType(), dt.time: T.LongType(), dt.timedelta: T.DayTimeIntervalType(),
    uuid.UUID: T.StringType()
}


@dataclasses.dataclass(frozen=True)
class Member:
    attribute: str
    name: str
    hint: Any
    nullable: bool
    type: T.DataType
    metadata: dict
    converter: Any


def _opt(hint: Any) -> tuple[Any, bool]:
    """(the type without None, whether None was allowed)."""
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(rest) == 1:
            return rest[0], len(rest) < len(typing.get_args(hint))
        raise SchemaError("R003", f"{hint} is no column type")
    return hint, False


def spark_type(hint: Any) -> T.DataType:
    hint, _ = _opt(hint)
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if hint in _SIMPLE:
        return _SIMPLE[hint]
    if origin in (list, set, frozenset, tuple, Sequence, Iterable) or origin is not None and isinstance(
        origin, type
    ) and issubclass(origin, (list, set, frozenset, tuple, Sequence)):
        return T.ArrayType(spark_type(args[0]), _opt(args[0])[1])
    if origin is dict or origin is not None and isinstance(origin, type) and issubclass(origin, typing.Mapping):
        key = spark_type(args[0])
        if isinstance(key, T.MapType):
            raise SchemaError("R003", "a map can't be the key of a map")
        return T.MapType(key, spark_type(args[1]), _opt(args[1])[1])
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return T.StringType()
    if dataclasses.is_dataclass(hint):
        return schema_of(hint)
    raise SchemaError("R003", f"{hint} is no column type")


def members(cls: type) -> list[Member]:
    if not dataclasses.is_dataclass(cls):
        raise SchemaError("R001", f"{cls.__name__} is no dataclass")
    hints = typing.get_type_hints(cls)
    out: list[tuple[int, int, Member]] = []
    for i, f in enumerate(dataclasses.fields(cls)):
        o = f.metadata.get("quern", {})
        if o.get("ignore"):
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.init:
                raise SchemaError("R002", f"{cls.__name__}.{f.name} is left out and has no default")
            continue
        if not f.init:
            raise SchemaError("R005", f"{cls.__name__}.{f.name} can't be set when a record is read")
        inner, nullable = _opt(hints[f.name])
        conv = o.get("converter")
        kind = conv.spark_type if conv else o.get("type") or spark_type(inner)
        out.append(
            (
                o["order"] if o.get("order") is not None else 1 << 30, i,
                Member(f.name, o.get("name") or f.name, inner, nullable, kind, o.get("metadata", {}), conv)
            )
        )
    got = [m for _, _, m in sorted(out, key=lambda x: x[:2])]
    names = [m.name for m in got]
    if len(set(names)) < len(names):
        raise SchemaError(
            "R004", f"{cls.__name__} has two columns of one name: {sorted({n for n in names if names.count(n) > 1})}"
        )
    return got


def schema_of(cls: type, ids: bool = False) -> T.StructType:
    """The columns of a dataclass; with ``ids``, field ids are given depth-first from 1."""
    s = T.StructType([T.StructField(m.name, m.type, m.nullable, dict(m.metadata)) for m in members(cls)])
    if not ids:
        return s
    t = to_spark(from_spark(s)[0])
    return T.StructType(
        [
            T.StructField(a.name, b.dataType, a.nullable, {**(a.metadata or {}), **b.metadata}) for a,
            b in zip(s.fields, t.fields, strict=True)
        ]
    )


def _out(value: Any, hint: Any, conv: Any = None) -> Any:
    if value is None:
        return None
    if conv:
        return conv.to_column(value)
    hint, _ = _opt(hint)
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return value.name
    if hint is uuid.UUID:
        return str(value)
    if hint is dt.time:
        return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
    if hint is dt.datetime and value.tzinfo is None:
        return value.replace(tzinfo=dt.UTC)  # an instant, read as UTC
    if dataclasses.is_dataclass(hint):
        return to_row(value)
    if origin in (set, frozenset):
        return [_out(v, args[0]) for v in dict.fromkeys(value)]
    if origin is dict or origin is not None and isinstance(origin, type) and issubclass(origin, typing.Mapping):
        return {_out(k, args[0]): _out(v, args[1]) for k, v in value.items()}
    if args and not isinstance(value, (str, bytes)):
        return [_out(v, args[0]) for v in value]
    return bytes(value) if hint in (bytearray, memoryview) else value


def _in(value: Any, hint: Any, conv: Any = None) -> Any:
    if value is None:
        return None
    if conv:
        return conv.from_column(value)
    hint, _ = _opt(hint)
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return hint[value]
    if hint is uuid.UUID:
        return uuid.UUID(value)
    if hint is dt.time:
        return (dt.datetime.min + dt.timedelta(microseconds=value)).time()
    if hint is dt.datetime and value.tzinfo is not None:
        return value.astimezone(dt.UTC).replace(tzinfo=None)
    if dataclasses.is_dataclass(hint):
        return from_row(hint, value)
    if origin is dict or origin is not None and isinstance(origin, type) and issubclass(origin, typing.Mapping):
        pairs = value.items() if isinstance(value, dict) else value
        return {_in(k, args[0]): _in(v, args[1]) for k, v in pairs}
    if args:
        items = [_in(v, args[0]) for v in value]
        return origin(items) if origin in (set, frozenset, tuple) else items
    return hint(value) if hint in (bytes, bytearray, memoryview) else value


def _plain_time(value: Any, kind: T.DataType) -> Any:
    return value.replace(tzinfo=None) if isinstance(
        kind, T.TimestampNTZType
    ) and isinstance(value, dt.datetime) else value


def to_row(record: Any) -> tuple:
    """``before_serialize`` of the record, if it has one, is called first."""
    if hook := getattr(record, "before_serialize", None):
        hook()
    return tuple(
        _plain_time(_out(getattr(record, m.attribute), m.hint, m.converter), m.type) for m in members(type(record))
    )


def from_row(cls: type[R], row: Any) -> R:
    """``after_deserialize`` of the record, if it has one, is called last."""
    get = row.get if isinstance(row, dict) else row.__getitem__
    record = cls(**{m.attribute: _in(get(m.name), m.hint, m.converter) for m in members(cls)})
    if hook := getattr(record, "after_deserialize", None):
        hook()
    return record


def to_df(spark: SparkSession, records: Iterable[Any], cls: type | None = None) -> DataFrame:
    rows = list(records)
    kind = cls or type(rows[0])
    return spark.createDataFrame([to_row(r) for r in rows], schema_of(kind))


def from_df(df: DataFrame, cls: type[R]) -> list[R]:
    return [from_row(cls, r) for r in df.collect()]


def make_class(name: str, schema: T.StructType) -> type:
    """A dataclass for the rows of a schema, nested structs as dataclasses of their own."""

    def hint(t: T.DataType, at: str) -> Any:
        if isinstance(t, T.StructType):
            return make_class(at, t)
        if isinstance(t, T.ArrayType):
            h = hint(t.elementType, at)
            return list[h | None] if t.containsNull else list[h]
        if isinstance(t, T.MapType):
            h = hint(t.valueType, at)
            return dict[hint(t.keyType, at), h | None if t.valueContainsNull else h]
        py = next((p for p, s in _SIMPLE.items() if type(s) is type(t)), None)
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            return int
        return float if isinstance(t, T.FloatType) else dt.datetime if isinstance(t, T.TimestampNTZType) else py or str

    fields = []
    for f in schema.fields:
        h = hint(f.dataType, f"{name}_{f.name}")
        meta = {k: v for k, v in (f.metadata or {}).items() if k != FIELD_ID}
        fields.append(
            (f.name, h | None if f.nullable else h, dataclasses.field(metadata=column(type=f.dataType, metadata=meta)))
        )
    return dataclasses.make_dataclass(name, fields)


# Families of records in one table


@dataclasses.dataclass(frozen=True)
class Family:
    """Record classes told apart by a tag column: ``tags`` maps the tag to the class; columns are the union of all, each
    nullable."""

    tags: dict[str, type]
    tag_column: str = "$type"

    def schema(self) -> T.StructType:
        fields: dict[str, T.StructField] = {}
        for cls in self.tags.values():
            for m in members(cls):
                old = fields.get(m.name)
                if old and old.dataType != m.type:
                    raise SchemaError("R004", f"{m.name} has two types in one family")
                fields[m.name] = T.StructField(m.name, m.type, True, dict(m.metadata))
        return T.StructType([T.StructField(self.tag_column, T.StringType(), False), *fields.values()])

    def to_df(self, spark: SparkSession, records: Iterable[Any]) -> DataFrame:
        tags, names, rows = {c: t for t, c in self.tags.items()}, self.schema().names, []
        for r in records:
            if type(r) not in tags:
                raise SchemaError("tag", f"{type(r).__name__} is not in the family")
            own = dict(
                zip([m.name for m in members(type(r))], to_row(r), strict=True)
            ) | {self.tag_column: tags[type(r)]}
            rows.append(tuple(own.get(n) for n in names))
        return spark.createDataFrame(rows, self.schema())

    def from_df(self, df: DataFrame) -> list[Any]:
        out = []
        for r in df.collect():
            if r[self.tag_column] not in self.tags:
                raise SchemaError("tag", f"no class has the tag {r[self.tag_column]!r}")
            out.append(from_row(self.tags[r[self.tag_column]], r))
        return out

    def union(self, parts: dict[str, DataFrame]) -> DataFrame:
        """Frames of the single classes as one, at any size."""
        from functools import reduce

        from pyspark.sql import functions as F

        tagged = [d.withColumn(self.tag_column, F.lit(t)) for t, d in parts.items()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        have = set(df.columns)
        return df.select(
            *(
                F.col(
                    f"`{f.name}`"
                ) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema()
            )
        )


# Arrow


def to_arrow_schema(kind: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(kind)


def describe(cls: type) -> str:
    """The record's columns as JSON, for tools."""
    s = schema_of(cls)
    fields = [
        {
            "name": m.name, "attribute": m.attribute, "type": m.type.simpleString(), "nullable": m.nullable,
            "metadata": m.metadata
        } for m in members(cls)
    ]
    return json.dumps({"type": cls.__name__, "namespace": cls.__module__, "fields": fields, "schema": s.jsonValue()})


def _arrow_rows(records: Sequence[Any], cls: type):
    import pyarrow as pa

    def plain(v: Any, t: T.DataType) -> Any:
        if v is None:
            return None
        if isinstance(t, T.StructType):
            return {f.name: plain(x, f.dataType) for f, x in zip(t.fields, v, strict=True)}
        if isinstance(t, T.ArrayType):
            return [plain(x, t.elementType) for x in v]
        if isinstance(t, T.MapType):
            return [(plain(k, t.keyType), plain(x, t.valueType)) for k, x in v.items()]
        return v

    kind = schema_of(cls)
    return pa.Table.from_pylist([plain(to_row(r), kind) for r in records], schema=to_arrow_schema(kind))


def to_stream(records: Sequence[Any], out: io.IOBase, cls: type | None = None, batch: int = 16_384) -> None:
    """Records as an Arrow IPC stream in batches."""
    import pyarrow as pa

    t = _arrow_rows(records, cls or type(records[0]))
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t, max_chunksize=batch)


def to_bytes(records: Any, cls: type | None = None) -> bytes:
    """A record or a list of them as an Arrow IPC stream."""
    rows = list(records) if isinstance(records, (list, tuple)) else [records]
    out = io.BytesIO()
    to_stream(rows, out, cls)
    return out.getvalue()


def from_stream(cls: type[R], source: io.IOBase) -> list[R]:
    import pyarrow as pa

    return [from_row(cls, r) for r in pa.ipc.open_stream(source).read_all().to_pylist()]


def from_bytes(cls: type[R], data: bytes) -> list[R]:
    return from_stream(cls, io.BytesIO(data))


def df_to_stream(df: DataFrame, out: io.IOBase) -> None:
    """A result small enough for the driver as an Arrow IPC stream."""
    import pyarrow as pa

    t = df.toArrow()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)


class CStream:
    """A frame's rows through Arrow's C stream interface (``__arrow_c_stream__``), for other libraries in the process:
    batches come as they are asked for, a partition at a time."""

    def __init__(self, df: DataFrame):
        self.df = df

    def batches(self):
        import pyarrow as pa

        def packed(parts):  # each batch as one cell, in Arrow's own format
            for b in parts:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, b.schema) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["b"])

        for r in self.df.mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(bytes(r.b))

    def reader(self):
        import pyarrow as pa

        schema = to_arrow_schema(self.df.schema)
        return pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in self.batches()))

    def __arrow_c_stream__(self, requested_schema: Any = None):
        return self.reader().__arrow_c_stream__(requested_schema)


def foreach_batch(df: DataFrame, work: Callable[[Any], Iterable[Any]], schema: str):
    """Arrow batches of ``df`` through ``work`` on the executors."""
    return df.mapInArrow(lambda it: (b for x in it for b in work(x)), schema)
