"""Logical types of tables: parsing, JSON form, field ids, and their Spark types.

A schema is a struct whose fields, list elements and map entries carry ids. Spark columns keep the id in their metadata
(``parquet.field.id``), so that files are read by id whatever the columns were called when they were written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

FIELD_ID = "parquet.field.id"
LOGICAL = "quern.type"
_SIMPLE: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "binary": T.BinaryType(),
    # Without a Spark type of their own: nanoseconds and microseconds of the day as numbers, uuid as canonical text.
    "timestamp_ns": T.LongType(), "timestamptz_ns": T.LongType(), "time": T.LongType(), "uuid": T.StringType(),
}


class SchemaError(ValueError):
    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Primitive:
    name: str

    @staticmethod
    def parse(text: str) -> Primitive:
        t = re.sub(r"\s+", "", text.lower())
        if t in _SIMPLE or re.fullmatch(r"fixed\[\d+\]", t):
            return Primitive(t)
        if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", t):
            if not 1 <= int(m[1]) <= 38 or int(m[2]) > int(m[1]):
                raise SchemaError("type", f"{text}: precision is 1 to 38 and no less than the scale")
            return Primitive(t)
        raise SchemaError("type", f"no such type: {text}")

    @property
    def spark(self) -> T.DataType:
        if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", self.name):
            return T.DecimalType(int(m[1]), int(m[2]))
        return T.BinaryType() if self.name.startswith("fixed") else _SIMPLE[self.name]


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    required: bool
    type: Any
    doc: str | None = None
    initial_default: Any = None
    write_default: Any = None


@dataclass(frozen=True)
class Struct:
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class ListOf:
    element_id: int
    element_required: bool
    element: Any


@dataclass(frozen=True)
class MapOf:
    key_id: int
    key: Any
    value_id: int
    value_required: bool
    value: Any


@dataclass(frozen=True)
class Schema:
    struct: Struct
    schema_id: int = 0
    identifier_field_ids: tuple[int, ...] = ()

    def to_json(self) -> dict:
        out = type_to_json(self.struct) | {"schema-id": self.schema_id}
        return out | ({"identifier-field-ids": list(self.identifier_field_ids)} if self.identifier_field_ids else {})

    @staticmethod
    def from_json(x: dict) -> Schema:
        return Schema(type_from_json(x), x.get("schema-id", 0), tuple(x.get("identifier-field-ids", ())))

    def spark(self) -> T.StructType:
        return to_spark(self.struct)

    def last_id(self) -> int:
        return max((i for i, *_ in walk(self.struct)), default=0)

    def find(self, name: str) -> Field:
        """The field of a dotted name."""
        at: Any = self.struct
        found = None
        for part in name.split("."):
            found = next((f for f in getattr(at, "fields", ()) if f.name == part), None)
            if found is None:
                raise SchemaError("name", f"no field {name}")
            at = found.type
        return found


def type_to_json(t: Any) -> Any:
    if isinstance(t, Primitive):
        return t.name
    if isinstance(t, ListOf):
        return {
            "type": "list", "element-id": t.element_id, "element-required": t.element_required,
            "element": type_to_json(t.element)
        }
    if isinstance(t, MapOf):
        return {
            "type": "map", "key-id": t.key_id, "key": type_to_json(t.key), "value-id": t.value_id,
            "value-required": t.value_required, "value": type_to_json(t.value)
        }
    fields = []
    for f in t.fields:
        d = {"id": f.id, "name": f.name, "required": f.required, "type": type_to_json(f.type)}
        d |= {
            k: v for k,
            v in (
                ("doc", f.doc), ("initial-default", f.initial_default), ("write-default", f.write_default)
            ) if v is not None
        }
        fields.append(d)
    return {"type": "struct", "fields": fields}


def type_from_json(x: Any) -> Any:
    if isinstance(x, str):
        return Primitive.parse(x)
    if x["type"] == "list":
        return ListOf(x["element-id"], x.get("element-required", False), type_from_json(x["element"]))
    if x["type"] == "map":
        return MapOf(
            x["key-id"], type_from_json(x["key"]), x["value-id"], x.get("value-required", False),
            type_from_json(x["value"])
        )
    if x["type"] == "struct":
        return Struct(
            tuple(
                Field(
                    f["id"], f["name"], f.get("required", False), type_from_json(f["type"]), f.get("doc"),
                    f.get("initial-default"), f.get("write-default")
                ) for f in x["fields"]
            )
        )
    raise SchemaError("type", f"no such type: {x['type']}")


def to_spark(t: Any) -> T.DataType:
    if isinstance(t, Primitive):
        return t.spark
    if isinstance(t, ListOf):
        return T.ArrayType(to_spark(t.element), not t.element_required)
    if isinstance(t, MapOf):
        if isinstance(t.key, MapOf):
            raise SchemaError("type", "a map can't be the key of a map")
        return T.MapType(to_spark(t.key), to_spark(t.value), not t.value_required)
    return T.StructType([T.StructField(f.name, to_spark(f.type), not f.required, _field_metadata(f)) for f in t.fields])


#: Where Spark looks for the value of a column that a file doesn't have.
EXISTS_DEFAULT = "EXISTS_DEFAULT"


def _field_metadata(f: Field) -> dict:
    own: dict[str, Any] = {FIELD_ID: f.id}
    if isinstance(f.type, Primitive):
        if f.type.name in ("time", "uuid", "timestamp_ns", "timestamptz_ns") or f.type.name.startswith("fixed"):
            own[LOGICAL] = f.type.name
        if f.initial_default is not None:
            own[EXISTS_DEFAULT] = sql_literal(f.initial_default, f.type.spark)
    return own


def sql_literal(value: Any, kind: T.DataType) -> str:
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return str(value).lower()
    text = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return text if isinstance(kind, T.StringType) else f"CAST({text} AS {kind.simpleString()})"


def from_spark(t: T.DataType, start: int = 1) -> tuple[Any, int]:
    """(the logical type of a Spark type, the next free id): ids are given depth-first, a parent before its children."""
    return _from_spark(t, start, {})


def _from_spark(t: T.DataType, at: int, meta: dict) -> tuple[Any, int]:
    if LOGICAL in meta:
        return Primitive.parse(meta[LOGICAL]), at
    if isinstance(t, T.StructType):
        fields = []
        for f in t.fields:
            own, at = at, at + 1
            kind, at = _from_spark(f.dataType, at, f.metadata or {})
            fields.append(Field(own, f.name, not f.nullable, kind))
        return Struct(tuple(fields)), at
    if isinstance(t, T.ArrayType):
        own, at = at, at + 1
        kind, at = _from_spark(t.elementType, at, {})
        return ListOf(own, not t.containsNull, kind), at
    if isinstance(t, T.MapType):
        k, at = at, at + 1
        key, at = _from_spark(t.keyType, at, {})
        v, at = at, at + 1
        value, at = _from_spark(t.valueType, at, {})
        return MapOf(k, key, v, not t.valueContainsNull, value), at
    if isinstance(t, T.DecimalType):
        return Primitive(f"decimal({t.precision},{t.scale})"), at
    widened = {T.ByteType: "int", T.ShortType: "int", T.VarcharType: "string", T.CharType: "string"}
    for cls, name in widened.items():
        if isinstance(t, cls):
            return Primitive(name), at
    for name in ("boolean", "int", "long", "float", "double", "date", "timestamp", "timestamptz", "string", "binary"):
        if _SIMPLE[name] == t:
            return Primitive(name), at
    raise SchemaError("type", f"{t.simpleString()} has no logical type")


def walk(t: Any, path: str = "") -> list[tuple[int, str, Any]]:
    """(id, dotted path, type) of every node with an id."""
    out: list[tuple[int, str, Any]] = []
    join = lambda name: f"{path}.{name}" if path else name
    if isinstance(t, Struct):
        for f in t.fields:
            out += [(f.id, join(f.name), f.type), *walk(f.type, join(f.name))]
    elif isinstance(t, ListOf):
        out += [(t.element_id, join("element"), t.element), *walk(t.element, join("element"))]
    elif isinstance(t, MapOf):
        out += [
            (t.key_id, join("key"), t.key), *walk(t.key, join("key")), (t.value_id, join("value"), t.value),
            *walk(t.value, join("value"))
        ]
    return out


def same_type(a: Any, b: Any) -> bool:
    """Equal but for ids and docs."""
    if type(a) is not type(b):
        return False
    if isinstance(a, Primitive):
        return a == b
    if isinstance(a, ListOf):
        return a.element_required == b.element_required and same_type(a.element, b.element)
    if isinstance(a, MapOf):
        return a.value_required == b.value_required and same_type(a.key, b.key) and same_type(a.value, b.value)
    return len(a.fields) == len(b.fields) and all(
        x.name == y.name and x.required == y.required and same_type(x.type, y.type) for x,
        y in zip(a.fields, b.fields, strict=True)
    )


def name_mapping(schema: Schema) -> list[dict]:
    """The mapping from names to ids for files without ids."""

    def of(t: Any) -> list[dict]:
        if isinstance(t, Struct):
            return [
                {"field-id": f.id, "names": [f.name]} | (
                    {"fields": inner} if (inner := of(f.type)) else {}
                ) for f in t.fields
            ]
        if isinstance(t, ListOf):
            return [
                {"field-id": t.element_id, "names": ["element"]} | (
                    {"fields": inner} if (inner := of(t.element)) else {}
                )
            ]
        if isinstance(t, MapOf):
            return [
                {"field-id": i, "names": [n]} | ({"fields": inner} if (inner := of(x)) else {}) for i, n,
                x in ((t.key_id, "key", t.key), (t.value_id, "value", t.value))
            ]
        return []

    return of(schema.struct)


# Changes of a schema, each giving a new one.

_WIDER = {("int", "long"), ("float", "double")}


def add_column(
    s: Schema, name: str, kind: Any, last_id: int, required: bool = False, doc: str | None = None, default: Any = None
) -> tuple[Schema, int]:
    """``default``: what rows written before have in the column, and rows written without it from now on. Gives the
    schema and its last id."""
    if any(f.name == name for f in s.struct.fields):
        raise SchemaError("name", f"{name} is there already")
    t, nxt = (kind, last_id + 2) if not isinstance(kind, T.DataType) else from_spark(kind, last_id + 2)
    f = Field(last_id + 1, name, required, Primitive.parse(t) if isinstance(t, str) else t, doc, default, default)
    return replace(s, struct=Struct((*s.struct.fields, f)), schema_id=s.schema_id + 1), nxt - 1


def _with(s: Schema, name: str, change: Any) -> Schema:
    s.find(name)
    fields = tuple(change(f) if f.name == name else f for f in s.struct.fields)
    return replace(s, struct=Struct(tuple(f for f in fields if f is not None)), schema_id=s.schema_id + 1)


def drop_column(s: Schema, name: str) -> Schema:
    return _with(s, name, lambda f: None)


def rename_column(s: Schema, name: str, new: str) -> Schema:
    return _with(s, name, lambda f: replace(f, name=new))


def widen_column(s: Schema, name: str, kind: str) -> Schema:
    old, new = s.find(name).type.name, Primitive.parse(kind).name
    d1, d2 = re.fullmatch(r"decimal\((\d+),(\d+)\)", old), re.fullmatch(r"decimal\((\d+),(\d+)\)", new)
    if (old, new) not in _WIDER and not (d1 and d2 and d1[2] == d2[2] and int(d1[1]) <= int(d2[1])):
        raise SchemaError("type", f"{old} can't become {new}")
    return _with(s, name, lambda f: replace(f, type=Primitive(new)))
