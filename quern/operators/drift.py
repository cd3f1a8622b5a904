"""Schemas that drift between files: one consistent layout per table, and every change of a field.

Documents, rows and schemas alike, are loaded as maps from path to value with the raw JSON type kept. Statistics of
paths and types are aggregated by file, or by version of a schema, and typed columns are projected from the maps: ids,
names and types of fields from schemas, the columns of the layout from rows. What a cast can't take is reported with its
raw value, not dropped.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.snapshot_tables import location, number
from quern.session import materialise

# Path-value maps


class _Whole(str):
    """A JSON number without fraction or exponent, as written."""


class _Number(str):
    """Any other JSON number, as written."""


def read_json(text: str | None) -> Any:
    """``text`` as Python values with numbers as written; text that holds JSON text is read again. ValueError if it is
    none."""
    if text is None:
        raise ValueError("no text")
    try:
        top = json.loads(text, parse_int=_Whole, parse_float=_Number, parse_constant=_Number)
        while type(top) is str:
            top = json.loads(top, parse_int=_Whole, parse_float=_Number, parse_constant=_Number)
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    return top


def kind_of(x: Any) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    names = {_Whole: "integer", _Number: "number", str: "string", dict: "object", list: "array"}
    return names[type(x)]


def text_of(x: Any) -> str | None:
    """A value as text: strings and numbers as written, objects and arrays as JSON, null as None."""
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (dict, list)):
        return to_json(x)
    return str(x)


def to_json(x: Any) -> str:
    """JSON text without blanks, numbers as written."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{to_json(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(to_json, x)) + "]"
    if isinstance(x, (_Whole, _Number)):
        return str(x)
    return json.dumps(x, ensure_ascii=False)


def _step(name: str) -> str:
    return re.sub(r"([\\.\[\]{}])", r"\\\1", name)


def flatten(text: str | None) -> list[tuple[str, str, str | None]] | None:
    """(path, kind, value) of all that the JSON object ``text`` holds; None if it is no JSON object.

    Paths are like ``a.b[0].c``; what would be read as part of a path is escaped by a backslash in names. Objects and
    arrays have a row without value.
    """
    try:
        top = read_json(text)
    except ValueError:
        return None
    if not isinstance(top, dict):
        return None
    out, todo = [], [(_step(k), v) for k, v in reversed(top.items())]
    while todo:
        path, x = todo.pop()
        nested = isinstance(x, (dict, list))
        out.append((path, kind_of(x), None if nested else text_of(x)))
        if isinstance(x, dict):
            todo += [(f"{path}.{_step(k)}", v) for k, v in reversed(x.items())]
        elif nested:
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
    return out


_VALUES = "map<string,struct<kind:string,value:string>>"


def _flattened(texts):
    import pyarrow as pa

    offsets: list[int | None] = []
    paths, kinds, values = [], [], []
    seen: dict[str | None, list | None] = {}
    for t in texts.to_pylist():
        if t not in seen:
            seen[t] = flatten(t)
        got = seen[t]
        offsets.append(None if got is None else len(paths))
        for p, k, v in got or ():
            paths.append(p)
            kinds.append(k)
            values.append(v)
    offsets.append(len(paths))
    items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(paths, pa.string()), items)


def path_map(text: Column | str) -> Column:
    """The path-value map of JSON text, from path to (kind, value); null where it is no JSON object. Equal texts of a
    batch are read once."""
    return _once(_flattened, _VALUES)(text)


def _once(function: Any, kind: str) -> Any:
    """An Arrow function that the optimiser neither repeats nor moves, say below an aggregate that leaves fewer rows."""
    return F.arrow_udf(function, kind).asNondeterministic()


def path_values(rows: DataFrame) -> DataFrame:
    """``rows`` as (manifest_path, row_pos, payload, values): the payload and its path-value map; repeated rows are kept
    once."""
    at = rows.select(
        location("manifest_path").alias("manifest_path"), "row_pos", "payload", F.xxhash64("payload").alias("_h")
    )
    once = at.dropDuplicates(["manifest_path", "row_pos", "_h"]).drop("_h")
    return once.withColumn("values", path_map("payload"))


def path_statistics(rows: DataFrame) -> DataFrame:
    """(manifest_path, path, raw_type, n): how often each path holds which raw type, by file. Positions in arrays count
    as one path, ``[]``."""
    e = path_values(rows).select("manifest_path", F.explode("values").alias("path", "x"))
    path = F.regexp_replace("path", r"(?<!\\)\[\d+\]", "[]")
    return e.groupBy(
        "manifest_path", path.alias("path"), F.col("x.kind").alias("raw_type")
    ).agg(F.count("*").alias("n"))


# Schemas

#: Where the path-value map of a schema has fields and types that are objects.
_FIELD = re.compile(r"fields\[\d+\](?:\.type(?:\.(?:element|key|value))*\.fields\[\d+\])*")
_TYPE = re.compile(rf"{_FIELD.pattern}\.type(?:\.(?:element|key|value))*")
_WHOLE = re.compile(r"\s*([+-]?\d{1,18})\s*")


def project_schema(
    values: dict[str, tuple[str, str | None]] | None,
) -> tuple[int | None, list[tuple[int, str, str]], list[str]]:
    """(schema-id, fields, failed) from the path-value map of a schema: the typed columns of its fields.

    ``fields``: (field_id, name, type). Lists have a field ``element``, maps ``key`` and ``value``; the type of a struct,
    list or map is only its kind; blanks inside a type are dropped. ``failed``: the paths at which a schema needs what
    isn't there or can't be cast (``$``: it is no JSON object with fields).
    """
    values = values or {}

    def number_at(path: str, bits: int = 31) -> int | None:
        m = _WHOLE.fullmatch(values.get(path, ("", None))[1] or "")
        return int(m[1]) if m and -(1 << bits) <= int(m[1]) < 1 << bits else None

    def type_at(path: str) -> str | None:
        kind, value = values.get(path, ("", None))
        if kind == "object":
            return values.get(f"{path}.type", ("", None))[1]
        return re.sub(r"\s+", "", value) if kind == "string" else None

    sid = number_at("schema-id", 63)
    if values.get("fields", ("",))[0] != "array":
        return sid, [], ["$"]
    fields: list[tuple[int, str, str]] = []
    failed = []
    for path, (kind, _) in values.items():
        if path.endswith("]") and _FIELD.fullmatch(path):
            name_kind, name = values.get(f"{path}.name", ("", None))
            row = (number_at(f"{path}.id"), name if name_kind == "string" else None, type_at(f"{path}.type"))
            if kind != "object" or None in row:
                failed.append(path)
            else:
                fields.append(row)
        elif kind == "object" and path.endswith(("type", "element", "key", "value")) and _TYPE.fullmatch(path):
            own = values.get(f"{path}.type", ("", None))[1]
            parts = {"struct": (), "list": ("element",), "map": ("key", "value")}.get(own)
            rows = [(number_at(f"{path}.{n}-id"), n, type_at(f"{path}.{n}")) for n in parts or ()]
            lacks = own == "struct" and values.get(f"{path}.fields", ("",))[0] != "array"
            if parts is None or lacks or any(None in r for r in rows):
                failed.append(path)
            else:
                fields += rows
    return sid, fields, failed


_PROJECTED = (
    "struct<schema_id:bigint,fields:array<struct<field_id:int,name:string,type:string>>,failed:array<string>>"
)


def _projected(texts):
    import pyarrow as pa

    got = []
    for text in texts.to_pylist():
        flat = flatten(text)
        got.append(project_schema(None if flat is None else {p: (k, v) for p, k, v in flat}))
    field = pa.struct([("field_id", pa.int32()), ("name", pa.string()), ("type", pa.string())])
    rows = [[dict(zip(("field_id", "name", "type"), f, strict=True)) for f in fields] for _, fields, _ in got]
    return pa.StructArray.from_arrays(
        [
            pa.array([s for s, _, _ in got], pa.int64()), pa.array(rows, pa.list_(field)),
            pa.array([f for _, _, f in got], pa.list_(pa.string()))
        ],
        ["schema_id", "fields", "failed"],
    )


def schema_texts(manifests: DataFrame) -> DataFrame:
    """(table_id, header_id, schema, files): the distinct schema texts with the number of headers that have them.
    Headers without table_id are left out."""
    m = manifests.where("table_id is not null").select(
        F.col("table_id").cast("bigint").alias("table_id"), number("schema_id").alias("header_id"), "schema"
    )
    return m.groupBy("table_id", "header_id", "schema").agg(F.count("*").alias("files"))


def schema_documents(texts: DataFrame) -> DataFrame:
    """``texts`` (with header_id and schema) with ``schema_id``, ``fields`` and ``failed``: each schema projected from
    its path-value map by ``project_schema``. The id is the header's, else that in the JSON."""
    d = texts.withColumn("_d", _once(_projected, _PROJECTED)("schema"))
    sid = F.coalesce("header_id", "_d.schema_id").alias("schema_id")
    return d.select(*texts.columns, sid, F.col("_d.fields").alias("fields"), F.col("_d.failed").alias("failed"))


def unreadable_schemas(manifests: DataFrame) -> DataFrame:
    """(table_id, header_id, schema, files, failed): the schema texts that couldn't be read, in how many headers they
    are, and what failed."""
    return schema_documents(schema_texts(manifests)).where("size(failed) > 0").drop("schema_id", "fields")


def field_statistics(manifests: DataFrame) -> DataFrame:
    """(table_id, schema_id, field_id, name, type, files): in how many headers each version has a field under which name
    and type.

    Only readable schemas with an id count. A version without fields has a row without field_id.
    """
    d = schema_documents(schema_texts(manifests)).where("size(failed) = 0 and schema_id is not null")
    f = d.select(
        "table_id", "schema_id", "files", F.explode_outer("fields").alias("f")
    ).select("table_id", "schema_id", "files", "f.*")
    return f.groupBy("table_id", "schema_id", "field_id", "name", "type").agg(F.sum("files").alias("files"))


def versions(manifests: DataFrame) -> DataFrame:
    """(table_id, schema_id, field_id, name, type): the fields of each version of a table's schema, from
    ``field_statistics``.

    Where headers of one version differ about a field, the reading of most headers is taken, the greatest among equals.
    """
    s = field_statistics(manifests)
    best = s.groupBy("table_id", "schema_id", "field_id").agg(F.max(F.struct("files", "name", "type")).alias("x"))
    return best.select("table_id", "schema_id", "field_id", "x.name", "x.type")


def changes(manifests: DataFrame) -> DataFrame:
    """(table_id, from_schema_id, to_schema_id, field_id, change): what differs between neighbouring versions of a
    table.

    A window over the versions of a table finds the neighbours (versions, not files: few per table); fields are compared
    by id.
    """
    v = materialise(versions(manifests), "versions")
    after = Window.partitionBy("table_id").orderBy("schema_id")
    near = v.select("table_id", "schema_id").distinct().select(
        "table_id", "schema_id", F.lag("schema_id").over(after).alias("before_id"),
        F.lead("schema_id").over(after).alias("next_id")
    )
    f = v.where("field_id is not null").join(near, ["table_id", "schema_id"])
    new = f.where("before_id is not null").select(
        "table_id", F.col("before_id").alias("from_schema_id"), F.col("schema_id").alias("to_schema_id"), "field_id",
        "name", "type", F.lit(True).alias("new")
    )
    old = f.where("next_id is not null").select(
        "table_id", F.col("schema_id").alias("from_schema_id"), F.col("next_id").alias("to_schema_id"), "field_id",
        "name", "type", F.lit(False).alias("new")
    )
    pair = new.unionByName(old).groupBy("table_id", "from_schema_id", "to_schema_id", "field_id").agg(
        *(
            F.max(
                F.when(F.col("new") == side, F.col(c))
            ).alias(f"{c}_{side}".lower()) for c in ("name", "type") for side in (True, False)
        )
    )
    both = F.array(
        F.when(F.col("name_true") != F.col("name_false"), "renamed"),
        F.when(F.col("type_true") != F.col("type_false"), "retyped")
    )
    kinds = F.when(F.col("name_false").isNull(), F.array(F.lit("added"))).when(
        F.col("name_true").isNull(), F.array(F.lit("removed"))
    ).otherwise(F.filter(both, lambda x: x.isNotNull()))
    return pair.select("table_id", "from_schema_id", "to_schema_id", "field_id", F.explode(kinds).alias("change"))


# Rows in one layout


def _tree(kind: Any) -> Any:
    """A type of a schema document: its name, or [kind, {role or field id: (id, name, type)}]."""
    if isinstance(kind, str):
        return re.sub(r"\s+", "", kind)
    if kind["type"] == "struct":
        return ["struct", {str(f["id"]): (str(f["id"]), f["name"], _tree(f["type"])) for f in kind["fields"]}]
    parts = ("element",) if kind["type"] == "list" else ("key", "value")
    return [kind["type"], {p: (str(kind[f"{p}-id"]), p, _tree(kind[p])) for p in parts}]


def _routes(own: Any, latest: Any) -> Any:
    """How values of type ``own`` are laid out as ``latest``: a type name for leaves, else [kind, parts]; ``latest``
    None: the field is gone, its own type stays."""
    if latest is None:
        latest = own
    if isinstance(own, str) or isinstance(latest, str) or own[0] != latest[0]:
        return latest if isinstance(latest, str) else latest[0]
    if own[0] == "struct":
        parts = []
        for key, (fid, name, kind) in own[1].items():
            now = latest[1].get(key)
            parts.append([name, now[1] if now else f"{name}#{fid}", _routes(kind, now[2] if now else None)])
        gone = {p[1] for p in parts}
        return ["struct", parts, [n for k, (_, n, _) in latest[1].items() if k not in own[1] and n not in gone]]
    return [own[0], *(_routes(own[1][p][2], latest[1][p][2]) for p in own[1])]


def route_of(own: str | None, latest: str | None) -> str | None:
    """The way from the layout of one schema text to that of another, as JSON; None if ``own`` is no readable schema."""
    try:
        a = _tree(read_json(own) | {"type": "struct"})
        b = _tree(read_json(latest) | {"type": "struct"}) if latest is not None else None
        return json.dumps(_routes(a, b))
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None


_NESTED = ("struct", "list", "map")


def lay_out(text: str | None, route: Any) -> tuple[list[tuple], dict[str, str | None]]:
    """(leaves, columns) of a payload by a ``_routes`` (None: as it is): leaves as (path, type, kind, raw, is a map's
    key), columns as JSON text by name.

    Paths have the names of the layout: ``a.b`` for members, ``a[0]`` for elements, ``a{key}`` for the values of maps.
    """
    try:
        top = read_json(text)
    except ValueError:
        top = None
    if not isinstance(top, dict):
        top = {}
    leaves: list[tuple] = []

    def put(path: str, x: Any, way: Any) -> Any:
        """``x`` with the names of the layout; its leaves are noted."""
        if x is None:
            leaves.append((path, None, "null", None, False))
            return None
        if isinstance(way, list) and way[0] == "struct" and isinstance(x, dict):
            out = {}
            for old, new, w in way[1]:
                out[new] = put(f"{path}.{new}" if path else new, x.get(old), w)
            for new in way[2]:
                out[new] = put(f"{path}.{new}" if path else new, None, None)
            return out
        if isinstance(way, list) and way[0] == "list" and isinstance(x, list):
            return [put(f"{path}[{i}]", v, way[1]) for i, v in enumerate(x)]
        if isinstance(way, list) and way[0] == "map" and isinstance(x, dict):
            out = {}
            for k, v in x.items():
                if isinstance(way[1], str):
                    leaves.append((f"{path}{{{k}}}", way[1], "string", k, True))
                out[k] = put(f"{path}{{{k}}}", v, way[2])
            return out
        kind = way if isinstance(way, str) else way[0]
        leaves.append((path, kind, kind_of(x), text_of(x), False))
        return x

    if route is None:
        for k, v in top.items():
            leaves.append((k, None, kind_of(v), text_of(v), False))
        return leaves, {k: text_of(v) for k, v in top.items()}
    laid = put("", top, route)
    return leaves, {k: text_of(v) for k, v in (laid or {}).items()}


_LAID = "struct<leaves:array<struct<path:string,type:string,kind:string,raw:string,is_key:boolean>>,columns:map<string,string>>"


def _laid_out(texts, routes):
    import pyarrow as pa

    ways: dict[str | None, Any] = {None: None}
    rows = []
    for text, route in zip(texts.to_pylist(), routes.to_pylist(), strict=True):
        if route not in ways:
            ways[route] = json.loads(route)  # rows of one version have the same
        rows.append(lay_out(text, ways[route]))
    leaf = pa.struct(
        [
            ("path", pa.string()), ("type", pa.string()), ("kind", pa.string()), ("raw", pa.string()),
            ("is_key", pa.bool_())
        ]
    )
    names = [f.name for f in leaf]
    leaves = pa.array([[dict(zip(names, x, strict=True)) for x in a] for a, _ in rows], pa.list_(leaf))
    columns = pa.array([list(b.items()) for _, b in rows], pa.map_(pa.string(), pa.string()))
    return pa.StructArray.from_arrays([leaves, columns], ["leaves", "columns"])


def _routed(own, latest):
    import pyarrow as pa

    return pa.array([route_of(a, b) for a, b in zip(own.to_pylist(), latest.to_pylist(), strict=True)], pa.string())


def _casts(value: Column, kind: Column) -> Column:
    """``value`` (raw text) in the canonical text of ``kind``; null where it can't be cast. Text stays as it is; a
    nested kind takes no leaf."""
    whole = F.regexp_replace(value, r"^(-?\d+)\.0+$", "$1")
    plain = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value).otherwise(value.try_cast("decimal(38,18)").cast("string"))
    digits = F.ltrim(F.regexp_extract(plain, r"^-?(\d+)", 1), F.lit("0"))
    part = F.rtrim(F.regexp_extract(plain, r"\.(\d+)$", 1), F.lit("0"))
    limits = [F.regexp_extract(kind, r"\((\d+),(\d+)\)", g).try_cast("int") for g in (1, 2)]
    fits = plain.isNotNull() & (F.length(digits) <= limits[0] - limits[1]) & (F.length(part) <= limits[1])
    number_ = F.concat(
        F.when(plain.startswith("-") & (F.length(F.concat(digits, part)) > 0), "-").otherwise(""),
        F.when(digits == "", "0").otherwise(digits),
        F.when(limits[1] > 0, F.concat(F.lit("."), F.rpad(part, limits[1], F.lit("0")))).otherwise(""),
    )
    return (
        F.when(kind == "int", whole.try_cast("int").cast("string")).when(kind == "long", whole.try_cast("bigint").cast("string")) .when(kind == "float", value.try_cast("float").cast("string")).when(kind == "double", value.try_cast("double").cast("string")) .when(kind == "boolean", value.try_cast("boolean").cast("string")).when(kind == "date", value.try_cast("date").cast("string")) .when(
            kind.isin("timestamp", "timestamp_ns"), value.try_cast("timestamp_ntz").cast("string")
        ) .when(kind.isin("timestamptz", "timestamptz_ns"), value.try_cast("timestamp").cast("string")) .when(kind.startswith(
            "decimal"
        ), F.when(fits, number_)).when(kind.isin(*_NESTED), F.lit(None).cast("string")).otherwise(value)
    )


def _latest_texts(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest_path, table_id, schema_id) of every manifest, and (table_id, schema_id, route) of every readable
    version."""
    read = schema_documents(schema_texts(manifests)).select(
        "table_id", "header_id", "schema", F.md5("schema").alias("_text"), "schema_id",
        (F.size("failed") == 0).alias("good")
    )
    d = materialise(read, "schemas")
    own = manifests.select(
        location("manifest_path").alias("manifest_path"), F.col("table_id").cast("bigint").alias("table_id"),
        number("schema_id").alias("header_id"), F.md5("schema").alias("_text")
    ).where("table_id is not null")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("table_id", "header_id", "_text")]
    m = own.alias("m").join(d.alias("d"), same, "left").groupBy("m.manifest_path").agg(
        F.max("m.table_id").alias("table_id"), F.max("d.schema_id").alias("schema_id")
    )
    texts = d.where("good and schema_id is not null").groupBy("table_id", "schema_id").agg(F.min("schema").alias("own"))
    last = texts.groupBy("table_id").agg(F.max_by("own", "schema_id").alias("latest"))
    return m, texts.join(last, "table_id").select(
        "table_id", "schema_id", _once(_routed, "string")("own", "latest").alias("route")
    )


def consistent_rows(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """(table_id, manifest_path, row_pos, values, failed, columns): the rows in the layout of their table's latest
    version, at all levels.

    A value is found under the name its field id had in the schema the file was written with, and is given under the
    field's latest name, as the canonical text of its latest type; so are members of structs, elements of lists and
    values of maps. ``values``: map from path to text, of all leaves. A field that the latest version no longer has is
    given as ``name#id`` in its own type. ``failed``: array of (path, type, kind, raw) of the leaves that couldn't be
    cast, their JSON type and their value as it was; their value is null. ``columns``: the same layout as JSON text per
    column, values as they were. Absent and null values are null. Rows of a manifest without a readable schema keep
    their own names. An unreadable payload has no values but its fields' nulls.
    """
    m, routes = _latest_texts(manifests)
    written = m.join(routes, ["table_id", "schema_id"], "left")
    at = rows.select(
        location("manifest_path").alias("manifest_path"), "row_pos", "payload", F.xxhash64("payload").alias("_h")
    )
    once = at.dropDuplicates(["manifest_path", "row_pos", "_h"]).drop("_h")
    r = once.join(written, "manifest_path", "left").withColumn("_laid", _once(_laid_out, _LAID)("payload", "route"))
    cast = lambda x: F.struct(
        x["path"].alias("path"),
        F.when(x["type"].isNull(), x["raw"]).otherwise(_casts(x["raw"], x["type"])).alias("value"),
        x["type"].alias("type"), x["kind"].alias("kind"), x["raw"].alias("raw"), x["is_key"].alias("is_key")
    )
    r = r.withColumn("_cells", F.transform("_laid.leaves", cast))
    values = F.map_from_entries(
        F.array_distinct(
            F.transform(F.filter("_cells", lambda c: ~c["is_key"]), lambda c: F.struct(c["path"], c["value"]))
        )
    )
    bad = F.filter("_cells", lambda c: c["raw"].isNotNull() & c["value"].isNull())
    failed = F.transform(
        bad,
        lambda c: F.struct(
            c["path"].alias("path"), c["type"].alias("type"), c["kind"].alias("kind"), c["raw"].alias("raw")
        )
    )
    return r.select(
        "table_id", "manifest_path", "row_pos", values.alias("values"), failed.alias("failed"),
        F.col("_laid.columns").alias("columns")
    )


def failed_casts(consistent: DataFrame) -> DataFrame:
    """(table_id, path, type, kind, n, example): failed casts by table, path (positions and keys left out), type asked
    for and JSON type found."""
    f = consistent.select("table_id", F.explode("failed").alias("f"))
    path = F.regexp_replace(F.regexp_replace("f.path", r"\[\d+\]", "[]"), r"\{[^}]*\}", "{}")
    return f.groupBy("table_id", path.alias("path"), "f.type", "f.kind").agg(
        F.count("*").alias("n"), F.min("f.raw").alias("example")
    )


# Names of the format's types in Spark.
_SPARK = {
    "int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "date",
    "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "timestamp_ns": "timestamp_ntz",
    "timestamptz_ns": "timestamp"
}


def spark_type(kind: Any) -> str:
    """A type of ``_tree`` as DDL."""
    if isinstance(kind, str):
        return kind if kind.startswith("decimal") else _SPARK.get(kind, "string")
    if kind[0] == "struct":
        return "struct<" + ",".join(f"`{n}`:{spark_type(t)}" for _, n, t in kind[1].values()) + ">"
    parts = [spark_type(t) for _, _, t in kind[1].values()]
    return f"array<{parts[0]}>" if kind[0] == "list" else f"map<string,{parts[1]}>"


def typed_table(consistent: DataFrame, manifests: DataFrame, table_id: int) -> DataFrame:
    """The rows of one table as typed columns of its latest version, nested ones included (keys of maps as text), with
    _row_pos and _failed beside them.

    The driver reads that one schema. A leaf that couldn't be cast is null in its column and named in _failed.
    """
    own = schema_documents(
        schema_texts(manifests.where(F.col("table_id") == table_id))
    ).where("size(failed) = 0 and schema_id is not null")
    last = own.orderBy(F.desc("schema_id"), "schema").limit(1).select("schema").collect()
    fields = _tree(read_json(last[0].schema) | {"type": "struct"})[1].values() if last else []
    cols = []
    for _, name, kind in fields:
        path, raw = F.col("values")[name], F.col("columns")[name]
        typed = path.try_cast(
            T.DataType.fromDDL(spark_type(kind))
        ) if isinstance(kind, str) else F.from_json(raw, spark_type(kind))
        cols.append(typed.alias(name))
    return consistent.where(F.col("table_id") == table_id).select(
        *cols, F.col("row_pos").alias("_row_pos"), F.col("failed").alias("_failed")
    )

