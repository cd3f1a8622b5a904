"""A small Avro object-container codec for manifests: any schema of records, unions, arrays, maps and primitives; codecs
null and deflate.

Files are decoded by the schema in their own header.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

MAGIC = b"Obj\x01"
_SIMPLE = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}


def _write_long(out: io.BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.write(bytes((n & 0x7F | 0x80,)))
        n >>= 7
    out.write(bytes((n,)))


def _read_long(src: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = src.read(1)
        if not b:
            raise EOFError("the file ends within a number")
        n |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _kind(schema: Any) -> str:
    return "union" if isinstance(schema, list) else schema if isinstance(schema, str) else schema["type"] if isinstance(
        schema["type"], str
    ) else "nested"


def _names(schema: Any, found: dict[str, Any]) -> dict[str, Any]:
    if isinstance(schema, list):
        for s in schema:
            _names(s, found)
    elif isinstance(schema, dict):
        if schema.get("name") and schema.get("type") in ("record", "fixed", "enum"):
            found[schema["name"]] = schema
        for key in ("fields", "items", "values", "type"):
            part = schema.get(key)
            for s in [
                f["type"] for f in part
            ] if key == "fields" and part else [part] if isinstance(part, (dict, list)) else []:
                _names(s, found)
    return found


class Codec:
    def __init__(self, schema: Any):
        self.schema, self.named = schema, _names(schema, {})

    def _branch(self, union: list, value: Any) -> int:
        for i, s in enumerate(union):
            k = _kind(self.named.get(s, s) if isinstance(s, str) else s)
            if (k == "null") == (value is None):
                return i
        raise ValueError(f"no branch of {union} takes {value!r}")

    def write(self, out: io.BytesIO, value: Any, schema: Any = None) -> None:
        schema = self.schema if schema is None else schema
        if isinstance(schema, str) and schema not in _SIMPLE:
            schema = self.named[schema]
        k = _kind(schema)
        if k == "union":
            i = self._branch(schema, value)
            _write_long(out, i)
            self.write(out, value, schema[i])
        elif k == "nested":
            self.write(out, value, schema["type"])
        elif k == "record":
            for f in schema["fields"]:
                self.write(out, value.get(f["name"], f.get("default")), f["type"])
        elif k == "array":
            if value:
                _write_long(out, len(value))
                for x in value:
                    self.write(out, x, schema["items"])
            _write_long(out, 0)
        elif k == "map":
            if value:
                _write_long(out, len(value))
                for key, x in value.items():
                    self.write(out, key, "string")
                    self.write(out, x, schema["values"])
            _write_long(out, 0)
        elif k in ("int", "long"):
            _write_long(out, int(value))
        elif k in ("string", "bytes"):
            data = value.encode() if k == "string" else bytes(value)
            _write_long(out, len(data))
            out.write(data)
        elif k == "boolean":
            out.write(b"\x01" if value else b"\x00")
        elif k == "fixed":
            out.write(value)
        elif k == "enum":
            _write_long(out, schema["symbols"].index(value))
        elif k in ("float", "double"):
            out.write(struct.pack("<f" if k == "float" else "<d", value))
        elif k != "null":
            raise ValueError(f"no such type: {k}")

    def read(self, src: io.BytesIO, schema: Any = None) -> Any:
        schema = self.schema if schema is None else schema
        if isinstance(schema, str) and schema not in _SIMPLE:
            schema = self.named[schema]
        k = _kind(schema)
        if k == "union":
            return self.read(src, schema[_read_long(src)])
        if k == "nested":
            return self.read(src, schema["type"])
        if k == "record":
            return {f["name"]: self.read(src, f["type"]) for f in schema["fields"]}
        if k in ("array", "map"):
            items: list = []
            while n := _read_long(src):
                if n < 0:
                    n = -n
                    _read_long(src)
                for _ in range(n):
                    items.append(
                        self.read(src, schema["items"]) if k == "array" else (
                            self.read(src, "string"), self.read(src, schema["values"])
                        )
                    )
            return items if k == "array" else dict(items)
        if k in ("int", "long"):
            return _read_long(src)
        if k in ("string", "bytes"):
            data = src.read(_read_long(src))
            return data.decode() if k == "string" else data
        if k == "boolean":
            return src.read(1) == b"\x01"
        if k == "fixed":
            return src.read(schema["size"])
        if k == "enum":
            return schema["symbols"][_read_long(src)]
        if k in ("float", "double"):
            size = 4 if k == "float" else 8
            return struct.unpack("<f" if size == 4 else "<d", src.read(size))[0]
        return None


_HEADER = Codec({"type": "map", "values": "bytes"})


def encode(
    schema: Any, rows: Iterable[dict], metadata: dict[str, str] | None = None, codec: str = "deflate", block: int = 4000
) -> bytes:
    out, sync, rec = io.BytesIO(), os.urandom(16), Codec(schema)
    out.write(MAGIC)
    _HEADER.write(
        out,
        {
            "avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()
        } | {k: v.encode() for k, v in (metadata or {}).items()}
    )
    out.write(sync)

    def flush(n: int, body: io.BytesIO) -> None:
        data = body.getvalue()
        if codec == "deflate":
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = z.compress(data) + z.flush()
        _write_long(out, n)
        _write_long(out, len(data))
        out.write(data + sync)

    n, body = 0, io.BytesIO()
    for row in rows:
        rec.write(body, row)
        n += 1
        if n == block:
            flush(n, body)
            n, body = 0, io.BytesIO()
    if n:
        flush(n, body)
    return out.getvalue()


def decode(data: bytes) -> tuple[dict[str, str], Iterator[dict]]:
    """(metadata of the header, rows)."""
    src = io.BytesIO(data)
    if src.read(4) != MAGIC:
        raise ValueError("no Avro container file")
    head = _HEADER.read(src)
    sync, rec, codec = src.read(16), Codec(json.loads(head["avro.schema"])), head.get("avro.codec", b"null")

    def rows() -> Iterator[dict]:
        while src.tell() < len(data):
            n, size = _read_long(src), 0
            size = _read_long(src)
            body = src.read(size)
            if codec == b"deflate":
                body = zlib.decompress(body, -15)
            elif codec != b"null":
                raise ValueError(f"codec {codec!r} is not supported")
            part = io.BytesIO(body)
            for _ in range(n):
                yield rec.read(part)
            if src.read(16) != sync:
                raise ValueError("the file is damaged: a block doesn't end in the sync mark")

    return {k: v.decode() for k, v in head.items() if not k.startswith("avro.")}, rows()
