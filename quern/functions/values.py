"""Values as text for people, and accessors that read a column as another type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How many bytes of a binary value are shown.
SHOWN_BYTES = 16


def format_value(c: Column, kind: T.DataType) -> Column:
    """``c`` as one line of text: null as ``null``, text as it is, binary as hex with its length where it is cut, times
    in ISO form, lists ``[a, b]``, maps ``{k: v}`` (entries in the order of their keys' text), structs ``{name:
    value}``; nested values in the same way."""
    if isinstance(kind, T.BinaryType):
        cut = F.concat(
            F.lower(F.hex(F.substring(c, 1, SHOWN_BYTES))),
            F.when(
                F.length(c) > SHOWN_BYTES, F.concat(F.lit("… ("), F.length(c).cast("string"), F.lit(" bytes)"))
            ).otherwise("")
        )
        text = F.concat(F.lit("0x"), cut)
    elif isinstance(kind, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + ("XXX" if isinstance(kind, T.TimestampType) else ""))
    elif isinstance(kind, T.DayTimeIntervalType):
        micros = (
            F.unix_micros(
                F.lit("1970-01-01").cast("timestamp") + c
            ) - F.unix_micros(F.lit("1970-01-01").cast("timestamp"))
        )
        text = F.concat((micros / 1e6).cast("decimal(30,6)").cast("string"), F.lit(" s"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(
            F.lit("["), F.array_join(F.transform(c, lambda x: format_value(x, kind.elementType)), ", "), F.lit("]")
        )
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(
            format_value(e["key"], kind.keyType), F.lit(": "), format_value(e["value"], kind.valueType)
        )
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(c), pair)), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}: "), format_value(c[f.name], f.dataType)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.array_join(F.array(*parts), ", ") if parts else F.lit(""), F.lit("}"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


_WHOLE = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def read_as(c: Column, kind: T.DataType, to: str, strict: bool = True) -> Column:
    """``c`` read as ``to``: any numeric width, text, boolean, date or time. Where the value does not fit (a whole
    number out of range, a fraction read as a whole number, text that is none) it is an error, or null if not
    ``strict``. Null stays null."""
    numeric = isinstance(kind, T.NumericType)
    got = c.try_cast(to)
    if to in _WHOLE and numeric:
        wide = c.try_cast("decimal(38,18)") if isinstance(kind, (T.FractionalType,)) else c.cast("decimal(38,0)")
        fits = (wide == F.floor(wide)) & wide.between(F.lit(-(1 << _WHOLE[to])), F.lit((1 << _WHOLE[to]) - 1))
        got = F.when(fits, got)
    if to == "boolean" and numeric:
        got = c != 0
    return F.when(
        c.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit(f"no {to}: "), c.cast("string"))).cast(to)
    ).otherwise(got) if strict else got
