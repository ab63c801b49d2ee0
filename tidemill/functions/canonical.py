"""Canonical JSON, for hashes of content: keys by UTF-16 unit, no white space, numbers in their shortest form.

A value's form follows from its type, so all but fractions are built in the JVM, at whatever depth. Fractions need the
shortest digits that read back as the same double, which Java 17 does not always give; values that hold any are written by an Arrow
UDF. Null is null, also as a field of a struct, which is written; what JSON has no form for (non-finite numbers, times, bytes) is an error.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes of control characters.
SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)


def utf16_order(key: str) -> bytes:
    """Keys sort by this: their UTF-16 units."""
    return key.encode("utf-16-be", "surrogatepass")


def quoted(text: Column) -> Column:
    """A string in quotes; only quotes, backslashes and control characters are escaped."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(0x20):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    plain = ~text.rlike(r'[\x00-\x1f"\\]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def _holds_fractions(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_fractions(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_fractions(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_fractions(kind.valueType)
    return isinstance(kind, _FRACTION)


def canonical(value: Column, kind: T.DataType | str) -> Column:
    """The canonical JSON of a column of type ``kind`` (a type or its DDL). Whole numbers are written in full, beyond 2^53 too."""
    if isinstance(kind, str):
        kind = T.StructType.fromDDL(f"v {kind}").fields[0].dataType
    _check(kind)
    return _by_arrow(kind)(value) if _holds_fractions(kind) else _native(value, kind)


def _check(kind: T.DataType) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _check(f.dataType)
    elif isinstance(kind, T.ArrayType):
        _check(kind.elementType)
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError("keys of an object are strings")
        _check(kind.valueType)
    elif not isinstance(kind, (*_WHOLE, *_FRACTION, T.StringType, T.BooleanType, T.NullType)):
        raise ValueError(f"JSON has no {kind.simpleString()}")


def _native(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        form = quoted(value)
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), _native(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: utf16_order(f.name))]
        form = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        form = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _native(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("order"), F.concat(quoted(e["key"]), F.lit(":"), _native(e["value"], kind.valueType)).alias("text"))
        entries = F.array_sort(F.transform(F.map_entries(value), entry))
        form = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["text"]), ","), F.lit("}"))
    else:
        form = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(form)


def number_text(x: float) -> str:
    """A double in the form of ECMAScript: the shortest digits, in full from 1e-6 to 1e21, with an exponent beyond."""
    if not math.isfinite(x):
        raise ValueError("JSON has no non-finite numbers")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = text + "0" * (point - len(text)) if point >= len(text) else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + text
    else:
        text = f"{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + text


def value_text(value: object) -> str:
    """The canonical JSON of Python values as ``json`` reads them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{value_text(k)}:{value_text(value[k])}" for k in sorted(value, key=utf16_order)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(value_text, value)) + "]"
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))
    if isinstance(value, (float, Decimal)):
        return number_text(float(value))
    return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else str(value)


def _plain(value: object, kind: T.DataType) -> object:
    """Arrow's values with maps, which come as pairs, as objects."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: _plain(x, kind.valueType) for k, x in value}
    return value


def _by_arrow(kind: T.DataType):
    @F.arrow_udf(T.StringType())
    def written(values: pa.Array) -> pa.Array:
        return pa.array([value_text(_plain(x, kind)) for x in values.to_pylist()], pa.string())

    return written


def strict_json(raw: str) -> object:
    """JSON as ECMAScript reads it: one value and nothing after it, doubles, the last of repeated keys; NaN and Infinity are none."""

    def refuse(name: str) -> float:
        raise ValueError(name)

    return json.loads(raw, parse_constant=refuse, parse_int=float)


@F.arrow_udf(T.StringType())
def canonical_text(raw: pa.Array) -> pa.Array:
    """The canonical form of JSON texts; null for what is null, no JSON, nested too deep to read, or holds a number beyond a double."""

    def form(text: str | None) -> str | None:
        try:
            return None if text is None else value_text(strict_json(text))
        except (ValueError, RecursionError):
            return None

    return pa.array([form(x) for x in raw.to_pylist()], pa.string())
