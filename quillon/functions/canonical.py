"""Canonical JSON as a column: keys in code-point order, no spaces, strings escaped as little as JSON allows, numbers in their shortest form; and its digest.

What a value looks like follows from its type alone, so equal values have equal text in every engine that writes canonical JSON.  Types without
floating-point numbers are columns and SQL functions only; with them the value goes through Arrow, for of the shortest forms of a number only the one nearest to
it will do, and SQL functions don't tell which that is.  A float counts as the double it is.  Infinities and NaN aren't JSON and raise an error; decimals,
dates and binary must be cast by the caller, who knows what they mean.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_CONTROL = {chr(c): _SHORT.get(chr(c), f"\\u{c:04x}") for c in range(32)}


def _text(x: Column) -> Column:
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for found, told in _CONTROL.items():
        escaped = F.replace(escaped, F.lit(found), F.lit(told))
    return F.concat(F.lit('"'), F.when(x.rlike("[\\x00-\\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _floating(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_floating(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _floating(kind.elementType)
    return _floating(kind.valueType) if isinstance(kind, MapType) else isinstance(kind, (DoubleType, FloatType))


def _checked(kind: DataType) -> None:
    if isinstance(kind, StructType):
        for f in kind.fields:
            _checked(f.dataType)
    elif isinstance(kind, ArrayType):
        _checked(kind.elementType)
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        _checked(kind.valueType)
    elif not isinstance(kind, (StringType, BooleanType, ByteType, ShortType, IntegerType, LongType, DoubleType, FloatType)):
        raise TypeError(f"{kind.simpleString()} has no canonical JSON; cast it first")


def _plain(value, kind: pa.DataType):
    """What Arrow gives, with maps as dictionaries."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return {k: _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind}
    return [_plain(v, kind.value_type) for v in value] if pa.types.is_list(kind) else value


def _dumped(values: pa.Array) -> pa.Array:
    told = (_plain(v, values.type) for v in values.to_pylist())
    return pa.array([json.dumps(v, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")) for v in told], pa.string())


def canonical_json(x: Column, kind: DataType) -> Column:
    """The canonical JSON of a column of this type; null is the word null."""
    _checked(kind)
    if _floating(kind):
        return F.arrow_udf(_dumped, StringType())(x)
    if isinstance(kind, StructType):
        parts: list[Column] = []
        for i, field in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.concat(F.lit("," if i else ""), _text(F.lit(field.name)), F.lit(":")), canonical_json(x[field.name], field.dataType)]
        out = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: canonical_json(y, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        names = F.array_sort(F.map_keys(x))
        entries = F.transform(names, lambda k: F.concat(_text(k), F.lit(":"), canonical_json(F.element_at(x, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, StringType):
        out = _text(x)
    else:
        out = x.cast("string")
    return F.when(x.isNull(), "null").otherwise(out)


def canonical_digest(x: Column, kind: DataType) -> Column:
    """sha256: and the digest of the canonical JSON's UTF-8."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(x, kind).cast("binary"), 256))
