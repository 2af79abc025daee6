"""Avro schema JSON to StructType: records, unions, arrays, maps and primitives, named types by reference."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

from quillet.operators.paths import BRANCH

_PRIMITIVES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(), "null": T.NullType()}


def parse_avsc(text: str) -> T.StructType:
    """One record's schema. Of a list of schemas, use ``parse_all``."""
    got = _parse(json.loads(text), {})[0]
    if not isinstance(got, T.StructType):
        raise TypeError("The schema isn't a record")
    return got


def parse_all(text: str) -> dict[str, T.StructType]:
    """Every record by name, of one schema or a list of them."""
    known: dict[str, T.DataType] = {}
    data = json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        _parse(x, known)
    return {k: v for k, v in known.items() if isinstance(v, T.StructType)}


def _union(branches: list[T.DataType]) -> T.DataType:
    """Numbers of two widths are the wider one; other unions are a struct with a nullable column for each branch."""
    for pair in ((T.IntegerType(), T.LongType()), (T.FloatType(), T.DoubleType())):
        if len(branches) == 2 and all(p in branches for p in pair):
            return pair[1]
    return T.StructType([T.StructField(f"member{i}", b, True, {BRANCH: i}) for i, b in enumerate(branches)])


def _parse(x: Any, known: dict[str, T.DataType]) -> tuple[T.DataType, bool]:
    """The type, and whether it can be null."""
    if isinstance(x, list):
        rest = [y for y in x if y != "null"]
        if not rest:
            return T.NullType(), True
        if len(rest) > 1:
            return _union([_parse(y, known)[0] for y in rest]), len(rest) < len(x)
        return _parse(rest[0], known)[0], len(rest) < len(x)
    if isinstance(x, str):
        if x not in _PRIMITIVES and x.split(".")[-1] not in known:
            raise TypeError(f"Unsupported type: {x}")
        return _PRIMITIVES.get(x) or known[x.split(".")[-1]], x == "null"
    kind = x["type"]
    if kind == "record":
        fields = []
        for f in x["fields"]:
            dtype, nullable = _parse(f["type"], known)
            fields.append(T.StructField(f["name"], dtype, nullable, {k: f[k] for k in ("doc", "default") if k in f}))
        known[x["name"]] = T.StructType(fields)
        return known[x["name"]], False
    if kind == "array":
        dtype, nullable = _parse(x["items"], known)
        return T.ArrayType(dtype, nullable), False
    if kind == "map":
        dtype, nullable = _parse(x["values"], known)
        return T.MapType(T.StringType(), dtype, nullable), False
    if kind == "enum":
        known[x["name"]] = T.StringType()
        return T.StringType(), False
    if kind == "fixed":
        known[x["name"]] = T.BinaryType()
        return T.BinaryType(), False
    return _parse(kind, known)
