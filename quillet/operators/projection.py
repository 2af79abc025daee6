"""Typed projection: paths or record lambdas to a pruned schema, physically pruned on read."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.operators.paths import is_union, path_of, quoted


def project(struct: T.StructType, *paths: str) -> T.StructType:
    """Prunes ``struct`` to dotted ``paths``.

    Source order is kept, unknown names are ignored, and of a parent and its child the child wins."""
    return T.StructType(_pruned(struct, [tuple(p.split(".")) for p in paths]))


def _pruned(struct: T.StructType, paths: list[tuple[str, ...]]) -> list[T.StructField]:
    out = []
    for field in struct.fields:
        below = [p[1:] for p in paths if p[0] == field.name and len(p) > 1]
        if below:
            out.append(T.StructField(field.name, _descend(field.name, field.dataType, below), field.nullable, field.metadata))
        elif (field.name,) in paths:
            out.append(field)
    return out


def _descend(parent: str, dtype: T.DataType, below: list[tuple[str, ...]]) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return _branches(parent, dtype, below) if is_union(dtype) else T.StructType(_pruned(dtype, below))
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_descend(parent, dtype.elementType, below), dtype.containsNull)
    children = ", ".join(".".join(p) for p in below)
    raise TypeError(f"Projection doesn't support schema type {parent}:{dtype.typeName().upper()} with fields: {children}")


def _branches(parent: str, union: T.StructType, below: list[tuple[str, ...]]) -> T.StructType:
    """A path through a union prunes each of its branches; one that names a branch prunes that branch alone."""
    out = []
    for branch in union.fields:
        own = [p[1:] for p in below if p[0] == branch.name] + [p for p in below if p[0] not in union.names]
        if () in own:
            out.append(branch)
        elif own:
            out.append(T.StructField(branch.name, _descend(parent, branch.dataType, own), branch.nullable, branch.metadata))
    return T.StructType(out)


class Projection:
    """``Projection(struct, lambda r: r.email, lambda r: r.accounts[0].amount)``; ``schema`` is the pruned schema."""

    def __init__(self, struct: T.StructType, *getters: Callable[[Any], Any]) -> None:
        self.paths = [path_of(struct, g) for g in getters]
        self.schema = project(struct, *self.paths)

    @classmethod
    def of_paths(cls, struct: T.StructType, *paths: str) -> Projection:
        out = cls.__new__(cls)
        out.paths, out.schema = list(paths), project(struct, *paths)
        return out

    def read(self, spark: SparkSession, path: str | list[str]) -> DataFrame:
        """Scans only the leaves of the pruned schema."""
        return spark.read.schema(self.schema).parquet(*([path] if isinstance(path, str) else path))

    def apply(self, df: DataFrame) -> DataFrame:
        """Prunes a DataFrame already read; ``read`` is what prunes a file scan through arrays."""
        return df.select(*[_cut(quoted(f.name), df.schema[f.name].dataType, f.dataType).alias(f.name) for f in self.schema.fields])


def _cut(col: Column, was: T.DataType, to: T.DataType) -> Column:
    if was == to:
        return col
    if isinstance(to, T.StructType):
        kept = F.struct(*[_cut(col.getField(f.name), was[f.name].dataType, f.dataType).alias(f.name) for f in to.fields]) if to.fields else F.struct()
        return F.when(col.isNotNull(), kept)
    return F.transform(col, lambda x: _cut(x, was.elementType, to.elementType))
