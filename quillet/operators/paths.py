"""Record lambdas resolved to column paths by running them against a recording proxy."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Metadata key of the columns that stand for a union's branches, with the branch's number.
BRANCH = "union_branch"


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_union(struct: T.StructType) -> bool:
    return bool(struct.fields) and all(BRANCH in (f.metadata or {}) for f in struct.fields)


class RecordPath:
    """Stands for a record in a projection lambda; remembers the fields taken. Indexes into arrays leave no segment."""

    def __init__(self, dtype: T.DataType, path: tuple[str, ...] = ()) -> None:
        object.__setattr__(self, "_dtype", dtype)
        object.__setattr__(self, "_path", path)

    def __getattr__(self, name: str) -> RecordPath:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._child(name)

    def __getitem__(self, key: Any) -> RecordPath:
        if isinstance(key, str):
            return self._child(key)
        if isinstance(self._dtype, T.ArrayType):
            return RecordPath(self._dtype.elementType, self._path)
        raise ValueError(f"Invalid getter expression: {'.'.join(self._path)}[{key!r}]")

    def _child(self, name: str) -> RecordPath:
        return RecordPath(field_of(self._dtype, self._path, name), (*self._path, name))

    def __bool__(self) -> bool:
        raise ValueError(f"Invalid getter expression: {'.'.join(self._path)}")


def field_of(dtype: T.DataType, path: tuple, name: str) -> T.DataType:
    """The type of a field of a struct, or of an array of structs."""
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    if isinstance(dtype, T.StructType) and name in dtype.names:
        return dtype[name].dataType
    raise ValueError(f"Invalid getter expression: {'.'.join(map(str, (*path, name)))}")


def path_of(struct: T.StructType, getter: Callable[[Any], Any]) -> str:
    """The dotted path that the lambda reads."""
    got = getter(RecordPath(struct))
    if not isinstance(got, RecordPath) or not got._path:
        raise ValueError(f"Invalid getter expression: {got!r}")
    return ".".join(got._path)
