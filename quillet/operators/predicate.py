"""Record lambdas compiled to filter columns that push down, with an equal row-level function.

Nulls follow the two-valued logic of Parquet's filters: equality treats null as a value (``<=>``), an ordering
comparison is never true for null, and neither is its negation. Zeros of either sign are equal, NaN is equal to
itself and greater than any number.
"""

from __future__ import annotations

import math
import struct as packing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.operators.paths import field_of, quoted

_FLIPPED = {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge", "eq": "eq", "ne": "ne"}
_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass(frozen=True)
class Predicates:
    """``native`` judges one Row or dict, ``column`` filters a DataFrame; they agree on every input."""

    native: Callable[[Any], bool]
    column: Column


class Predicate:
    """``Predicate(struct, lambda r: (r.x > 3) & ~(r.s == "a"))`` is a Column; ``Predicate.build`` gives both forms."""

    def __new__(cls, struct: T.StructType, condition: Callable[[Any], Any], coerce: str = "exact") -> Column:
        return cls.build(struct, condition, coerce).column

    @staticmethod
    def build(struct: T.StructType, condition: Callable[[Any], Any], coerce: str = "exact") -> Predicates:
        if coerce not in ("exact", "truncate"):
            raise ValueError(f"coerce is exact or truncate, not {coerce}")
        node = _condition(condition(Ref(struct, (), coerce)))
        return Predicates(lambda record: node.judge(record) is True, node.column())


def any_element(array: Ref, field: str, op: str, value: Any) -> Node:
    """True where any element's ``field`` compares so. An extension: indexed access reads one element."""
    if not isinstance(array, Ref) or not isinstance(array._dtype, T.ArrayType):
        raise ValueError("Invalid expression: any_element needs an array")
    element = Ref(field_of(array._dtype, array._path, field), (field,), array._coerce)
    return AnyElement(array, field, _compare(op, element, value))


class Node:
    def column(self) -> Column:
        raise NotImplementedError

    def judge(self, record: Any) -> bool | None:
        raise NotImplementedError

    def __and__(self, other: Any) -> Node:
        return Both("and", self, _condition(other))

    def __rand__(self, other: Any) -> Node:
        return Both("and", _condition(other), self)

    def __or__(self, other: Any) -> Node:
        return Both("or", self, _condition(other))

    def __ror__(self, other: Any) -> Node:
        return Both("or", _condition(other), self)

    def __invert__(self) -> Node:
        return Negated(self)

    def __bool__(self) -> bool:
        raise ValueError("Invalid expression: use &, | and ~ for and, or and not, and parentheses around comparisons")

    def __neg__(self) -> Node:
        raise ValueError("Unknown unary operator: -")

    __pos__ = __abs__ = __neg__

    def _unsupported(self, *_: Any) -> Any:
        raise ValueError("Unsupported operator type: only comparisons of a field with a value are")

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = _unsupported
    __floordiv__ = __rfloordiv__ = __mod__ = __rmod__ = __divmod__ = __rdivmod__ = __pow__ = __rpow__ = _unsupported
    __lshift__ = __rlshift__ = __rshift__ = __rrshift__ = __xor__ = __rxor__ = __matmul__ = __rmatmul__ = __contains__ = _unsupported


class Ref(Node):
    """A field of the record; compares with plain values only."""

    def __init__(self, dtype: T.DataType, path: tuple, coerce: str) -> None:
        self._dtype, self._path, self._coerce = dtype, path, coerce

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        if isinstance(self._dtype, T.ArrayType):
            raise ValueError(f"Invalid getter expression: {name} of an array needs an index")
        return Ref(field_of(self._dtype, self._path, name), (*self._path, name), self._coerce)

    def __getitem__(self, key: Any) -> Ref:
        if isinstance(key, str):
            return self.__getattr__(key)
        if isinstance(self._dtype, T.ArrayType) and isinstance(key, int) and key >= 0:
            return Ref(self._dtype.elementType, (*self._path, key), self._coerce)
        raise ValueError(f"Invalid getter expression: {key!r}")

    __hash__ = None  # type: ignore[assignment]

    def __gt__(self, v: Any) -> Node:
        return _compare("gt", self, v)

    def __lt__(self, v: Any) -> Node:
        return _compare("lt", self, v)

    def __ge__(self, v: Any) -> Node:
        return _compare("ge", self, v)

    def __le__(self, v: Any) -> Node:
        return _compare("le", self, v)

    def __eq__(self, v: Any) -> Node:  # type: ignore[override]
        return _compare("eq", self, v)

    def __ne__(self, v: Any) -> Node:  # type: ignore[override]
        return _compare("ne", self, v)

    def __and__(self, other: Any) -> Node:
        return _condition(self) & other

    def __or__(self, other: Any) -> Node:
        return _condition(self) | other

    def __invert__(self) -> Node:
        if not isinstance(self._dtype, T.BooleanType):
            raise ValueError("Unknown unary operator: ~ on a field that isn't boolean")
        return ~_condition(self)

    def column(self) -> Column:
        out = quoted(self._path[0])
        for step in self._path[1:]:
            out = F.get(out, F.lit(step)) if isinstance(step, int) else out.getField(step)
        return out

    def value(self, record: Any) -> Any:
        for step in self._path:
            if record is None:
                return None
            if isinstance(step, int):
                record = record[step] if step < len(record) else None
            else:
                record = record[step]
        return record


def _condition(node: Any) -> Node:
    if isinstance(node, Ref):
        if isinstance(node._dtype, T.BooleanType):
            return _compare("eq", node, True)
        raise ValueError(f"Invalid expression: {'.'.join(map(str, node._path)) or 'the record'} isn't a condition")
    if isinstance(node, Node):
        return node
    raise ValueError(f"Invalid expression: {node!r}")


def _compare(op: str, ref: Ref, value: Any) -> Node:
    if op not in _FLIPPED:
        raise ValueError(f"Unsupported operator type: {op}")
    if isinstance(value, Node):
        raise ValueError("Invalid expression: a field compares with a value, not with another field")
    dtype = ref._dtype
    if not isinstance(dtype, (*_INTEGERS, T.FloatType, T.DoubleType, T.BooleanType, T.StringType)):
        raise TypeError(f"Unsupported value type: {dtype.simpleString()}")
    if value is None:
        if op not in ("eq", "ne"):
            raise ValueError(f"value cannot be null for {op}")
        return Compare(op, ref, None)
    if isinstance(dtype, T.BooleanType):
        if not isinstance(value, bool) or op not in ("eq", "ne"):
            raise TypeError(f"Unsupported value type: {op} {value!r} on a boolean field")
        return Compare(op, ref, value)
    if isinstance(dtype, T.StringType):
        if not isinstance(value, str):
            raise TypeError(f"Unsupported value type: {value!r} on a string field")
        return Compare(op, ref, value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"Unsupported value type: {value!r} on a {dtype.simpleString()} field")
    if isinstance(dtype, T.DoubleType):
        return Compare(op, ref, float(value))
    if isinstance(dtype, T.FloatType):
        return Compare(op, ref, _float32(value))
    return _integral(op, ref, value, _INTEGERS[type(dtype)])


def _float32(value: float) -> float:
    try:
        return packing.unpack("f", packing.pack("f", value))[0]
    except OverflowError:
        return math.copysign(math.inf, value)


def _integral(op: str, ref: Ref, value: float, bits: int) -> Node:
    """Exact: a fraction moves to the next whole number, and what no value of the type can meet is constant."""
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    if ref._coerce == "truncate":
        if isinstance(value, float):  # as a JVM narrows: NaN is 0, the rest saturates
            wide = max(32, bits)
            value = 0 if math.isnan(value) else int(max(-(2.0 ** (wide - 1)), min(2.0 ** (wide - 1), value)))
            value = max(-(1 << wide - 1), min((1 << wide - 1) - 1, value))
        return Compare(op, ref, (value - low) % (1 << bits) + low)
    if isinstance(value, float) and math.isnan(value):
        return Constant(ref, op in ("lt", "le", "ne"), op in ("eq", "ne"))
    if isinstance(value, float) and math.isinf(value):
        value = high + 1 if value > 0 else low - 1
    if value != int(value):
        if op in ("eq", "ne"):
            return Constant(ref, op == "ne", True)
        op, value = ("lt", math.ceil(value)) if op in ("lt", "le") else ("gt", math.floor(value))
    value = int(value)
    if value > high or value < low:
        return Constant(ref, op == "ne" or (op in ("lt", "le")) == (value > high) and op != "eq", op in ("eq", "ne"))
    return Compare(op, ref, value)


@dataclass(frozen=True, eq=False)
class Compare(Node):
    op: str
    ref: Ref
    literal: Any

    def column(self) -> Column:
        col = self.ref.column()
        value = F.lit(self.literal).cast(self.ref._dtype)
        if self.op in ("eq", "ne"):
            same = col.eqNullSafe(value)
            return same if self.op == "eq" else ~same
        return {"gt": col > value, "lt": col < value, "ge": col >= value, "le": col <= value}[self.op]

    def judge(self, record: Any) -> bool | None:
        got = self.ref.value(record)
        if self.op in ("eq", "ne"):
            same = got is None if self.literal is None else got is not None and _key(got) == _key(self.literal)
            return same == (self.op == "eq")
        if got is None:
            return None
        a, b = _key(got), _key(self.literal)
        return {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b}[self.op]


def _key(value: Any) -> Any:
    if isinstance(value, float):
        return (1, 0.0) if math.isnan(value) else (0, value)
    return (0, value)


@dataclass(frozen=True, eq=False)
class Constant(Node):
    """What a comparison says of every value that isn't null; of null too if ``null_too``."""

    ref: Ref
    truth: bool
    null_too: bool

    def column(self) -> Column:
        return F.lit(self.truth) if self.null_too else F.when(self.ref.column().isNotNull(), F.lit(self.truth))

    def judge(self, record: Any) -> bool | None:
        return self.truth if self.null_too or self.ref.value(record) is not None else None


@dataclass(frozen=True, eq=False)
class Both(Node):
    op: str
    left: Node
    right: Node

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return a & b if self.op == "and" else a | b

    def judge(self, record: Any) -> bool | None:
        sides, decides = (self.left.judge(record), self.right.judge(record)), self.op == "or"
        if decides in sides:
            return decides
        return None if None in sides else not decides


@dataclass(frozen=True, eq=False)
class Negated(Node):
    of: Node

    def column(self) -> Column:
        return ~self.of.column()

    def judge(self, record: Any) -> bool | None:
        got = self.of.judge(record)
        return None if got is None else not got


@dataclass(frozen=True, eq=False)
class AnyElement(Node):
    array: Ref
    field: str
    test: Compare

    def column(self) -> Column:
        # over the field's own array, which the scan prunes to
        held = self.array.column().getField(self.field)
        literal = F.lit(self.test.literal).cast(self.test.ref._dtype)

        def met(x: Column) -> Column:
            same = x.eqNullSafe(literal)
            return {"eq": same, "ne": ~same, "gt": x > literal, "lt": x < literal, "ge": x >= literal, "le": x <= literal}[self.test.op]

        return F.coalesce(F.exists(held, lambda x: F.coalesce(met(x), F.lit(False))), F.lit(False))

    def judge(self, record: Any) -> bool | None:
        return any(self.test.judge(x) is True for x in self.array.value(record) or [] if x is not None)
