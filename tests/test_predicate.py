import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import types as T

from quillet import Predicate, any_element

S = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("int_field", T.IntegerType()),
        T.StructField("long_field", T.LongType()),
        T.StructField("float_field", T.FloatType()),
        T.StructField("double_field", T.DoubleType()),
        T.StructField("boolean_field", T.BooleanType()),
        T.StructField("string_field", T.StringType()),
        T.StructField("address", T.StructType([T.StructField("zip", T.StringType())])),
        T.StructField("accounts", T.ArrayType(T.StructType([T.StructField("amount", T.IntegerType())]))),
    ]
)
ROWS = [
    (0, 10, 20, 30.0, 40.0, True, "test", ("z1",), [(1,), (20,)]),
    (1, None, None, None, None, None, None, None, None),
    (2, 11, -5, math.nan, math.nan, False, "", ("z2",), []),
    (3, -2147483648, 2**63 - 1, -0.0, 0.0, True, "tesu", (None,), [(None,)]),
    (4, 9, 2**53 + 1, 30.1, -1e300, False, "\U0001f600", ("",), [(30,)]),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, S)


def both(df, condition, coerce="exact"):
    p = Predicate.build(S, condition, coerce)
    column = sorted(r.id for r in df.filter(p.column).collect())
    assert column == sorted(r.id for r in df.collect() if p.native(r))
    return column


CASES = [
    (lambda r: r.int_field > 10, [2]),
    (lambda r: 10 < r.int_field, [2]),
    (lambda r: r.int_field >= 10.0, [0, 2]),
    (lambda r: r.int_field < 10.9, [0, 3, 4]),
    (lambda r: r.int_field == 10.5, []),
    (lambda r: r.int_field != 10.5, [0, 1, 2, 3, 4]),
    (lambda r: r.int_field < 2**40, [0, 2, 3, 4]),
    (lambda r: ~(r.int_field < 2**40), []),
    (lambda r: r.int_field > 2**40, []),
    (lambda r: r.int_field > math.inf, []),
    (lambda r: r.long_field == 2**53 + 1, [4]),
    (lambda r: r.long_field <= 20.0, [0, 2]),
    (lambda r: r.float_field == 30.1, [4]),
    (lambda r: r.float_field == 0.0, [3]),
    (lambda r: r.float_field > 1e39, [2]),
    (lambda r: r.double_field >= math.nan, [2]),
    (lambda r: r.boolean_field, [0, 3]),
    (lambda r: ~r.boolean_field, [1, 2, 4]),
    (lambda r: r.boolean_field == False, [2, 4]),  # noqa: E712
    (lambda r: r.string_field == None, [1]),  # noqa: E711
    (lambda r: r.string_field != None, [0, 2, 3, 4]),  # noqa: E711
    (lambda r: r.string_field > "test", [3, 4]),
    (lambda r: r.string_field != "te" + "st", [1, 2, 3, 4]),
    (lambda r: ~(r.string_field == "test") & (r.int_field > 0), [2, 4]),
    (lambda r: r.boolean_field | (r.int_field == None), [0, 1, 3]),  # noqa: E711
    (lambda r: r.address.zip == "z1", [0]),
    (lambda r: r.address.zip != "z1", [1, 2, 3, 4]),
    (lambda r: r.accounts[0].amount > 1, [4]),
    (lambda r: r.accounts[1].amount == None, [1, 2, 3, 4]),  # noqa: E711
    (lambda r: any_element(r.accounts, "amount", "gt", 10), [0, 4]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rows(df, i):
    condition, ids = CASES[i]
    assert both(df, condition) == ids


def test_truncated_literals(df):
    assert both(df, lambda r: r.int_field < 10.9, "truncate") == [3, 4]
    assert both(df, lambda r: r.int_field == 2**32 + 10, "truncate") == [0]


def test_plain_dicts():
    p = Predicate.build(S, lambda r: (r.int_field > 3) | r.boolean_field)
    assert p.native({"int_field": 4, "boolean_field": None}) and not p.native({"int_field": None, "boolean_field": None})
    assert p.native(Row(int_field=1, boolean_field=True))


@pytest.mark.parametrize(
    "condition, error",
    [
        (lambda r: r.int_field > r.long_field, "Invalid expression"),
        (lambda r: 1 < 2, "Invalid expression"),
        (lambda r: r.int_field + 1 > 2, "Unsupported operator type"),
        (lambda r: -r.int_field, "Unknown unary operator"),
        (lambda r: ~r.int_field, "Unknown unary operator"),
        (lambda r: r.int_field, "Invalid expression"),
        (lambda r: r.int_field > "a", "Unsupported value type"),
        (lambda r: r.int_field == True, "Unsupported value type"),  # noqa: E712
        (lambda r: r.string_field > 1, "Unsupported value type"),
        (lambda r: r.boolean_field > True, "Unsupported value type"),
        (lambda r: r.address == "a", "Unsupported value type"),
        (lambda r: r.int_field > None, "cannot be null"),
        (lambda r: r.nothing > 1, "Invalid getter expression"),
        (lambda r: r.int_field > 1 and r.long_field > 1, "use &"),
        (lambda r: 1 < r.int_field < 3, "use &"),
    ],
)
def test_errors(spark, condition, error):
    with pytest.raises((ValueError, TypeError), match=error):
        Predicate.build(S, condition)


OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b}
LEAF = st.one_of(
    st.tuples(st.just("int_field"), st.sampled_from(list(OPS)), st.one_of(st.sampled_from([9, 10, 11, 10.5, 2**33, -(2**33), math.nan, -math.inf]))),
    st.tuples(st.just("double_field"), st.sampled_from(list(OPS)), st.sampled_from([0.0, -0.0, 40.0, math.nan, math.inf])),
    st.tuples(st.just("string_field"), st.sampled_from(list(OPS)), st.sampled_from(["", "test", "￿"])),
    st.tuples(st.sampled_from(["int_field", "double_field", "string_field", "boolean_field"]), st.sampled_from(["eq", "ne"]), st.none()),
    st.tuples(st.just("boolean_field"), st.sampled_from(["eq", "ne"]), st.booleans()),
)
TREE = st.recursive(LEAF, lambda t: st.one_of(st.tuples(st.just("and"), t, t), st.tuples(st.just("or"), t, t), st.tuples(st.just("not"), t)), max_leaves=6)


def build(tree, r):
    if tree[0] == "and":
        return build(tree[1], r) & build(tree[2], r)
    if tree[0] == "or":
        return build(tree[1], r) | build(tree[2], r)
    if tree[0] == "not":
        return ~build(tree[1], r)
    return OPS[tree[1]](getattr(r, tree[0]), tree[2])


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree=TREE)
def test_native_and_column_agree(df, tree):
    both(df, lambda r: build(tree, r))
