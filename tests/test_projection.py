import pytest
from pyspark.sql import types as T

from quillet import Predicate, Projection, parse_avsc, project

PURCHASE = parse_avsc("""
{"type": "record", "name": "Purchase", "fields": [
  {"name": "number", "type": "int"}, {"name": "clerk", "type": "string"}, {"name": "remark", "type": ["null", "string"], "doc": "what was asked for"},
  {"name": "lines", "type": {"type": "array", "items": {"type": "record", "name": "Line", "fields": [{"name": "part", "type": "int"}, {"name": "unit", "type": "string"}, {"name": "quantity", "type": "int"}]}}},
  {"name": "place", "type": ["null", {"type": "record", "name": "Place", "fields": [{"name": "dock", "type": "string"}, {"name": "gate", "type": "string"}]}]},
  {"name": "marks", "type": {"type": "map", "values": "string"}}]}
""")
DATA = [(1, "ann", "soon", [(7, "box", 10), (8, "bag", 20)], ("north", "g1"), {"k": "v"}), (2, "bo", None, [], None, {})]


def names(struct):
    return struct.simpleString()


def test_avsc():
    assert PURCHASE["remark"].nullable and not PURCHASE["number"].nullable and PURCHASE["remark"].metadata == {"doc": "what was asked for"}
    with pytest.raises(TypeError, match="Unsupported type: text"):
        parse_avsc('{"type": "record", "name": "X", "fields": [{"name": "u", "type": "text"}]}')


def test_unions():
    """A union of several branches is a struct of them; paths through it prune every branch, and keep its nullability."""
    side = '{"type": "record", "name": "%s", "fields": [{"name": "a", "type": "int"}, {"name": "b", "type": "int"}]}'
    union = parse_avsc(f'{{"type": "record", "name": "X", "fields": [{{"name": "u", "type": [{side % "P"}, "null", {side % "Q"}]}}, {{"name": "n", "type": ["int", "long"]}}, {{"name": "m", "type": ["int", "string"]}}]}}')
    assert names(union["m"].dataType) == "struct<member0:int,member1:string>" and names(union["n"].dataType) == "bigint"
    assert names(project(union, "u.b")) == "struct<u:struct<member0:struct<b:int>,member1:struct<b:int>>>"
    assert names(project(union, "u.member1.a")) == "struct<u:struct<member1:struct<a:int>>>"
    assert project(union, "u.b")["u"].nullable and not project(union, "n")["n"].nullable
    with pytest.raises(TypeError, match="m:INTEGER with fields: x"):
        project(union, "m.x")


def test_odd_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a``b` int, `c.d` int")
    assert Projection(df.schema, lambda r: r["a`b"]).apply(df).columns == ["a`b"]
    assert df.filter(Predicate(df.schema, lambda r: (r["a`b"] == 1) & (r["c.d"] > 1))).count() == 1


def test_paths_and_schema():
    p = Projection(PURCHASE, lambda r: r.place.gate, lambda r: r.number, lambda r: r.lines[7].quantity)
    assert p.paths == ["place.gate", "number", "lines.quantity"]
    assert names(p.schema) == "struct<number:int,lines:array<struct<quantity:int>>,place:struct<gate:string>>"
    assert p.schema["place"].nullable


def test_two_leaves_below_one_array():
    p = Projection(PURCHASE, lambda r: r.lines[0].quantity, lambda r: r.lines[3].part)
    assert names(p.schema) == "struct<lines:array<struct<part:int,quantity:int>>>"


def test_string_paths():
    assert names(project(PURCHASE, "place", "place.gate")) == "struct<place:struct<gate:string>>"
    assert names(project(PURCHASE, "nothing", "number", "place.nothing")) == "struct<number:int,place:struct<>>"
    assert names(project(PURCHASE, "lines")) == "struct<lines:array<struct<part:int,unit:string,quantity:int>>>"
    assert names(project(PURCHASE)) == "struct<>"
    with pytest.raises(TypeError, match="Projection doesn't support schema type marks:MAP with fields: k"):
        project(PURCHASE, "marks.k")
    with pytest.raises(TypeError, match="number:INTEGER"):
        project(PURCHASE, "number.x")


@pytest.mark.parametrize("getter", [lambda r: r.nothing, lambda r: r, lambda r: r.number[0], lambda r: r.place.nothing, lambda r: 1, lambda r: r.marks["k"]])
def test_bad_getters(getter):
    with pytest.raises(ValueError, match="Invalid getter expression"):
        Projection(PURCHASE, getter)


def test_apply_and_read(spark, tmp_path, capsys):
    df = spark.createDataFrame(DATA, PURCHASE)
    p = Projection(PURCHASE, lambda r: r.place.gate, lambda r: r.lines[0].quantity, lambda r: r.remark)
    want = [("soon", [(10,), (20,)], ("g1",)), (None, [], None)]
    plain = lambda d: [(r.remark, [tuple(x) for x in r.lines], r.place and tuple(r.place)) for r in d.orderBy("remark", ascending=False).collect()]
    assert plain(p.apply(df)) == want
    path = str(tmp_path / "purchases")
    df.write.parquet(path)
    got = p.read(spark, path)
    assert plain(got) == want
    got.explain()
    assert "ReadSchema: struct<remark:string,lines:array<struct<quantity:int>>,place:struct<gate:string>>" in capsys.readouterr().out
    slim = T.StructType([PURCHASE["clerk"], PURCHASE["number"]])
    assert [tuple(r) for r in spark.read.schema(slim).parquet(path).orderBy("number").collect()] == [("ann", 1), ("bo", 2)]


def test_null_arrays(spark):
    """An array that may be null stays null under a projection of its elements."""
    kind = T.StructType.fromDDL("number int, lines array<struct<part: int, quantity: int>>")
    out = Projection(kind, lambda r: r.lines[0].quantity).apply(spark.createDataFrame([(1, None), (2, [(7, 3)])], kind))
    assert sorted([r.lines and [tuple(x) for x in r.lines] for r in out.collect()], key=str) == [None, [(3,)]]
