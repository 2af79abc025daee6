import pytest
from pyspark.sql import functions as F

from quillet import ExampleSchema, FeatureType, features_to_wide, file_schema, infer_schema, read_examples, wide_to_features, write_examples
from quillet.functions.features import FEATURES

I, FL, B = FeatureType.INT64, FeatureType.FLOAT, FeatureType.BYTES
NINE = ExampleSchema.builder().required("i", I).required("f", FL).required("b", B).optional("oi", I).optional("of", FL).optional("ob", B).repeated("ri", I).repeated("rf", FL).repeated("rb", B).named("nine")


def feature(ints=None, floats=None, data=None):
    return (ints, floats, data)


def maps(spark, records):
    return spark.createDataFrame([(r,) for r in records], "features " + FEATURES.simpleString())


def schema(*fields, name="x"):
    b = ExampleSchema.builder()
    for repetition, field, kind in fields:
        getattr(b, repetition)(field, kind)
    return b.named(name)


def test_forms_of_schema():
    assert ExampleSchema.from_json(NINE.to_json()) == NINE
    assert ExampleSchema.from_message(NINE.to_message()) == NINE and hash(ExampleSchema.from_message(str(NINE))) == hash(NINE)
    assert ExampleSchema.from_struct(NINE.to_struct(), "nine") == NINE
    assert "  required int64 i (INTEGER(64,true));\n  required float f;\n" in NINE.to_message()
    assert schema(("required", "a", I), ("required", "b", I)) != schema(("required", "b", I), ("required", "a", I))
    with pytest.raises(ValueError, match="Duplicate field name a"):
        schema(("required", "a", I), ("optional", "a", I))
    for bad, text in (("required int32 a;", "Unsupported primitive type: int32"), ("optional group a {}", "Only primitive fields")):
        with pytest.raises(ValueError, match=text):
            ExampleSchema.from_message("message m {\n" + bad + "\n}")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ex") / "evolution")
    rows = [{"r": feature([i]), **({"o": feature([i])} if i % 2 == 0 else {}), **({"l": feature(list(range(i)))} if i else {})} for i in range(10)]
    write_examples(maps(spark, rows), path, schema(("required", "r", I), ("optional", "o", I), ("repeated", "l", I), name="evolution"))
    return path


def test_round_trip(spark, tmp_path):
    row = {"i": feature([1]), "f": feature(None, [1.5]), "b": feature(None, None, [b"x"]), "oi": feature([2]), "rf": feature(None, [1.0, 2.0]), "rb": feature(None, None, [])}
    path = str(tmp_path / "nine")
    write_examples(maps(spark, [row]), path, NINE, compression="gzip")
    assert file_schema(spark, path).fields == NINE.fields
    got = read_examples(spark, path, form="map").first().features
    assert {k: tuple(v) for k, v in got.items()} == {"i": ([1], None, None), "f": (None, [1.5], None), "b": (None, None, [bytearray(b"x")]), "oi": ([2], None, None), "rf": (None, [1.0, 2.0], None)}
    wide = read_examples(spark, path).first()
    assert wide.rb is None and wide["of"] is None and wide.i == 1


def test_footer_and_projection(spark, stored):
    assert file_schema(spark, stored).names == ["r", "o", "l"]
    assert read_examples(spark, stored, fields=["l", "r", "l"]).columns == ["r", "l"]
    assert read_examples(spark, stored, schema=schema(("repeated", "l", I), ("required", "r", I))).columns == ["l", "r"]
    with pytest.raises(ValueError, match=r"Invalid fields: \[x, y, z\]"):
        read_examples(spark, stored, fields=["z", "y", "x", "r"])
    with pytest.raises(ValueError, match="Only one of"):
        read_examples(spark, stored, schema=NINE, fields=["r"])


@pytest.mark.parametrize("field", [("required", "o", I), ("optional", "l", I), ("required", "r", FL), ("required", "l", I)])
def test_incompatible(spark, stored, field):
    with pytest.raises(ValueError, match="The requested schema is not compatible with the file schema. incompatible types: "):
        read_examples(spark, stored, schema=schema(field))


def test_widening(spark, stored):
    df = read_examples(spark, stored, schema=schema(("repeated", "r", I), ("repeated", "o", I), ("optional", "x", I), ("repeated", "y", B)))
    rows = sorted(df.collect(), key=lambda r: r.r)
    assert [r.r for r in rows] == [[i] for i in range(10)] and [r.o for r in rows] == [[i] if i % 2 == 0 else None for i in range(10)]
    assert all(r.x is None and r.y is None for r in rows)
    assert sorted(r.r for r in read_examples(spark, stored, schema=schema(("optional", "r", I))).collect()) == list(range(10))
    with pytest.raises(Exception, match="Failed to decode R5#x: Required field size != 1: 0"):
        read_examples(spark, stored, schema=schema(("required", "x", I), name="R5")).collect()


def test_files_that_differ(spark, stored, tmp_path):
    other = str(tmp_path / "other")
    write_examples(maps(spark, [{"o": feature([7, 8])}]), other, schema(("repeated", "o", I)))
    df = read_examples(spark, [stored, other], schema=schema(("repeated", "o", I)))
    assert df.count() == 11 and [7, 8] in [r.o for r in df.collect()]
    with pytest.raises(ValueError, match="not compatible"):
        read_examples(spark, [stored, other], schema=schema(("optional", "o", I)))


def test_raw_lists_and_foreign_types(spark, tmp_path):
    for table, error in (("orders", "Unsupported primitive type: DOUBLE"), ("nation", "Unsupported primitive type: INT32")):
        with pytest.raises(ValueError, match=error):
            read_examples(spark, f"/root/testdata/sf0.001/{table}.parquet")
    nested = str(tmp_path / "nested")
    spark.range(1).select(F.struct("id").alias("s")).write.parquet(nested)
    with pytest.raises(ValueError, match="Only primitive fields"):
        read_examples(spark, nested)
    dated = str(tmp_path / "dated")
    spark.sql("select timestamp'1970-01-01 00:00:01' as t").write.option("outputTimestampType", "TIMESTAMP_MICROS").parquet(dated)
    if "INT96" not in spark.conf.get("spark.sql.parquet.outputTimestampType"):
        assert read_examples(spark, dated).first().t == 1_000_000


def test_write_rules(spark, tmp_path):
    one = schema(("required", "a", I))
    for row, error in (({}, "Required field size != 1: 0"), ({"a": feature([1, 2])}, "Required field size != 1: 2"), ({"a": feature(None, [1.0])}, "Required field size != 1: 0")):
        with pytest.raises(Exception, match=error):
            write_examples(maps(spark, [row]), str(tmp_path / "bad"), one, mode="overwrite")
    with pytest.raises(Exception, match="Required field size > 1: 2"):
        features_to_wide(maps(spark, [{"a": feature([1, 2])}]), schema(("optional", "a", I))).collect()
    loose = features_to_wide(maps(spark, [{"a": feature(None, [1.0]), "z": feature([1])}]), schema(("optional", "a", I), ("repeated", "b", FL)))
    assert [tuple(r) for r in loose.collect()] == [(None, None)]
    with pytest.raises(ValueError, match="without fields"):
        write_examples(maps(spark, [{}]), str(tmp_path / "none"), schema())


ABSENT = [{}, {"a": feature([]), "b": feature(None, []), "c": feature(None, None, [])}, {"a": (None, None, None), "b": (None, None, None), "c": (None, None, None)}]
ONE = {"a": feature([1]), "b": feature(None, [1.0]), "c": feature(None, None, [b"1"])}


@pytest.mark.parametrize("extra, want", [([], "required"), (ABSENT[:1], "optional"), (ABSENT[1:2], "optional"), (ABSENT[2:], "optional"), ([{"a": feature([1, 2]), "b": feature(None, [1.0, 2.0]), "c": feature(None, None, [b"", b""])}, {}], "repeated")])
def test_scanner(spark, extra, want):
    assert infer_schema(maps(spark, [ONE, *extra]), "s") == schema(*[(want, n, k) for n, k in zip("abc", (I, FL, B), strict=True)], name="s")


def test_scanner_edges(spark):
    assert infer_schema(maps(spark, [ABSENT[1]]), "s").fields == ()
    assert infer_schema(maps(spark, []), "s").fields == ()
    with pytest.raises(ValueError, match="Field type for a"):
        infer_schema(maps(spark, [ABSENT[2]]), "s")
    with pytest.raises(ValueError, match="Incompatible types for field a: "):
        infer_schema(maps(spark, [{"a": feature([1])}, {"a": feature(None, [])}]), "s")


def test_scanner_wide(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, 1.0, None)], "r bigint, o float, l array<bigint>")
    assert infer_schema(df, "w") == schema(("required", "r", I), ("optional", "o", FL), ("repeated", "l", I), name="w")
    same = schema(("repeated", "l", I), ("optional", "o", FL), ("required", "r", I), name="w")
    assert infer_schema(wide_to_features(df, same), "w") == same
