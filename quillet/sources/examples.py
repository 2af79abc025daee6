"""Example records in Parquet: scans with projection and evolution checks, and the writer.

Footers are read through Hadoop's file systems, so any path that Spark reads will do. Checks on single records run
when their column is read; a plan that prunes the column, such as a count, skips them.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.features import checked, features_to_wide, is_map_form, wide_to_features
from quillet.plans.scanner import infer_schema
from quillet.plans.schema import ExampleSchema, FeatureType, Field, Repetition

#: Footers that the driver reads at the same time.
_AT_ONCE = 32
_INCOMPATIBLE = "The requested schema is not compatible with the file schema."


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    conf, jvm, out = spark._jsc.hadoopConfiguration(), spark._jvm, []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for top in fs.globStatus(path) or []:
            if top.isFile():
                out.append(top.getPath().toString())
                continue
            walk = fs.listFiles(top.getPath(), True)
            below = []
            while walk.hasNext():
                f = walk.next().getPath()
                if not f.getName().startswith(("_", ".")):
                    below.append(f.toString())
            out += sorted(below)
    if not out:
        raise ValueError(f"No Parquet files in {paths}")
    return out


def _message(spark: SparkSession, file: str):  # noqa: ANN202
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getFooter().getFileMetaData().getSchema()
    finally:
        reader.close()


def _footers(spark: SparkSession, files: list[str]) -> list[ExampleSchema]:
    """The schema of every file, in order. Footers are read side by side, and equal ones are taken apart once."""
    known: dict[str, ExampleSchema] = {}

    def one(file: str) -> ExampleSchema:
        message = _message(spark, file)
        text = message.toString()
        if text not in known:
            known[text] = ExampleSchema(message.getName(), tuple(_field(message.getType(i)) for i in range(message.getFieldCount())))
        return known[text]

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        return list(pool.map(one, files))


def _field(column) -> Field:  # noqa: ANN001
    repetition = Repetition[column.getRepetition().toString()]
    leaf = column
    if not column.isPrimitive():
        note = column.getLogicalTypeAnnotation()
        group = column.asGroupType()
        if note is None or note.toString() != "LIST" or group.getFieldCount() != 1:
            raise ValueError("Only primitive fields are supported")
        leaf = group.getType(0)
        if not leaf.isPrimitive():
            if leaf.asGroupType().getFieldCount() != 1 or not leaf.asGroupType().getType(0).isPrimitive():
                raise ValueError("Only primitive fields are supported")
            leaf = leaf.asGroupType().getType(0)
        repetition = Repetition.REPEATED
    return Field(column.getName(), FeatureType.of_parquet(leaf.asPrimitiveType().getPrimitiveTypeName().toString()), repetition)


def file_schema(spark: SparkSession, path: str) -> ExampleSchema:
    """The schema in the footer of the first file."""
    return _footers(spark, _files(spark, [path])[:1])[0]


def _check(requested: ExampleSchema, held: ExampleSchema) -> None:
    """Widening only: required to optional or repeated, optional to repeated. New fields are the rows' business."""
    rank = {Repetition.REQUIRED: 0, Repetition.OPTIONAL: 1, Repetition.REPEATED: 2}
    known = {f.name: f for f in held.fields}
    for f in requested.fields:
        had = known.get(f.name)
        if had and (had.type is not f.type or rank[had.repetition] > rank[f.repetition]):
            raise ValueError(f"{_INCOMPATIBLE} incompatible types: {f.message()} != {had.message()}")


def read_examples(spark: SparkSession, path: str | list[str], schema: ExampleSchema | None = None, fields: list[str] | None = None, form: str = "wide") -> DataFrame:
    """Reads Example records: ``schema`` orders, widens and checks, ``fields`` picks in file order, neither takes all.

    Every file's footer is checked; files may differ where the schema allows."""
    if schema is not None and fields is not None:
        raise ValueError("Only one of [schema, fields] can be set")
    if form not in ("wide", "map"):
        raise ValueError(f"form is wide or map, not {form}")
    paths = [path] if isinstance(path, str) else list(path)
    files = _files(spark, paths)
    held = _footers(spark, files)
    requested = schema if schema is not None else held[0] if fields is None else held[0].select(fields)
    layouts: dict[tuple, list[str]] = defaultdict(list)
    of_schema: dict[ExampleSchema, tuple] = {}
    for f, h in zip(files, held, strict=True):
        if h not in of_schema:
            _check(requested, h)
            had = {x.name: x.repetition for x in h.fields}
            of_schema[h] = tuple(had.get(x.name, x.repetition) is Repetition.REPEATED for x in requested.fields)
        layouts[of_schema[h]].append(f)
    if len(layouts) == 1:  # the folders as they were given, not a list of all their files
        layouts = {next(iter(layouts)): paths}
    parts = []
    for lists, own in layouts.items():
        physical = T.StructType([T.StructField(f.name, T.ArrayType(f.type.spark) if as_list else f.type.spark) for f, as_list in zip(requested.fields, lists, strict=True)])
        df = spark.read.schema(physical).option("recursiveFileLookup", "true").parquet(*own)
        parts.append(df.select(*[_adapted(df, f, as_list, requested.name).alias(f.name, metadata={"repetition": f.repetition.value}) for f, as_list in zip(requested.fields, lists, strict=True)]))
    wide = reduce(DataFrame.unionByName, parts)
    return wide if form == "wide" else wide_to_features(wide, requested)


def _adapted(df: DataFrame, field: Field, as_list: bool, name: str) -> Column:
    col = df[f"`{field.name}`"]
    if field.repetition is Repetition.OPTIONAL:
        return col
    if field.repetition is Repetition.REPEATED:
        return F.when(F.size(col) > 0, col) if as_list else F.when(col.isNotNull(), F.array(col))
    return checked(F.when(col.isNotNull(), F.array(col)), field, f"Failed to decode {name}#{field.name}: ")


def write_examples(df: DataFrame, path: str, schema: ExampleSchema | None = None, mode: str = "errorifexists", **options: str) -> ExampleSchema:
    """Writes records of either form; without a schema that of the wide columns, or for the map form an inferred one.

    Features outside the schema are dropped, as are values of another kind than the schema's; a required field without
    exactly one value fails the write. Repeated fields get Parquet's list layout."""
    if schema is None:
        schema = infer_schema(df, "example") if is_map_form(df) else ExampleSchema.from_struct(df.schema)
    if not schema.fields:
        raise ValueError("A schema without fields can't be written")
    features_to_wide(df, schema).write.mode(mode).options(**options).parquet(path)
    return schema
