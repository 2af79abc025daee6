"""Schema inference over records: one pass of associative partial aggregates, for either form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.features import FEATURE, is_map_form
from quillet.plans.schema import ExampleSchema, FeatureType, Field, Repetition


def infer_schema(df: DataFrame, name: str) -> ExampleSchema:
    """(1,1) values are required, (0,1) optional, more repeated; a feature without any value is left out.

    Fields of the map form are in name order, those of the wide form in column order."""
    return _in_map_form(df, name) if is_map_form(df) else _in_wide_form(df, name)


def _repetition(present: int, total: int, most: int) -> Repetition | None:
    if most == 0:
        return None
    if most > 1:
        return Repetition.REPEATED
    return Repetition.REQUIRED if present == total else Repetition.OPTIONAL


def _in_map_form(df: DataFrame, name: str) -> ExampleSchema:
    lists = {k: F.col("value").getField(k.list_member) for k in FeatureType}
    kinds = F.filter(F.array(*[F.when(c.isNotNull(), F.lit(k.name)) for k, c in lists.items()]), lambda x: x.isNotNull())
    size: Column = F.greatest(*[F.when(c.isNotNull(), F.size(c)).otherwise(0) for c in lists.values()])
    # each row has one entry more, without a name, so that the same pass counts the rows
    nameless = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast(FEATURE).alias("value")))
    entries = F.when(F.col("features").isNull(), nameless).otherwise(F.concat(F.map_entries("features"), nameless))
    found = (
        df.select(F.inline(entries))
        .select("key", kinds.alias("kinds"), size.alias("size"))
        .groupBy("key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.count_if(F.col("size") > 0).alias("present"), F.max("size").alias("most"), F.count(F.lit(1)).alias("rows"))
        .orderBy("key")
        .collect()  # a row per feature name, as wide as the schema it becomes
    )
    total = sum(r.rows for r in found if r.key is None)
    fields = []
    for r in found:
        if r.key is None:
            continue
        if len(r.kinds) > 1:
            raise ValueError(f"Incompatible types for field {r.key}: {r.kinds[0]} != {r.kinds[1]}")
        if not r.kinds:
            raise ValueError(f"Field type for {r.key}")
        if repetition := _repetition(r.present, total, r.most):
            fields.append(Field(r.key, FeatureType[r.kinds[0]], repetition))
    return ExampleSchema(name, tuple(fields))


def _in_wide_form(df: DataFrame, name: str) -> ExampleSchema:
    columns = []
    for f in df.schema.fields:
        array = isinstance(f.dataType, T.ArrayType)
        columns.append((f.name, FeatureType.of_spark(f.dataType.elementType if array else f.dataType), array))
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (column, _, array) in enumerate(columns):
        col = F.col("`" + column.replace("`", "``") + "`")
        size = F.when(col.isNull(), 0).otherwise(F.size(col) if array else F.lit(1))
        aggs += [F.count_if(size > 0).alias(f"present{i}"), F.max(size).alias(f"most{i}")]
    row = df.agg(*aggs).first()
    fields = []
    for i, (column, kind, _) in enumerate(columns):
        if repetition := _repetition(row[f"present{i}"], row["total"], row[f"most{i}"] or 0):
            fields.append(Field(column, kind, repetition))
    return ExampleSchema(name, tuple(fields))
