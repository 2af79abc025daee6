"""The two forms of Example records: wide (a column per feature) and map (a ``features`` column), and the checks between.

A feature without values is the same as an absent one, and is null in the wide form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.operators.paths import quoted
from quillet.plans.schema import ExampleSchema, FeatureType, Field, Repetition

FEATURE = T.StructType([T.StructField(k.list_member, T.ArrayType(k.spark)) for k in FeatureType])
FEATURES = T.MapType(T.StringType(), FEATURE)


def is_map_form(df: DataFrame) -> bool:
    return "features" in df.columns and isinstance(df.schema["features"].dataType, T.MapType)


def _null(kind: FeatureType) -> Column:
    return F.lit(None).cast(T.ArrayType(kind.spark))


def feature_list(df: DataFrame, field: Field) -> Column:
    """The feature's values of the schema's kind as an array; values of another kind don't count."""
    if is_map_form(df):
        return F.element_at(F.col("features"), F.lit(field.name)).getField(field.type.list_member)
    if field.name not in df.columns:
        return _null(field.type)
    col, dtype = quoted(field.name), df.schema[field.name].dataType
    if isinstance(dtype, T.ArrayType):
        return col if dtype.elementType == field.type.spark else _null(field.type)
    return F.when(col.isNotNull(), F.array(col)) if dtype == field.type.spark else _null(field.type)


def checked(values: Column, field: Field, context: str = "") -> Column:
    """A list of values as the field's column, with its cardinality enforced when the row is read."""
    n = F.coalesce(F.size(values), F.lit(0))
    n = F.when(values.isNull(), F.lit(0)).otherwise(n)
    if field.repetition is Repetition.REPEATED:
        holed = F.exists(values, lambda x: x.isNull())
        bad = F.raise_error(F.lit(f"{context}Null value in field {field.name}")).cast(T.ArrayType(field.type.spark))
        return F.when(n == 0, _null(field.type)).when(holed, bad).otherwise(values)
    if field.repetition is Repetition.OPTIONAL:
        bad = F.raise_error(F.concat(F.lit(f"{context}Required field size > 1: "), n.cast("string"))).cast(field.type.spark)
        return F.when(n > 1, bad).otherwise(F.get(values, F.lit(0)))
    bad = F.raise_error(F.concat(F.lit(f"{context}Required field size != 1: "), n.cast("string"))).cast(field.type.spark)
    first = F.get(values, F.lit(0))
    spare = F.lit(b"" if field.type is FeatureType.BYTES else 0).cast(field.type.spark)  # never reached: it makes the column non-null
    return F.coalesce(F.when((n != 1) | first.isNull(), bad), first, spare)


def features_to_wide(df: DataFrame, schema: ExampleSchema, context: str = "") -> DataFrame:
    """Records of either form as columns in the schema's order; features outside the schema are dropped."""
    return df.select(*[checked(feature_list(df, f), f, context).alias(f.name, metadata={"repetition": f.repetition.value}) for f in schema.fields])


def wide_to_features(df: DataFrame, schema: ExampleSchema | None = None) -> DataFrame:
    """Wide records in map form, without absent features."""
    schema = schema or ExampleSchema.from_struct(df.schema)
    entries = []
    for f in schema.fields:
        values = feature_list(df, f)
        held = F.struct(*[(values if k is f.type else _null(k)).alias(k.list_member) for k in FeatureType])
        entries.append(F.struct(F.lit(f.name).alias("key"), F.when(F.coalesce(F.size(values), F.lit(0)) > 0, held).alias("value")))
    if not entries:
        return df.select(F.create_map().cast(FEATURES).alias("features"))
    return df.select(F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())).alias("features"))
