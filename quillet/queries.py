"""The typed-projection, predicate and Example-record queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.features import features_to_wide, wide_to_features
from quillet.operators.predicate import Predicate, any_element
from quillet.operators.projection import Projection, project
from quillet.plans.scanner import infer_schema
from quillet.plans.schema import ExampleSchema, FeatureType, Repetition
from quillet.session import scratch
from quillet.sources.avsc import parse_avsc
from quillet.sources.examples import file_schema, read_examples, write_examples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


# predicates

_LINES = "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where "


def _lines(name: str, condition: Callable, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "lineitem")
        return df.filter(Predicate(df.schema, condition)).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")

    _query(name, _LINES + where)(run)


_lines("q_filter_cmp_gt", lambda r: r.l_quantity > 45, "l_quantity > 45")
_lines("q_filter_cmp_lt", lambda r: r.l_quantity < 5, "l_quantity < 5")
_lines("q_filter_cmp_ge", lambda r: r.l_quantity >= 48, "l_quantity >= 48")
_lines("q_filter_cmp_le", lambda r: r.l_quantity <= 3, "l_quantity <= 3")
_lines("q_filter_cmp_eq", lambda r: r.l_quantity == 7, "l_quantity is not distinct from 7")
_lines("q_filter_cmp_ne", lambda r: r.l_returnflag != "N", "l_returnflag is distinct from 'N'")
_lines("q_filter_flipped", lambda r: 45 < r.l_quantity, "45 < l_quantity")
_lines("q_filter_literal_expression", lambda r: r.l_quantity > 40 + 2 * 3, "l_quantity > 46")
_lines("q_filter_and", lambda r: (r.l_quantity > 45) & (r.l_returnflag != "N"), "l_quantity > 45 and l_returnflag is distinct from 'N'")
_lines("q_filter_or", lambda r: (r.l_quantity > 49) | (r.l_linenumber == 7), "l_quantity > 49 or l_linenumber is not distinct from 7")
_lines("q_filter_not", lambda r: ~(r.l_quantity > 2), "not (l_quantity > 2)")
_lines(
    "q_filter_and_or_not",
    lambda r: ~((r.l_quantity > 5) & (r.l_returnflag == "N")) & ((r.l_linenumber < 3) | ~(r.l_linestatus == "O")),
    "not (l_quantity > 5 and l_returnflag is not distinct from 'N') and (l_linenumber < 3 or not (l_linestatus is not distinct from 'O'))",
)
_lines("q_filter_string_order", lambda r: r.l_returnflag >= "N", "l_returnflag >= 'N'")
_lines("q_filter_coerce", lambda r: (r.l_linenumber > 2.5) & (r.l_orderkey <= 100.0), "l_linenumber > 2.5 and l_orderkey <= 100")


def _holed(name: str, condition: Callable, where: str) -> None:
    """Orders with nulls made where the tables have none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("status"), F.expr("case when o_orderstatus = 'F' then null else o_orderstatus = 'O' end").alias("open"))
        return df.filter(Predicate(df.schema, condition))

    _query(name, f"select * from (select o_orderkey, nullif(o_orderstatus, 'F') as status, case when o_orderstatus = 'F' then null else o_orderstatus = 'O' end as open from orders) where {where}")(run)


_holed("q_filter_null_literal", lambda r: r.status == None, "status is null")  # noqa: E711
_holed("q_filter_not_null_literal", lambda r: r.status != None, "status is not null")  # noqa: E711
_holed("q_filter_ne_keeps_null", lambda r: r.status != "O", "status is distinct from 'O'")
_holed("q_filter_not_eq_keeps_null", lambda r: ~(r.status == "O"), "status is distinct from 'O'")
_holed("q_filter_bool", lambda r: r.open, "open is not distinct from true")
_holed("q_filter_not_bool_null", lambda r: ~r.open, "open is distinct from true")


@_query("q_filter_native", "select p_partkey, p_size from part where p_size > 40 or p_brand is distinct from 'Brand#11' and p_size <= 3")
def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row function alone judges every record."""
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    native = Predicate.build(df.schema, lambda r: (r.p_size > 40) | ((r.p_brand != "Brand#11") & (r.p_size <= 3))).native

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([native(r) for r in b.to_pylist()], pa.bool_()))

    return df.mapInArrow(judged, df.schema).select("p_partkey", "p_size")


# projections


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", "c_name", F.struct("n_name", "n_regionkey", F.col("c_mktsegment").alias("segment")).alias("place")
    )  # nation is one of the 25 fixed rows


@_query("q_project_top", "select c_custkey, c_mktsegment from customer")
def _project_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    struct = _table(spark, sf_dir, "customer").schema
    return Projection(struct, lambda r: r.c_mktsegment, lambda r: r.c_custkey).read(spark, f"{sf_dir}/customer.parquet")


@_query("q_project_nested", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def _project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    return Projection(df.schema, lambda r: r.c_custkey, lambda r: r.place.n_name).apply(df).select("c_custkey", "place.*")


@_query("q_filter_nested", "select c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey > 1 and not (c_mktsegment is not distinct from 'BUILDING')")
def _filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    return df.filter(Predicate(df.schema, lambda r: (r.place.n_regionkey > 1) & ~(r.place.segment == "BUILDING"))).select("c_custkey")


@_query("q_project_string", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def _project_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted paths; names that aren't there are passed over."""
    df = _nested(spark, sf_dir)
    return Projection.of_paths(df.schema, "place.n_name", "ghost", "place.ghost", "c_custkey").apply(df).select("c_custkey", "place.*")


@_query("q_project_parent_child", "select c_mktsegment as segment from customer join nation on c_nationkey = n_nationkey")
def _project_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    return Projection(df.schema, lambda r: r.place, lambda r: r.place.segment).apply(df).select("place.*")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus"))).alias("accounts"))


@_query("q_project_array_elem", "select o_custkey, o_orderkey, o_totalprice from orders")
def _project_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _accounts(spark, sf_dir)
    kept = Projection(df.schema, lambda r: r.o_custkey, lambda r: r.accounts[0].o_orderkey, lambda r: r.accounts[0].o_totalprice).apply(df)
    return kept.select("o_custkey", F.inline("accounts"))


@_query("q_project_array_file", "select o_custkey, count(*) as n, max(o_orderkey) as last_order from orders group by o_custkey")
def _project_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = _accounts(spark, sf_dir), scratch(spark, "accounts")
    df.write.parquet(path)
    kept = Projection(df.schema, lambda r: r.accounts[0].o_orderkey, lambda r: r.o_custkey).read(spark, path)
    return kept.select("o_custkey", F.size("accounts").cast("bigint").alias("n"), F.array_max("accounts.o_orderkey").alias("last_order"))


@_query("q_filter_array_first", "select o_custkey, o_orderkey as first_order from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1 and o_totalprice > 100000")
def _filter_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _accounts(spark, sf_dir)
    return df.filter(Predicate(df.schema, lambda r: r.accounts[0].o_totalprice > 100000)).select("o_custkey", F.get("accounts", F.lit(0))["o_orderkey"].alias("first_order"))


@_query("q_filter_array_any", "select distinct o_custkey from orders where o_totalprice > 400000")
def _filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _accounts(spark, sf_dir)
    return df.filter(Predicate(df.schema, lambda r: any_element(r.accounts, "o_totalprice", "gt", 400000))).select("o_custkey")


# Example records

PACKED = (
    ExampleSchema.builder().required("key", FeatureType.INT64).optional("big", FeatureType.FLOAT).required("status", FeatureType.BYTES).repeated("parts", FeatureType.INT64).named("packed_order")
)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the parts of their lines: a required, an optional and a repeated feature."""
    orders = _table(spark, sf_dir, "orders")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("key"), F.expr("case when o_totalprice > 150000 then cast(o_totalprice as float) end").alias("big"), F.col("o_orderstatus").cast("binary").alias("status"), "parts"
    )


_PACKED_SQL = "(select o_orderkey as key, case when o_totalprice > 150000 then cast(o_totalprice as float) end as big, o_orderstatus as status, parts from orders left join (select l_orderkey, list(l_partkey) as parts from lineitem group by 1) on o_orderkey = l_orderkey)"


def _stored(spark: SparkSession, sf_dir: str, map_form: bool = False) -> str:
    path, df = scratch(spark, "examples"), _packed(spark, sf_dir)
    write_examples(wide_to_features(df, PACKED) if map_form else df, path, PACKED, compression="gzip")
    return path


@_query("q_example_roundtrip", f"select key, cast(big as double) as big, status, cast(len(parts) as bigint) as n, cast(list_sum(parts) as bigint) as total from {_PACKED_SQL}")
def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_examples(spark, _stored(spark, sf_dir, map_form=True), schema=PACKED)
    return df.select("key", F.col("big").cast("double").alias("big"), F.col("status").cast("string").alias("status"), F.expr("case when parts is not null then cast(size(parts) as bigint) end").alias("n"), F.expr("aggregate(parts, 0L, (a, x) -> a + x)").alias("total"))


@_query("q_example_map_form", "select feature, count(*) as n from (select 'key' as feature from orders union all select 'status' from orders union all select 'big' from orders where o_totalprice > 150000 union all select 'parts' from orders where o_orderkey in (select l_orderkey from lineitem)) group by feature")
def _map_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_examples(spark, _stored(spark, sf_dir), form="map")
    return df.select(F.explode(F.map_keys("features")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@_query("q_example_with_fields", "select item_id, text from benchmark")
def _with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_examples(spark, f"{sf_dir}/benchmark.parquet", fields=["text", "item_id", "text"])
    return df.select("item_id", F.col("text").cast("string").alias("text"))


@_query("q_example_widen", f"select key, case when status is null then 0 else 1 end as statuses, cast(len(parts) as bigint) as n, cast(case when big is null then 0 else 1 end as bigint) as bigs from {_PACKED_SQL}")
def _widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    wider = ExampleSchema.builder().optional("key", FeatureType.INT64).repeated("big", FeatureType.FLOAT).repeated("status", FeatureType.BYTES).repeated("parts", FeatureType.INT64).named("wider")
    df = read_examples(spark, _stored(spark, sf_dir), schema=wider)
    n = "case when {0} is not null then cast(size({0}) as bigint) end"
    return df.select("key", F.expr("size(status)").alias("statuses"), F.expr(n.format("parts")).alias("n"), F.expr("coalesce(" + n.format("big") + ", 0L)").alias("bigs"))


@_query("q_example_new_optional", f"select key, cast(null as bigint) as fresh, cast(null as bigint) as fresh_list from {_PACKED_SQL}")
def _new_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = ExampleSchema.builder().repeated("fresh_list", FeatureType.INT64).required("key", FeatureType.INT64).optional("fresh", FeatureType.INT64).named("later")
    df = read_examples(spark, _stored(spark, sf_dir), schema=later)
    return df.select("key", "fresh", F.expr("case when fresh_list is not null then cast(size(fresh_list) as bigint) end").alias("fresh_list"))


@_query("q_example_text_bytes", "select conv_id, turn, cast(strlen(text) as bigint) as n_bytes from conversations")
def _text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_examples(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("n_bytes"))


@_query("q_example_write_drops", "select o_orderkey as key, cast(null as bigint) as big from orders")
def _write_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind other than the schema's and features outside the schema leave no value in the file."""
    schema, path = ExampleSchema.builder().required("key", FeatureType.INT64).optional("big", FeatureType.INT64).named("narrow"), scratch(spark, "narrow")
    write_examples(wide_to_features(_packed(spark, sf_dir), PACKED), path, schema)
    return read_examples(spark, path)


def _as_rows(spark: SparkSession, schema: ExampleSchema) -> DataFrame:
    return spark.createDataFrame([(f.name, f.type.name, f.repetition.name) for f in schema.fields], T.StructType([T.StructField(c, T.StringType()) for c in ("field", "type", "repetition")]))


def _scan_sql() -> str:
    parts = []
    for f in PACKED.fields:
        size = f"coalesce(len({f.name}), 0)" if f.repetition is Repetition.REPEATED else f"case when {f.name} is null then 0 else 1 end"
        parts.append(f"select '{f.name}' as field, '{f.type.name}' as type, case when max({size}) > 1 then 'REPEATED' when min({size}) = 1 then 'REQUIRED' else 'OPTIONAL' end as repetition from {_PACKED_SQL}")
    return " union all ".join(parts)


@_query("q_scan_schema", _scan_sql())
def _scan_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_rows(spark, infer_schema(_packed(spark, sf_dir), "packed_order"))


@_query("q_scan_schema_map", _scan_sql())
def _scan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_rows(spark, infer_schema(wide_to_features(_packed(spark, sf_dir), PACKED), "packed_order"))


# messages and text forms


def _outcome(run: Callable[[], object]) -> str:
    """What a case returns, or the message it fails with."""
    try:
        return str(run())
    except Exception as e:  # noqa: BLE001 - the message is the result
        raised = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?) SQLSTATE", str(e), re.S)
        return raised[1] if raised else str(e)


def _cases(name: str, expected: dict[str, str]) -> Callable:
    """A query of (test, outcome) rows, against literal rows."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in expected.items())

    def keep(f: Callable[[SparkSession, str], dict[str, Callable[[], object]]]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame([(k, _outcome(v)) for k, v in f(spark, sf_dir).items()], "test string, outcome string")

        return _query(name, f"select * from (values {rows}) as t(test, outcome)")(run)

    return keep


_CLASH = "The requested schema is not compatible with the file schema. incompatible types: "


@_cases(
    "q_example_evolution_errors",
    {
        "V1 optional to required": _CLASH + "required float big != optional float big",
        "V2 repeated to optional": _CLASH + "optional int64 parts (INTEGER(64,true)) != repeated int64 parts (INTEGER(64,true))",
        "V5 new required": "Failed to decode R5#x: Required field size != 1: 0",
        "V8 another type": _CLASH + "required float key != required int64 key (INTEGER(64,true))",
        "S5 schema and fields": "Only one of [schema, fields] can be set",
        "S6 unknown fields": "Invalid fields: [x, y, z]",
        "S10 schema first": "status, key",
        "S12 footer": "key required, big optional, status required, parts repeated",
    },
)
def _evolution_errors(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    path, new = _stored(spark, sf_dir), ExampleSchema.builder
    asked = {
        "V1 optional to required": new().required("big", FeatureType.FLOAT),
        "V2 repeated to optional": new().optional("parts", FeatureType.INT64),
        "V5 new required": new().required("x", FeatureType.INT64),
        "V8 another type": new().required("key", FeatureType.FLOAT),
    }
    cases: dict[str, Callable[[], object]] = {k: lambda b=b: read_examples(spark, path, schema=b.named("R5")).agg(*[F.max(f) for f in b.named("R5").names]).collect() for k, b in asked.items()}
    cases["S5 schema and fields"] = lambda: read_examples(spark, path, schema=PACKED, fields=["key"])
    cases["S6 unknown fields"] = lambda: read_examples(spark, path, fields=["z", "key", "y", "x"])
    cases["S10 schema first"] = lambda: ", ".join(read_examples(spark, path, schema=new().optional("status", FeatureType.BYTES).optional("key", FeatureType.INT64).named("own")).columns)
    cases["S12 footer"] = lambda: ", ".join(f"{f.name} {f.repetition.value}" for f in file_schema(spark, path).fields)
    return cases


@_cases(
    "q_example_write_errors",
    {
        "W5 required, none": "Required field size != 1: 0",
        "W5 required, two": "Required field size != 1: 2",
        "W5 optional, two": "Required field size > 1: 2",
        "W6 required of another kind": "Required field size != 1: 0",
    },
)
def _write_errors(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    orders, pair = _table(spark, sf_dir, "orders"), "array(o_orderkey, o_custkey)"
    asked = {
        "W5 required, none": (ExampleSchema.builder().required("a", FeatureType.INT64), "cast(null as array<bigint>)"),
        "W5 required, two": (ExampleSchema.builder().required("a", FeatureType.INT64), pair),
        "W5 optional, two": (ExampleSchema.builder().optional("a", FeatureType.INT64), pair),
        "W6 required of another kind": (ExampleSchema.builder().required("a", FeatureType.FLOAT), pair),
    }
    return {k: lambda b=b, values=values: write_examples(orders.select(F.expr(values).cast("array<bigint>").alias("a")), scratch(spark, "refused"), b.named("one")) for k, (b, values) in asked.items()}


@_cases(
    "q_scan_schema_errors",
    {
        "A5 two kinds": "Incompatible types for field a: BYTES != INT64",
        "A7 only empty lists": "b",
        "A8 no kind": "Field type for a",
    },
)
def _scan_errors(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    def scan(ints: str, texts: str) -> ExampleSchema:
        held = f"named_struct('int64_list', {ints}, 'float_list', cast(null as array<float>), 'bytes_list', {texts})"
        one = "named_struct('int64_list', array(cast(o_orderkey as bigint)), 'float_list', cast(null as array<float>), 'bytes_list', cast(null as array<binary>))"
        return infer_schema(_table(spark, sf_dir, "orders").select(F.expr(f"map('a', {held}, 'b', {one})").alias("features")), "s")

    none, no_texts = "cast(null as array<bigint>)", "cast(null as array<binary>)"
    return {
        "A5 two kinds": lambda: scan("if(o_orderkey % 2 = 0, array(cast(o_orderkey as bigint)), null)", "if(o_orderkey % 2 = 0, null, array(cast(o_orderstatus as binary)))"),
        "A7 only empty lists": lambda: ", ".join(scan("cast(array() as array<bigint>)", no_texts).names),
        "A8 no kind": lambda: scan(none, no_texts),
    }


_UNION = """{"type": "record", "name": "Parcel", "fields": [
  {"name": "id", "type": "long"},
  {"name": "to", "type": ["null", {"type": "record", "name": "Home", "fields": [{"name": "town", "type": "string", "doc": "where"}, {"name": "door", "type": "int"}]},
    {"type": "record", "name": "Shop", "fields": [{"name": "town", "type": "string"}, {"name": "till", "type": "int"}]}]},
  {"name": "marks", "type": {"type": "map", "values": "string"}}]}"""


@_cases(
    "q_project_text",
    {
        "P2 text and paths": "struct<id:bigint>",
        "P5 nested miss": "struct<>",
        "P6 union": "struct<to:struct<member0:struct<town:string>,member1:struct<town:string>>> True",
        "P6 one branch misses": "struct<to:struct<member0:struct<>,member1:struct<till:int>>>",
        "P8 a map": "Projection doesn't support schema type marks:MAP with fields: k",
        "P9 notes": "{'doc': 'where'}",
        "P10 unknown in a lambda": "Invalid getter expression: ghost",
        "P12 into a map": "Invalid getter expression: marks.k",
    },
)
def _project_text(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:  # noqa: ARG001
    struct = parse_avsc(_UNION)

    def kind(*paths: str) -> str:
        return project(struct, *paths).simpleString()

    return {
        "P2 text and paths": lambda: kind("id", "ghost"),
        "P5 nested miss": lambda: project(struct, "to.member0.ghost")["to"].dataType["member0"].dataType.simpleString(),
        "P6 union": lambda: f"{kind('to.town')} {project(struct, 'to.town')['to'].nullable}",
        "P6 one branch misses": lambda: kind("to.till"),
        "P8 a map": lambda: kind("marks.k"),
        "P9 notes": lambda: project(struct, "to.town")["to"].dataType["member0"].dataType["town"].metadata,
        "P10 unknown in a lambda": lambda: Projection(struct, lambda r: r.ghost),
        "P12 into a map": lambda: Projection(struct, lambda r: r.marks.k),
    }


@_cases(
    "q_filter_errors",
    {
        "F16 two fields": "Invalid expression: a field compares with a value, not with another field",
        "F16 a constant": "Invalid expression: True",
        **{f"F17 {o}": "Unsupported operator type: only comparisons of a field with a value are" for o in ("+", "//", "**", "<<", "reflected %", "in")},
        "F17 minus": "Unknown unary operator: -",
        "F17 date": "Unsupported value type: date",
    },
)
def _filter_errors(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    struct = _table(spark, sf_dir, "lineitem").withColumn("day", F.lit("1970-01-01").cast("date")).schema
    conditions: dict[str, Callable] = {
        "F16 two fields": lambda r: r.l_quantity > r.l_orderkey,
        "F16 a constant": lambda r: 1 == 1,  # noqa: ARG005, PLR0133
        "F17 +": lambda r: r.l_quantity + 1 > 2,
        "F17 //": lambda r: r.l_quantity // 2 == 1,
        "F17 **": lambda r: r.l_quantity**2 == 4,
        "F17 <<": lambda r: r.l_quantity << 1 == 4,
        "F17 reflected %": lambda r: 7 % r.l_quantity == 1,
        "F17 in": lambda r: 3 in r.l_quantity,
        "F17 minus": lambda r: -r.l_quantity < 0,
        "F17 date": lambda r: r.day > 3,
    }
    return {k: lambda c=c: Predicate.build(struct, c) for k, c in conditions.items()}


@_cases(
    "q_schema_forms",
    {
        "E2 duplicate name": "Duplicate field name a",
        "E4 message": "message packed_order {\n  required int64 key (INTEGER(64,true));\n  optional float big;\n  required binary status;\n  repeated int64 parts (INTEGER(64,true));\n}\n",
        "E6 JSON": '{"name": "packed_order", "fields": [{"name": "key", "type": "INT64", "repetition": "REQUIRED"}, {"name": "big", "type": "FLOAT", "repetition": "OPTIONAL"}, {"name": "status", "type": "BYTES", "repetition": "REQUIRED"}, {"name": "parts", "type": "INT64", "repetition": "REPEATED"}]}',
        "E6 there and back": "True",
        "E7 equal by message": "True True",
        "E7 order counts": "False",
    },
)
def _schema_forms(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:  # noqa: ARG001
    back = ExampleSchema.from_message(PACKED.to_message())
    return {
        "E2 duplicate name": lambda: ExampleSchema.builder().required("a", FeatureType.INT64).optional("a", FeatureType.FLOAT),
        "E4 message": PACKED.to_message,
        "E6 JSON": PACKED.to_json,
        "E6 there and back": lambda: ExampleSchema.from_json(PACKED.to_json()) == PACKED,
        "E7 equal by message": lambda: f"{back == PACKED} {hash(back) == hash(PACKED)}",
        "E7 order counts": lambda: ExampleSchema(PACKED.name, PACKED.fields[::-1]) == PACKED,
    }
