"""quillet: typed Parquet projection, null-exact predicates and Example records on PySpark."""

from quillet.functions.features import features_to_wide, wide_to_features
from quillet.operators.predicate import Predicate, Predicates, any_element
from quillet.operators.projection import Projection, project
from quillet.plans.scanner import infer_schema
from quillet.plans.schema import ExampleSchema, FeatureType, Field, Repetition
from quillet.sources.avsc import parse_avsc
from quillet.sources.examples import file_schema, read_examples, write_examples

__all__ = [
    "ExampleSchema",
    "FeatureType",
    "Field",
    "Predicate",
    "Predicates",
    "Projection",
    "Repetition",
    "any_element",
    "features_to_wide",
    "file_schema",
    "infer_schema",
    "parse_avsc",
    "project",
    "read_examples",
    "wide_to_features",
    "write_examples",
]
