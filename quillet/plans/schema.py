"""Flat, ordered schemas of Example records and their Spark and Parquet forms."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class FeatureType(Enum):
    INT64 = "int64"
    FLOAT = "float"
    BYTES = "binary"

    @property
    def spark(self) -> T.DataType:
        return {"int64": T.LongType(), "float": T.FloatType(), "binary": T.BinaryType()}[self.value]

    @property
    def list_member(self) -> str:
        """Name of this kind's list in the map form of a record."""
        return {"int64": "int64_list", "float": "float_list", "binary": "bytes_list"}[self.value]

    @classmethod
    def of_spark(cls, dtype: T.DataType) -> FeatureType:
        if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
            raise ValueError("Only primitive fields are supported")
        for kind in cls:
            if kind.spark == dtype:
                return kind
        raise ValueError(f"Unsupported primitive type: {dtype.simpleString()}")

    @classmethod
    def of_parquet(cls, physical: str) -> FeatureType:
        """By physical type name alone: logical annotations don't count."""
        try:
            return {"INT64": cls.INT64, "FLOAT": cls.FLOAT, "BINARY": cls.BYTES}[physical.upper()]
        except KeyError:
            raise ValueError(f"Unsupported primitive type: {physical}") from None


class Repetition(Enum):
    REQUIRED = "required"
    OPTIONAL = "optional"
    REPEATED = "repeated"


@dataclass(frozen=True)
class Field:
    name: str
    type: FeatureType
    repetition: Repetition

    def message(self) -> str:
        note = " (INTEGER(64,true))" if self.type is FeatureType.INT64 else ""
        return f"{self.repetition.value} {self.type.value} {self.name}{note}"

    def struct_field(self) -> T.StructField:
        dtype = self.type.spark
        if self.repetition is Repetition.REPEATED:
            dtype = T.ArrayType(dtype, containsNull=False)
        return T.StructField(self.name, dtype, self.repetition is not Repetition.REQUIRED, {"repetition": self.repetition.value})


class SchemaBuilder:
    def __init__(self) -> None:
        self._fields: dict[str, Field] = {}

    def _add(self, name: str, kind: FeatureType, repetition: Repetition) -> SchemaBuilder:
        if name in self._fields:
            raise ValueError(f"Duplicate field name {name}")
        self._fields[name] = Field(name, kind, repetition)
        return self

    def required(self, name: str, kind: FeatureType) -> SchemaBuilder:
        return self._add(name, kind, Repetition.REQUIRED)

    def optional(self, name: str, kind: FeatureType) -> SchemaBuilder:
        return self._add(name, kind, Repetition.OPTIONAL)

    def repeated(self, name: str, kind: FeatureType) -> SchemaBuilder:
        return self._add(name, kind, Repetition.REPEATED)

    def named(self, name: str) -> ExampleSchema:
        return ExampleSchema(name, tuple(self._fields.values()))


@dataclass(frozen=True)
class ExampleSchema:
    """Equality and hash cover the name and the order of the fields."""

    name: str
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for f in self.fields:
            if f.name in seen:
                raise ValueError(f"Duplicate field name {f.name}")
            seen.add(f.name)

    @staticmethod
    def builder() -> SchemaBuilder:
        return SchemaBuilder()

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def select(self, fields: list[str]) -> ExampleSchema:
        """The fields asked for, in this schema's own order; the list counts as a set."""
        wanted = set(fields)
        if unknown := sorted(wanted - set(self.names)):
            raise ValueError(f"Invalid fields: [{', '.join(unknown)}]")
        return ExampleSchema(self.name, tuple(f for f in self.fields if f.name in wanted))

    # Spark form

    def to_struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    @classmethod
    def from_struct(cls, struct: T.StructType, name: str = "example") -> ExampleSchema:
        """A column's repetition is its metadata's, else array, nullable or not."""
        fields = []
        for f in struct.fields:
            array = isinstance(f.dataType, T.ArrayType)
            kind = FeatureType.of_spark(f.dataType.elementType if array else f.dataType)
            if array:
                repetition = Repetition.REPEATED
            elif "repetition" in (f.metadata or {}):
                repetition = Repetition(f.metadata["repetition"])
            else:
                repetition = Repetition.OPTIONAL if f.nullable else Repetition.REQUIRED
            fields.append(Field(f.name, kind, repetition))
        return cls(name, tuple(fields))

    # text forms

    def to_message(self) -> str:
        return "message {} {{\n{}}}\n".format(self.name, "".join(f"  {f.message()};\n" for f in self.fields))

    @classmethod
    def from_message(cls, text: str) -> ExampleSchema:
        head = re.match(r"\s*message\s+(\S+)\s*\{(.*)\}\s*$", text, re.S)
        if not head:
            raise ValueError(f"Not a message: {text}")
        fields = []
        for part in filter(str.strip, head[2].split(";")):
            if "{" in part or re.match(r"\s*(required|optional|repeated)\s+group\b", part):
                raise ValueError("Only primitive fields are supported")
            m = re.match(r"\s*(required|optional|repeated)\s+(\w+)\s+(\S+)\s*(\(.*\))?\s*$", part, re.S)
            if not m:
                raise ValueError(f"Not a field: {part.strip()}")
            fields.append(Field(m[3], FeatureType.of_parquet(m[2]), Repetition(m[1])))
        return cls(head[1], tuple(fields))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": [{"name": f.name, "type": f.type.name, "repetition": f.repetition.name} for f in self.fields]})

    @classmethod
    def from_json(cls, text: str) -> ExampleSchema:
        data = json.loads(text)
        return cls(data["name"], tuple(Field(f["name"], FeatureType[f["type"]], Repetition[f["repetition"]]) for f in data["fields"]))

    def __str__(self) -> str:
        return self.to_message()
