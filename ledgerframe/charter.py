"""Charters: one declaration gives a family its schema, keys, indexes, checks and views."""

from __future__ import annotations

import enum
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions.canonical import canonical_json_sha256
from .operators.references import ForeignKey, validate_registry

_SCALARS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def spark_type(annotation) -> tuple[T.DataType, bool, dict]:
    """(type, nullable, metadata) of a Python annotation; what has no column type is refused."""
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            kind, _, meta = spark_type(rest[0])
            return kind, len(rest) < len(args), meta
        return T.VariantType(), len(rest) < len(args), {"union": sorted(getattr(a, "__name__", str(a)) for a in rest)}
    if origin is typing.Literal:
        return spark_type(type(args[0]))[0], False, {"values": list(args)}
    if origin in (list, tuple, frozenset, set):
        return T.ArrayType(spark_type(args[0])[0]), False, {"unique": True} if origin in (set, frozenset) else {}
    if origin in (dict, Mapping) or origin is not None and origin.__name__ == "Mapping":
        return T.MapType(spark_type(args[0])[0], spark_type(args[1])[0]), False, {}
    if isinstance(annotation, typing.NewType):
        kind, nullable, meta = spark_type(annotation.__supertype__)
        return kind, nullable, meta | {"newtype": annotation.__name__}
    if isinstance(annotation, type) and issubclass(annotation, enum.Enum):
        return T.StringType(), False, {"values": [m.value for m in annotation]}
    if annotation in _SCALARS:
        return _SCALARS[annotation], False, {}
    if isinstance(annotation, type) and typing.get_type_hints(annotation):
        return T.StructType([T.StructField(n, *spark_type(a)) for n, a in typing.get_type_hints(annotation).items()]), False, {}
    raise TypeError(f"no column type for {annotation!r}")


@dataclass(frozen=True)
class Column:
    """A declared field.  ``states``: only in these lifecycle states; ``document``/``storage``: where it exists."""

    name: str
    annotation: object
    document_name: str | None = None
    document: bool = True
    storage: bool = True
    versioned: bool = True
    alias_key: bool = False
    unique: bool = False
    search: bool = False
    foreign_key: str | None = None
    states: tuple[str, ...] = ()

    def struct_field(self) -> T.StructField:
        kind, nullable, meta = spark_type(self.annotation)
        marks = {k: v for k, v in (("alias_key", self.alias_key), ("unique", self.unique), ("search", self.search), ("foreign_key", self.foreign_key)) if v}
        return T.StructField(self.name, kind, nullable, meta | marks)


@dataclass(frozen=True)
class Charter:
    family: str
    identity: str
    version: str
    columns: tuple[Column, ...]
    metadata: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"{self.family}: declared twice: {', '.join(twice)}")
        if self.identity not in names:
            raise ValueError(f"{self.family}: no column {self.identity}")

    @classmethod
    def of(cls, declared: type, identity: str, version: str, **options: dict) -> Charter:
        """From a class's annotations; ``options`` adds settings by field name."""
        hints = typing.get_type_hints(declared)
        return cls(declared.__name__.lower(), identity, version, tuple(Column(n, a, **options.get(n, {})) for n, a in hints.items()))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.struct_field() for c in self.columns if c.storage])

    def document(self, rows: DataFrame, state: str | None = None) -> DataFrame:
        """Storage rows as documents: renamed, without storage-only fields and those of other states."""
        kept = [c for c in self.columns if c.document and (not c.states or state is None or state in c.states)]
        return rows.select(*[F.col(f"`{c.name}`").alias(c.document_name or c.name) for c in kept])

    def versioned(self) -> list[str]:
        return [c.name for c in self.columns if c.versioned and c.storage]

    def payload(self) -> dict:
        fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "metadata": f.metadata} for f in self.schema.fields]
        return {"family": self.family, "identity": self.identity, "version": self.version, "fields": sorted(fields, key=lambda f: f["name"]), "metadata": dict(self.metadata)}

    def check(self, rows: DataFrame) -> DataFrame:
        """(id, column, reason) of rows that break the declaration: null, not among the values, or not unique."""
        out = None
        for f in self.schema.fields:
            tests = []
            if not f.nullable:
                tests.append((F.col(f.name).isNull(), "null"))
            if "values" in f.metadata:
                tests.append((~F.col(f.name).isin(f.metadata["values"]), "value"))
            for bad, reason in tests:
                found = rows.where(bad).select(F.col(self.identity).cast("string").alias("id"), F.lit(f.name).alias("column"), F.lit(reason).alias("reason"))
                out = found if out is None else out.unionByName(found)
            if f.metadata.get("unique") is True or f.name == self.identity:
                twice = rows.where(F.col(f.name).isNotNull()).groupBy(f.name).count().where("count > 1").select(F.col(f.name).cast("string").alias("id"), F.lit(f.name).alias("column"), F.lit("unique").alias("reason"))
                out = twice if out is None else out.unionByName(twice)
        return out


class Registry:
    """A closed set of families; reads each with its declared schema and shows it as a view."""

    def __init__(self, *charters: Charter) -> None:
        names = [c.family for c in charters]
        if len(set(names)) != len(names):
            raise ValueError("a family is given twice")
        self.charters = {c.family: c for c in charters}
        self.keys = [ForeignKey(c.family, f.name, f.foreign_key, required="None" not in str(f.annotation), many=typing.get_origin(f.annotation) in (list, tuple)) for c in charters for f in c.columns if f.foreign_key]
        if unknown := sorted({k.target for k in self.keys} - set(names)):
            raise ValueError(f"keys to unknown families: {', '.join(unknown)}")

    def select(self, **metadata: str) -> list[Charter]:
        return [c for _, c in sorted(self.charters.items()) if all(c.metadata.get(k) == v for k, v in metadata.items())]

    @property
    def catalog_hash(self) -> str:
        return canonical_json_sha256([c.payload() for _, c in sorted(self.charters.items())])

    def read(self, spark: SparkSession, directory: str, family: str) -> DataFrame:
        """Columns by declaration, never inferred."""
        declared = self.charters[family].schema
        return spark.read.parquet(f"{directory}/{family}.parquet").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields])

    def register_views(self, spark: SparkSession, directory: str) -> None:
        """One view per family: plain SQL is the whole query surface."""
        for family in self.charters:
            self.read(spark, directory, family).createOrReplaceTempView(family)

    def validate(self, tables: Mapping[str, DataFrame], touched: set[str] | None = None) -> DataFrame | None:
        """Foreign-key violations over the families that a change touches (all, if None)."""
        aliases = {c.family: [f.name for f in c.columns if f.alias_key] for c in self.charters.values()}
        return validate_registry({n: (t, self.charters[n].identity) for n, t in tables.items()}, self.keys, aliases, touched)
