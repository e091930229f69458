"""Graph projections: nodes, edges, dependencies and hyperedges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .references import field_values


def _named(column: str, what: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(text.isNotNull() & (text != ""), text).otherwise(F.raise_error(F.lit(f"{what} needs an identity")))


def nodes(records: DataFrame, family: str, id_column: str, label: str | None = None, metadata: list[str] | None = None) -> DataFrame:
    """(family, id, label, metadata): the label falls back to the id, null metadata are left out."""
    pairs = [x for m in sorted(metadata or []) for x in (F.lit(m), F.col(m).cast("string"))]
    data = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return records.select(F.lit(family).alias("family"), _named(id_column, family).alias("id"), F.coalesce(F.col(label).cast("string") if label else F.lit(None), F.col(id_column).cast("string")).alias("label"), data.alias("metadata"))


@dataclass(frozen=True)
class Edge:
    """``field`` of a record names targets; ``source`` overrides where the edge starts."""

    kind: str
    field: str
    target: str
    source: str | None = None


def edges(records: DataFrame, family: str, id_column: str, specs: list[Edge]) -> DataFrame:
    """(source_family, source, kind, target_family, target, position): one per value, lists fanned out from 0."""
    out = None
    for spec in specs:
        many = isinstance(records.schema[spec.field].dataType, T.ArrayType)
        start = _named(spec.source or id_column, family).alias("source")
        if many:
            rows = records.select(start, F.posexplode(spec.field).alias("position", "target"))
        else:
            rows = records.select(start, F.lit(0).alias("position"), F.col(spec.field).alias("target"))
        rows = rows.where(F.col("target").isNotNull() & (F.col("target").cast("string") != ""))
        rows = rows.select(F.lit(family).alias("source_family"), "source", F.lit(spec.kind).alias("kind"), F.lit(spec.target).alias("target_family"), F.col("target").cast("string").alias("target"), "position")
        out = rows if out is None else out.unionByName(rows)
    return out


def hyperedges(records: DataFrame, kind: str, id_column: str, sources: str, target: str) -> DataFrame:
    """(kind, id, sources, target): all sources in one row; none without a target or a source."""
    kept = F.filter(sources, lambda x: x.isNotNull() & (x.cast("string") != ""))
    rows = records.select(F.lit(kind).alias("kind"), F.col(id_column).cast("string").alias("id"), kept.alias("sources"), F.col(target).cast("string").alias("target"))
    return rows.where((F.size("sources") > 0) & F.col("target").isNotNull() & (F.col("target") != ""))


@dataclass
class ProjectionKinds:
    """Named projections that callers add: a name is taken once, and listed in order."""

    kinds: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, name: str, make: Callable[..., DataFrame]) -> None:
        if name in self.kinds:
            raise ValueError(f"{name} is registered")
        self.kinds[name] = make

    def unregister(self, name: str) -> None:
        del self.kinds[name]

    def __iter__(self):
        return iter(sorted(self.kinds.items()))


def polymorphic(table: DataFrame, discriminator: str, kind: str, columns: list[str] | None = None) -> DataFrame:
    """One kind's rows of a table that holds several."""
    rows = table.where(F.col(discriminator) == kind)
    return rows.select(*columns) if columns else rows


def dependencies(records: DataFrame, family: str, id_column: str, references: dict[str, str]) -> DataFrame:
    """(source, target, field), one row for each different reference: ``references`` gives the target family by nested path."""
    out = None
    for path, target in references.items():
        found = F.explode(F.array_distinct(F.transform(field_values(records, path), lambda x: x.cast("string"))))
        rows = records.select(F.concat(F.lit(family + ":"), F.col(id_column).cast("string")).alias("source"), found.alias("to"))
        rows = rows.select("source", F.concat(F.lit(target + ":"), "to").alias("target"), F.lit(path).alias("field"))
        out = rows if out is None else out.unionByName(rows)
    return out
