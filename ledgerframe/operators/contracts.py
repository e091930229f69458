"""Schema contracts: versioned, hashed bodies, checked for drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.canonical import canonical_json_sha256


class ContractDrift(ValueError):
    """A body changed without a new version or a marker."""


@dataclass(frozen=True)
class Entry:
    """``compatible`` marks that this version's body may differ from what was published under it."""

    kind: str
    name: str
    version: str
    body: object
    compatible: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.name}"

    @property
    def digest(self) -> str:
        return canonical_json_sha256(self.body)


def manifest(spark, entries: list[Entry]) -> DataFrame:
    """(key, version, digest, compatible); a key may be given once."""
    keys = [e.key for e in entries]
    if twice := sorted({k for k in keys if keys.count(k) > 1}):
        raise ValueError(f"given twice: {', '.join(twice)}")
    rows = sorted((e.key, e.version, e.digest, e.compatible) for e in entries)
    return spark.createDataFrame(rows, "key string, version string, digest string, compatible boolean")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status): added, removed, unchanged (same body and version), bumped (new version, whatever
    the body), compatible (new body under the same version, marked), failed."""
    o = old.select("key", F.col("version").alias("ov"), F.col("digest").alias("od"))
    n = new.select("key", F.col("version").alias("nv"), F.col("digest").alias("nd"), F.col("compatible").alias("mark"))
    status = F.when(F.col("ov").isNull(), "added").when(F.col("nv").isNull(), "removed").when(F.col("ov") != F.col("nv"), "bumped").when(F.col("od") == F.col("nd"), "unchanged").when(F.col("mark"), "compatible").otherwise("failed")
    return o.join(n, "key", "full_outer").select("key", status.alias("status"))


def check(old: DataFrame, new: DataFrame) -> DataFrame:
    """``compare``; the failed keys raise."""
    result = compare(old, new)
    failed = result.where("status = 'failed'").agg(F.min("key"), F.count(F.lit(1))).first()
    if failed[1]:
        raise ContractDrift(f"{failed[0]} ({failed[1]} in all)")
    return result


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Values given more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
