"""Derived tables, built once per content: the key of a build is the digest of what it depends on."""

from __future__ import annotations

import graphlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.canonical import canonical_json_sha256


@dataclass(frozen=True)
class Step:
    name: str
    after: tuple[str, ...] = ()


def build_order(steps: list[Step]) -> list[str]:
    """Steps after what they need, by name among equals; unknown, repeated and circular ones raise."""
    names = [s.name for s in steps]
    if len(set(names)) != len(names):
        raise ValueError("a step is given twice")
    if unknown := sorted({a for s in steps for a in s.after} - set(names)):
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    sorter = graphlib.TopologicalSorter({s.name: s.after for s in steps})
    sorter.prepare()
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def cache_key(projection: str, commit: str, inputs: Mapping[str, str]) -> str:
    return canonical_json_sha256({"projection": projection, "commit": commit, "inputs": dict(inputs)}).removeprefix("sha256:")


class DerivedTables:
    """Parquet folders named by key under a root that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(key, "_SUCCESS"))

    def materialize(self, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(table, built): an existing build is read; else it is written aside and renamed, so a
        failed or concurrent build never shows half a table."""
        built = False
        if not self.exists(key):
            import uuid

            aside = self._path(f".building-{uuid.uuid4().hex}")
            build().write.parquet(aside.toString())
            built = bool(self._fs.rename(aside, self._path(key)))
            if not built:
                self._fs.delete(aside, True)
        return self.spark.read.parquet(f"{self.root}/{key}"), built

    def gc(self, keep: set[str]) -> list[str]:
        """Deletes all other builds and what failed builds left; returns their names."""
        if not self._fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        gone = sorted(n for n in names if n not in keep)
        for n in gone:
            self._fs.delete(self._path(n), True)
        return gone
