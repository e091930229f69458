"""Committed snapshots as tables: blobs, commits, manifests, and refs with compare-and-swap.

Tables are Parquet below a shared root; a ref is a folder of numbered files, of which
the highest is current.  A number's file is written aside and renamed into place, which
fails where it is there already: readers see whole files, and one writer wins.  That
needs a store whose rename is atomic and does not replace (HDFS; a local disk for one
process), not an object store.  Only refs decide what is visible: a writer that loses
the race leaves files that no ref leads to.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.canonical import blob_oid, canonical_json_sha256
from ..functions.refcodec import normalize_path
from ..operators import snapshot


class HeadMismatch(RuntimeError):
    """The ref is not where the writer expected it."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _read(self, *parts: str) -> dict:
        stream = self._fs.open(self._path(*parts))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    # refs

    def _ref(self, name: str) -> tuple[int, str | None]:
        numbers = [int(n) for n in self._names("refs", name.replace("/", "%2F")) if n.isdigit()]
        if not numbers:
            return 0, None
        return max(numbers), self._read("refs", name.replace("/", "%2F"), str(max(numbers)))["oid"]

    def head(self, name: str) -> str | None:
        return self._ref(name)[1]

    def swap(self, name: str, expected: str | None, new: str | None) -> None:
        """Moves a ref from ``expected`` (None: absent) to ``new`` (None: deleted), or raises."""
        number, now = self._ref(name)
        if now != expected:
            raise HeadMismatch(f"{name} is at {now}, not {expected}")
        aside, folder = self._path("aside", uuid.uuid4().hex), ("refs", name.replace("/", "%2F"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"oid": new}).encode()))
        out.close()
        self._fs.mkdirs(self._path(*folder))
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(*folder, str(number + 1)), options)
        except Exception as error:  # the JVM's FileAlreadyExistsException
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(error):
                raise HeadMismatch(f"{name} was moved by another writer") from error
            raise

    def refs(self, prefix: str = "") -> DataFrame:
        rows = []
        for n in self._names("refs"):
            name = n.replace("%2F", "/")
            if name.startswith(prefix) and (oid := self.head(name)) is not None:
                rows.append((name, oid))
        return self.spark.createDataFrame(sorted(rows), "name string, oid string")

    # objects

    def put_blobs(self, files: DataFrame) -> DataFrame:
        """(path, oid) of files (path, data); only data not yet stored is written, once."""
        rows = files.select("path", blob_oid(F.col("data")).alias("oid"), "data")
        fresh = rows.select("oid", "data").dropDuplicates(["oid"])
        if (have := self.blobs()) is not None:
            fresh = fresh.join(have.select("oid"), "oid", "left_anti")
        fresh.write.mode("append").parquet(f"{self.root}/blobs")
        return rows.select("path", "oid")

    def blobs(self) -> DataFrame | None:
        return self.spark.read.schema("oid string, data binary").parquet(f"{self.root}/blobs") if self._fs.exists(self._path("blobs")) else None

    def manifest(self, commit: str | None) -> DataFrame:
        if commit is None:
            return self.spark.createDataFrame([], "path string, oid string")
        return self.spark.read.schema("path string, oid string").parquet(f"{self.root}/manifests/{commit}")

    def commits(self) -> DataFrame:
        return self.spark.read.schema("sha string, parents array<string>, message string, ts double").json(f"{self.root}/commits")

    # commits

    def commit_manifest(self, manifest: DataFrame, message: str, parents: list[str], ref: str, expected: str | None) -> str:
        """Publishes a whole manifest with the given parents."""
        if self.head(ref) != expected:
            raise HeadMismatch(f"{ref} is not at {expected}")
        manifest = self._paths(manifest)
        body = {"parents": parents, "message": message, "ts": time.time_ns() / 1e9, "ref": ref}
        sha = canonical_json_sha256({**body, "ts": repr(body["ts"])}).removeprefix("sha256:")
        manifest.select("path", "oid").write.parquet(f"{self.root}/manifests/{sha}")
        out = self._fs.create(self._path("commits", f"{sha}.json"), False)
        out.write(bytearray(json.dumps({"sha": sha, **body}).encode()))
        out.close()
        self.swap(ref, expected, sha)
        return sha

    @staticmethod
    def _paths(entries: DataFrame) -> DataFrame:
        """(path, oid) with normalised paths, each once; a path with two objects, or none, raises."""
        made = entries.select(normalize_path(F.col("path")).alias("path"), "oid").distinct()
        bad = snapshot.tree_errors(made).unionByName(made.where("path = ''").select("path")).limit(1).collect()
        if bad:
            raise snapshot.PathConflict(bad[0][0] or "empty path")
        return made

    def commit(self, adds: DataFrame | None, deletes: DataFrame | None, message: str, ref: str = "refs/heads/main", expected: str | None | type = ...) -> str:
        """Adds (path, data), then deletes (path), on top of the ref's head; an empty batch commits too.

        Paths are normalised; one that is added twice must have the same data.  An add below a
        file of the head, or on one of its directories, raises, even if the batch deletes that.
        """
        head = self.head(ref)
        if expected is not ... and head != expected:
            raise HeadMismatch(f"{ref} is at {head}, not {expected}")
        base = self.manifest(head)
        added = self._paths(self.put_blobs(adds)) if adds is not None else self.spark.createDataFrame([], "path string, oid string")
        gone = deletes if deletes is not None else self.spark.createDataFrame([], "path string")
        gone = gone.select(normalize_path(F.col("path")).alias("path")).distinct()
        bad = snapshot.prefix_conflicts(base, added).limit(1).collect()
        if bad:
            raise snapshot.PathConflict(f"{bad[0][0]} and {bad[0][1]}")
        return self.commit_manifest(snapshot.apply_batch(base, added, gone), message, [head] if head else [], ref, head)

    def log(self, ref: str = "refs/heads/main", limit: int = 50) -> DataFrame:
        """The ref's history, newest first."""
        head = self.head(ref)
        reached = snapshot.reachable_commits(self.parents(), [head])
        return self.commits().join(reached, "sha").orderBy(F.col("ts").desc(), "sha").limit(limit)

    def fetch(self, other: SnapshotStore, remote: str, local: str, expected: str | None) -> str:
        """Copies what a remote ref reaches and is not here, then moves the local ref."""
        head = other.head(remote)
        if head is None:
            raise KeyError(remote)
        missing = snapshot.reachable_commits(other.parents(), [head]).join(self._shas(), "sha", "left_anti")
        manifests = other.manifests().join(missing, "sha", "left_semi")
        fresh = other.blobs().join(manifests.select("oid"), "oid", "left_semi").dropDuplicates(["oid"])
        if (have := self.blobs()) is not None:
            fresh = fresh.join(have.select("oid"), "oid", "left_anti")
        fresh.write.mode("append").parquet(f"{self.root}/blobs")
        shas = [r[0] for r in missing.collect()]  # commits, not documents
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        manifests.write.partitionBy("sha").parquet(aside)
        for sha in shas:
            self._fs.mkdirs(self._path("manifests"))
            if not self._fs.rename(self._jvm.org.apache.hadoop.fs.Path(f"{aside}/sha={sha}"), self._path("manifests", sha)):
                other.manifest(sha).write.mode("overwrite").parquet(f"{self.root}/manifests/{sha}")  # an empty one has no folder
            out = self._fs.create(self._path("commits", f"{sha}.json"), True)
            out.write(bytearray(json.dumps(other._read("commits", f"{sha}.json")).encode()))
            out.close()
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(aside), True)
        self.swap(local, expected, head)
        return head

    # reachability

    def parents(self) -> DataFrame:
        """(id, parent) of all commits."""
        return self.commits().select(F.col("sha").alias("id"), F.explode("parents").alias("parent"))

    def manifests(self) -> DataFrame:
        """(sha, path, oid) of all commits in one table."""
        rows = self.spark.read.schema("path string, oid string").option("recursiveFileLookup", "true").parquet(f"{self.root}/manifests")
        return rows.select(F.regexp_extract("_metadata.file_path", "/manifests/([^/]+)/", 1).alias("sha"), "path", "oid")

    def _shas(self) -> DataFrame:
        return self.spark.createDataFrame([(n.removesuffix(".json"),) for n in self._names("commits")], "sha string")

    def unreachable(self) -> DataFrame:
        """(oid) of blobs that no commit which some ref leads to names."""
        heads = [r.oid for r in self.refs("refs/heads/").collect()]
        reached = snapshot.reachable_commits(self.parents(), heads)
        return snapshot.unreachable(self.blobs().select("oid"), self.manifests().join(reached, "sha", "left_semi"))

    def summary(self, sha: str) -> DataFrame:
        """(path, change) of a commit against its first parent."""
        up = self._read("commits", f"{sha}.json")["parents"]
        return snapshot.diff(self.manifest(up[0] if up else None), self.manifest(sha))

    def exists(self, ref: str, path: str) -> bool:
        """Whether a path is a file or a directory at a ref's head."""
        at = path.strip("/")
        rows = self.manifest(self.head(ref)).where((F.col("path") == at) | F.col("path").startswith(at + "/") | F.lit(not at))
        return not rows.isEmpty()

    def export(self, ref: str, directory: str) -> int:
        """Writes the files of a ref's head below a folder, from the executors; returns how many.

        The folder must be one that all machines reach by its path.
        """
        files = self.manifest(self.head(ref)).join(self.blobs(), "oid").select("path", "data")

        def write(frames):
            import os
            import pathlib

            for f in frames:
                for path, data in zip(f["path"], f["data"]):
                    to = pathlib.Path(directory, path)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    aside = to.with_name(f".{to.name}.{os.getpid()}")
                    aside.write_bytes(data)
                    aside.replace(to)
                yield f[["path"]]

        return files.mapInPandas(write, "path string").count()

    # notes

    def write_note(self, notes: str, target: str, payload: str | None) -> None:
        """Sets the note on an object; None deletes it."""
        ref = f"refs/notes/{notes}/{target}"
        self.swap(ref, self.head(ref), payload)

    def read_note(self, notes: str, target: str) -> str | None:
        return self.head(f"refs/notes/{notes}/{target}")
