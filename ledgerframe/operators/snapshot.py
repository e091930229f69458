"""Snapshot algebra: manifests (path, oid) as DataFrames.

A commit's manifest is flat; directories exist only as prefixes of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refcodec import normalize_path


class PathConflict(ValueError):
    """An added path lies below a file, or stands where a directory is."""


class MergeConflict(ValueError):
    """Both sides changed a path, differently."""


class RevertBlocked(ValueError):
    """A path was changed again since the commit to revert."""


def below(entries: DataFrame, directory: str) -> DataFrame:
    """Entries below a directory, with ``rel``, their path from there; all for the root."""
    if not directory:
        return entries.withColumn("rel", F.col("path"))
    return entries.where(F.col("path").startswith(directory + "/")).withColumn("rel", F.substring("path", len(directory) + 2, 1 << 30))


def read_file(entries: DataFrame, blobs: DataFrame, path: str) -> DataFrame:
    """(path, oid, data) of one path; no row for a missing path or a directory."""
    return entries.where(F.col("path") == path).join(blobs, "oid").select("path", "oid", "data")


def children(entries: DataFrame, directory: str = "") -> DataFrame:
    """(name, is_dir) of what lies directly in a directory, by name."""
    part = below(entries, directory).select(F.substring_index("rel", "/", 1).alias("name"), F.col("rel").contains("/").alias("deeper"))
    return part.groupBy("name").agg(F.max("deeper").alias("is_dir")).orderBy("name")


def subtree(entries: DataFrame, blobs: DataFrame, roots: list[str]) -> DataFrame:
    """(root, rel, data) below each root; roots that overlap repeat their rows."""
    parts = [below(entries, r).withColumn("root", F.lit(r)) for r in roots]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(blobs, "oid").select("root", "rel", "data").orderBy("root", "rel")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, change) from left to right: added, modified, deleted."""
    both = left.select("path", F.col("oid").alias("l")).join(right.select("path", F.col("oid").alias("r")), "path", "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "deleted").when(F.col("l") != F.col("r"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def _merged(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """(conflict, result) of three values, where null is absence."""
    same, only_left, only_right = left.eqNullSafe(right), right.eqNullSafe(base), left.eqNullSafe(base)
    return ~(same | only_left | only_right), F.when(same | only_left, left).when(only_right, right)


def three_way(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, base, left, right, conflict, oid) of every path that any side has."""
    rows = base.select("path", F.col("oid").alias("base")).join(left.select("path", F.col("oid").alias("left")), "path", "full_outer")
    rows = rows.join(right.select("path", F.col("oid").alias("right")), "path", "full_outer")
    conflict, oid = _merged(F.col("base"), F.col("left"), F.col("right"))
    return rows.select("path", "base", "left", "right", conflict.alias("conflict"), oid.alias("oid"))


def merge(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The merged manifest; the first conflict by path raises."""
    rows = three_way(base, left, right)
    first = rows.where("conflict").agg(F.min("path")).first()[0]
    if first is not None:
        raise MergeConflict(first)
    return rows.where("oid is not null").select("path", "oid")


def apply_batch(head: DataFrame, adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """Adds, then deletes: a path in both is deleted; deleting what is not there does nothing."""
    added = head.join(adds, "path", "left_anti").select("path", "oid").unionByName(adds.select("path", "oid"))
    return added.join(deletes.select("path"), "path", "left_anti")


def last_staged(staged: DataFrame) -> DataFrame:
    """Of staged operations (path, op, seq, oid) the last for each path."""
    last = staged.groupBy("path").agg(F.max_by(F.struct("op", "oid", "seq"), "seq").alias("last"))
    return last.select("path", "last.op", "last.oid", "last.seq")


def prefix_conflicts(head: DataFrame, adds: DataFrame) -> DataFrame:
    """(path, with): adds that lie below another path, or on a directory of the head."""

    def parents(df: DataFrame) -> DataFrame:
        parts = df.select("path", F.split("path", "/").alias("s"))
        rows = parts.where("size(s) > 1").select("path", F.explode(F.expr("sequence(1, size(s) - 1)")).alias("k"), "s")
        return rows.select("path", F.array_join(F.slice("s", F.lit(1), F.col("k")), "/").alias("parent"))

    files = adds.select(F.col("path").alias("parent")).unionByName(head.select(F.col("path").alias("parent"))).distinct()
    under = parents(adds).join(files, "parent").select("path", F.col("parent").alias("with"))
    over = adds.select(F.col("path").alias("parent")).join(parents(head), "parent").select(F.col("parent").alias("path"), F.col("path").alias("with"))
    return under.unionByName(over).distinct()


def tree_errors(entries: DataFrame) -> DataFrame:
    """Paths that, once normalised, are given with different objects."""
    made = entries.select(normalize_path(F.col("path")).alias("path"), "oid")
    return made.groupBy("path").agg(F.countDistinct("oid").alias("n")).where("n > 1").select("path")


def revert(parent: DataFrame, target: DataFrame, current: DataFrame) -> DataFrame:
    """(path, oid or null for delete, blocked): what undoes target relative to its parent, on top of current."""
    rows = parent.select("path", F.col("oid").alias("was")).join(target.select("path", F.col("oid").alias("became")), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("became")))
    rows = rows.join(current.select("path", F.col("oid").alias("now")), "path", "left")
    return rows.select("path", F.col("was").alias("oid"), (~F.col("now").eqNullSafe(F.col("became"))).alias("blocked"))


def reverted(parent: DataFrame, target: DataFrame, current: DataFrame) -> DataFrame:
    """The manifest after reverting; raises where a touched path was changed since."""
    steps = revert(parent, target, current)
    first = steps.where("blocked").agg(F.min("path")).first()[0]
    if first is not None:
        raise RevertBlocked(first)
    return apply_batch(current, steps.where("oid is not null").select("path", "oid"), steps.where("oid is null").select("path"))


def unreachable(objects: DataFrame, manifests: DataFrame) -> DataFrame:
    """Objects that no manifest names."""
    return objects.join(manifests.select("oid"), "oid", "left_anti")


#: Rows of a round that are broadcast at most; a larger round is joined by a shuffle.
NARROW = 1 << 17


def ancestors(parents: DataFrame, start: list, id_type: str = "string") -> DataFrame:
    """(start, id, distance): all ancestors with their least distance; parents has (id, parent).

    Breadth first: each round joins the last frontier with the parents and drops what
    was met, and is checkpointed, so plans stay short.  Rounds are as many as the longest
    of the shortest ways, not as the ways.  Neither the parents nor what was met move in a
    round of up to ``NARROW`` rows.
    """
    spark = parents.sparkSession
    frontier = spark.createDataFrame([(s, s) for s in start], f"start {id_type}, id {id_type}").withColumn("distance", F.lit(0))
    n = len(start)
    met = Grown(frontier, n)
    while n:
        step = _narrow(frontier, n).join(parents, "id").select("start", F.col("parent").alias("id"), (F.col("distance") + 1).alias("distance")).distinct()
        frontier = saved(_unmet(step, met))
        n = frontier.count()
        met.add(frontier, n)
    return met.rows()


def _narrow(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, which are ``n``, to be broadcast if they are few: a checkpoint's size is not known to the planner."""
    return F.broadcast(rows) if n <= NARROW else rows


def _unmet(step: DataFrame, met: Grown) -> DataFrame:
    """The rows of ``step`` that were not met; the smaller of the two is broadcast if it is small."""
    on = ["start", "id"]
    if met.n > NARROW and (n := (step := saved(step)).count()) <= NARROW:
        again = met.rows().join(F.broadcast(step.select(*on)), on, "left_semi").select(*on)  # at most n
        return step.join(F.broadcast(again), on, "left_anti")
    return step.join(_narrow(met.rows(), met.n), on, "left_anti")


class Grown:
    """A table that grows by rounds: what is added is kept as it was written, and the parts are
    put together in one only where they are ``parts``, so a row is rewritten a few times at most."""

    def __init__(self, first: DataFrame, n: int = 0, parts: int = 16) -> None:
        self.levels, self.n, self.parts = [[first]], n, parts

    def add(self, rows: DataFrame, n: int = 0) -> None:
        self.levels[0].append(rows)
        self.n += n
        for k, level in enumerate(self.levels):
            if len(level) < self.parts:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(saved(_union(level)))
            level.clear()

    def rows(self) -> DataFrame:
        return _union([part for level in self.levels for part in level])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable_commits(parents: DataFrame, heads: list[str]) -> DataFrame:
    """(sha) of the heads and all their ancestors."""
    return ancestors(parents, heads).select(F.col("id").alias("sha")).distinct()


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed; only a local session may have no folder for that yet."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if given := df.sparkSession.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(given)
        elif context.master.startswith("local"):
            import tempfile

            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return df.checkpoint()


def merge_bases(parents: DataFrame, a, b, id_type: str = "string") -> DataFrame:
    """All best common ancestors, by id: those that are no ancestor of another one."""
    up = ancestors(parents, [a, b], id_type)
    common = up.where(F.col("start") == F.lit(a)).select("id").join(up.where(F.col("start") == F.lit(b)).select("id"), "id")
    common = saved(common.distinct())
    # an ancestor of a common one is common: it is inferior exactly if it is the parent of a common one, or above such
    worse = _narrow(common, common.count()).join(parents, "id").select(F.col("parent").alias("id")).distinct()
    return common.join(worse, "id", "left_anti").orderBy("id")


def merge_base(parents: DataFrame, a, b, id_type: str = "string"):
    """The smallest of the best common ancestors; None where there is none."""
    return merge_bases(parents, a, b, id_type).agg(F.min("id")).first()[0]


def directory_digest(entries: DataFrame, directory: str = "") -> DataFrame:
    """(path, digest) of the directory and all below it: a digest of its entries' sorted names, kinds and digests.

    Level by level from the deepest, one aggregation each: as many as directories are deep.
    """
    rows = below(entries, directory).select(F.col("rel").alias("path"), F.col("oid").alias("digest"), F.lit("file").alias("kind"))
    depth = rows.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    out = None
    for level in range(depth, 0, -1):
        here = F.size(F.split("path", "/")) == level
        parent = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
        line = F.concat_ws("\t", "kind", F.substring_index("path", "/", -1), "digest")
        made = rows.where(here).groupBy(parent.alias("path")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))
        made = saved(made.withColumn("kind", F.lit("directory")))
        out = made if out is None else out.unionByName(made)
        rows = rows.where(~here).unionByName(made.where("path <> ''"))
    return (out if out is not None else rows.limit(0)).select("path", "digest")
