"""Reference resolution, foreign keys and identity transport as joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


class BadReference(ValueError):
    """A reference is ambiguous, dangling or malformed."""


def _field(name: str) -> Callable[[Column], Column]:
    # a lambda with a second parameter, even a given one, would get the element's place
    return lambda x: x.getField(name)


def field_values(df: DataFrame, path: str) -> Column:
    """Array of the strings at a nested path ``a.b[].c``; ``[]`` flattens a list, null and "" are dropped.

    A list without ``[]`` is one value, and so no string: the path is refused.
    """
    kind: T.DataType = df.schema
    value, many = None, False
    for part in path.split("."):
        name, listed = part.removesuffix("[]"), part.endswith("[]")
        kind = kind[name].dataType
        if value is None:
            value = F.col(f"`{name}`")
        elif many:
            value = F.transform(value, _field(name))
        else:
            value = value.getField(name)
        if listed:
            kind = kind.elementType
            value = F.flatten(F.filter(value, lambda x: x.isNotNull())) if many else value
            many = True
    if isinstance(kind, T.ArrayType):
        raise BadReference(f"{path}: a list needs []")
    found = value if many else F.array(value)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x.cast("string") != ""))


def lookup(records: DataFrame, id_column: str, keys: list[str], family: str | None = None) -> DataFrame:
    """(key, id, n): every id under its own key and its alias keys, the smallest id and how many
    (an id counts once per key); ``candidates`` lists them.

    ``keys`` are nested paths (see ``field_values``).  Rows without an id are left out.
    With ``family`` the rows carry that name, so that lookups can be put together.
    """
    named = records.where(F.col(id_column).isNotNull() & (F.col(id_column).cast("string") != ""))
    every = F.array_distinct(F.concat(F.array(F.col(id_column).cast("string")), *[F.transform(field_values(records, k), lambda x: x.cast("string")) for k in keys]))
    pairs = named.select(F.explode(every).alias("key"), F.col(id_column).alias("id"))
    out = pairs.groupBy("key").agg(F.min("id").alias("id"), F.count_distinct("id").cast("int").alias("n"))
    return out.withColumn("family", F.lit(family)) if family else out


def candidates(records: DataFrame, id_column: str, keys: list[str], only: DataFrame) -> DataFrame:
    """(key, id), a row for each id that the keys in ``only`` (key) name; no list is built."""
    every = F.array_distinct(F.concat(F.array(F.col(id_column).cast("string")), *[F.transform(field_values(records, k), lambda x: x.cast("string")) for k in keys]))
    pairs = records.where(F.col(id_column).isNotNull()).select(F.explode(every).alias("key"), F.col(id_column).alias("id")).distinct()
    return pairs.join(only.select("key").distinct(), "key", "left_semi")


def ambiguous(records: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """Keys that name more than one id, and how many (counts only: no list is built)."""
    every = F.array_distinct(F.concat(F.array(F.col(id_column).cast("string")), *[F.transform(field_values(records, k), lambda x: x.cast("string")) for k in keys]))
    pairs = records.where(F.col(id_column).isNotNull()).select(F.explode(every).alias("key"), F.col(id_column).alias("id")).distinct()
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_lookup(records: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """A lookup in which every key is one id's; the smallest ambiguous key raises."""
    first = ambiguous(records, id_column, keys).agg(F.min("key")).first()[0]
    if first is not None:
        raise BadReference(f"ambiguous: {first}")
    return lookup(records, id_column, keys)


def resolve(refs: DataFrame, column: str, index: DataFrame, family: str | None = None) -> DataFrame:
    """``refs`` with id and status: ok, ambiguous, missing, or empty for a null or empty reference.

    With ``family`` that column of ``refs`` chooses among the families of ``index``.
    """
    on = F.col(f"r.{column}").cast("string") == F.col("i.key")
    if family:
        on = on & (F.col(f"r.{family}") == F.col("i.family"))
    joined = refs.alias("r").join(index.alias("i"), on, "left")
    status = F.when(F.col(f"r.{column}").isNull() | (F.col(f"r.{column}").cast("string") == ""), "empty").when(F.col("i.n").isNull(), "missing").when(F.col("i.n") > 1, "ambiguous").otherwise("ok")
    return joined.select("r.*", F.when(F.col("i.n") == 1, F.col("i.id")).alias("id"), status.alias("status"))


@dataclass(frozen=True)
class ForeignKey:
    """``field`` of ``source`` names rows of ``target``; ``target_field`` only matters to SQL, resolution goes by id and aliases."""

    source: str
    field: str
    target: str
    required: bool = True
    many: bool = False
    target_field: str | None = None


def violations(records: DataFrame, id_column: str, key: ForeignKey, index: DataFrame) -> DataFrame:
    """(id, value, reason): required, cardinality, ambiguous or dangling references; no row: valid."""
    rows = records.select(F.col(id_column).alias("id"), F.transform(field_values(records, key.field), lambda x: x.cast("string")).alias("v"))
    absent = rows.where(F.size("v") == 0).select("id", F.lit(None).cast("string").alias("value"), F.lit("required").alias("reason"))
    crowded = rows.where(F.size("v") > 1).select("id", F.lit(None).cast("string").alias("value"), F.lit("cardinality").alias("reason"))
    found = resolve(rows.select("id", F.explode("v").alias("value")).withColumnRenamed("id", "_of"), "value", index)
    bad = found.where("status in ('missing', 'ambiguous')").select(F.col("_of").alias("id"), "value", F.when(F.col("status") == "missing", "dangling").otherwise("ambiguous").alias("reason"))
    if key.required:
        bad = bad.unionByName(absent)
    return bad if key.many else bad.unionByName(crowded)


def dangling(records: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Rows whose non-null reference has no target row."""
    return records.where(F.col(column).isNotNull()).join(target.select(F.col(target_column).alias(column)), column, "left_anti")


def post_state(base: DataFrame, id_column: str, saves: DataFrame, deletes: DataFrame) -> DataFrame:
    """Records as they will be: base without what is deleted or saved anew, and the saves."""
    rest = base.join(deletes.select(id_column), id_column, "left_anti").join(saves.select(id_column), id_column, "left_anti")
    return rest.unionByName(saves)


def quarantine(records: DataFrame, column: str, target: DataFrame, target_column: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) under advisory enforcement: nothing is lost, nothing dangling is let through."""
    targets = target.select(F.col(target_column).alias(column))
    valid = records.where(F.col(column).isNull()).unionByName(records.join(targets, column, "left_semi").select(*records.columns))
    return valid, dangling(records, column, target, target_column).select(*records.columns)


def validate_registry(records: Mapping[str, tuple[DataFrame, str]], keys: list[ForeignKey], aliases: Mapping[str, list[str]] | None = None, touched: set[str] | None = None) -> DataFrame:
    """All violations (source, field, id, value, reason) over the keys that touch a changed family (all, if None)."""
    out = None
    for key in keys:
        if touched is not None and not {key.source, key.target} & touched:
            continue
        rows, ident = records[key.source]
        target, target_id = records[key.target]
        found = violations(rows, ident, key, lookup(target, target_id, (aliases or {}).get(key.target, [])))
        found = found.select(F.lit(key.source).alias("source"), F.lit(key.field).alias("field"), F.col("id").cast("string").alias("id"), "value", "reason")
        out = found if out is None else out.unionByName(found)
    return out


def image_conflicts(images: DataFrame) -> DataFrame:
    """Sources that are given two different images."""
    return images.groupBy("source").agg(F.countDistinct("target").alias("n")).where("n > 1").select("source")


def rewrite(records: DataFrame, column: str, images: DataFrame) -> DataFrame:
    """References replaced by their images; those without one stay."""
    kept = [c for c in records.columns if c != column]
    joined = records.alias("r").join(images.alias("m"), F.col(f"r.{column}") == F.col("m.source"), "left")
    return joined.select(*[F.col(f"r.{c}") for c in kept], F.coalesce("m.target", f"r.{column}").alias(column)).select(*records.columns)


def _replaced(value: Column, parts: list[str], image: Column) -> Column:
    """``value`` with the strings at a nested path replaced by what the map ``image`` holds for them."""
    part = parts[0]
    name, listed = part.removesuffix("[]"), part.endswith("[]")

    def one(x: Column) -> Column:
        return F.coalesce(image[x], x) if len(parts) == 1 else _replaced(x, parts[1:], image)

    inner = F.transform(value[name], one) if listed else one(value[name])
    return F.when(value.isNotNull(), value.withField(name, inner))


def _image_of(rest: list[str]) -> Callable[[Column], Column]:
    image = F.col("_image")
    return lambda x: F.coalesce(image[x], x) if not rest else _replaced(x, rest, image)


def rewrite_paths(records: DataFrame, id_column: str, images: Mapping[str, DataFrame]) -> DataFrame:
    """References at nested paths ``a.b[].c`` replaced by their images (source, target) in one pass.

    All paths of a record are replaced together.  A path that is given twice, or that holds
    another one, would be replaced twice: it raises.  References without image stay.
    """
    plain = sorted(p.replace("[]", "") for p in images)
    for a, b in zip(plain, plain[1:]):
        if b == a or b.startswith(a + "."):
            raise BadReference(f"paths overlap: {a}, {b}")
    out = records
    for path, pairs in images.items():
        refs = out.select(F.col(id_column).alias("_of"), F.explode(F.array_distinct(F.transform(field_values(out, path), lambda x: x.cast("string")))).alias("source"))
        found = refs.join(pairs.select("source", "target"), "source").where("source <> target")
        # a record's own references: they fit a row, as the record does
        maps = found.groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("_image"))
        head, *rest = path.split(".")
        name, listed = head.removesuffix("[]"), head.endswith("[]")
        joined = out.join(maps, F.col(id_column) == F.col("_of"), "left")

        one = _image_of(rest)
        value = F.transform(F.col(f"`{name}`"), one) if listed else one(F.col(f"`{name}`"))
        made = F.when(F.col("_image").isNull(), F.col(f"`{name}`")).otherwise(value).alias(name)
        out = joined.select(*[made if c == name else F.col(f"`{c}`") for c in records.columns])
    return out


def transport_family(
    records: DataFrame,
    id_column: str,
    external: Mapping[str, DataFrame],
    self_paths: list[str],
    identity: Callable[[DataFrame], Column] | None,
    assigned: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(the records in their new identities, images (source, target) of those that were touched).

    ``external``: images of the references to other families, by path; ``self_paths`` refer to
    the family itself; ``assigned``: images given beforehand.  Touched is what refers to something
    that moved, and again what refers to that: one join a round over the referrers, cycles
    included.  New ids come from ``identity`` with external references replaced and own ones as
    they were; the result must give the same ids, so an identity that depends on own references
    raises, as do dangling own references and two images for one record.
    """
    from .snapshot import Grown, saved

    rows = saved(records)
    moved = saved(rewrite_paths(rows, id_column, external) if external else rows)
    own = None
    for path in self_paths:
        some = rows.select(F.col(id_column).cast("string").alias("id"), F.explode(F.transform(field_values(rows, path), lambda x: x.cast("string"))).alias("ref"))
        own = some if own is None else own.unionByName(some)
    ids = rows.select(F.col(id_column).cast("string").alias("id"))
    if own is not None:
        own = saved(own.distinct())
        lost = own.join(ids.withColumnRenamed("id", "ref"), "ref", "left_anti").agg(F.min("ref")).first()[0]
        if lost is not None:
            raise BadReference(f"dangling: {lost}")
    before, after = rows.select(F.col(id_column).cast("string").alias("id"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("x")), moved.select(F.col(id_column).cast("string").alias("id"), F.struct(*[F.col(f"`{c}`") for c in moved.columns]).alias("y"))
    start = before.join(after, "id").where(F.to_json("x") != F.to_json("y")).select("id").distinct()
    given = assigned.select("source", "target") if assigned is not None else None
    if given is not None and own is not None:
        start = start.unionByName(own.join(given.where("source <> target").select(F.col("source").alias("ref")), "ref").select("id")).distinct()
    frontier = saved(start)
    planned = moved.select(F.col(id_column).cast("string").alias("source"), (identity(moved) if identity else F.lit(None)).cast("string").alias("target"))
    if identity is None and not frontier.isEmpty():
        raise BadReference("the family has no identity operation")
    touched = Grown(frontier)
    while own is not None and not frontier.isEmpty():
        renamed = planned.join(frontier.withColumnRenamed("id", "source"), "source", "left_semi").where("source <> target").select(F.col("source").alias("ref"))
        frontier = saved(own.join(renamed, "ref").select("id").distinct().join(touched.rows(), "id", "left_anti"))
        touched.add(frontier)
    hit = touched.rows().distinct()
    images = saved(planned.join(hit.withColumnRenamed("id", "source"), "source", "left_semi"))
    if given is not None:
        images = saved(images.unionByName(given).distinct())
    if (twice := image_conflicts(images).agg(F.min("source")).first()[0]) is not None:
        raise BadReference(f"conflicting images for {twice}")
    final = rewrite_paths(moved, id_column, {p: images for p in self_paths}) if self_paths else moved
    fresh = final.withColumn("_new", (identity(final) if identity else F.col(id_column)).cast("string"))
    mine = images.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    joined = fresh.join(mine, F.col(id_column).cast("string") == F.col("_source"), "left").join(hit.withColumnRenamed("id", "_hit"), F.col(id_column).cast("string") == F.col("_hit"), "left")
    wrong = F.when(F.col("_hit").isNotNull() & (F.col("_new") != F.col("_target")), F.raise_error(F.concat(F.lit("conflicting images for "), F.col("_source"))))
    kind = records.schema[id_column].dataType
    ident = F.when(F.col("_hit").isNull(), F.col(f"`{id_column}`")).when(wrong.isNull(), F.col("_target").cast(kind)).alias(id_column)
    return joined.select(*[ident if c == id_column else F.col(f"`{c}`") for c in records.columns]), images


def transport_order(links: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, level): when each row of a self-referencing family (id, ref or null) gets its new identity.

    Level 0 refers to nothing inside the family, each next level only to earlier ones.
    Rows on or behind a cycle have level -1: their images must be planned together.
    """
    from .snapshot import Grown, saved

    inside = links.where("ref is not null").join(links.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("id", "ref").distinct()
    ids = links.select("id").distinct()
    frontier = saved(ids.join(inside, "id", "left_anti").withColumn("level", F.lit(0)))
    done = Grown(frontier)
    for level in range(1, rounds):
        if frontier.isEmpty():
            break
        waiting = inside.join(done.rows().select(F.col("id").alias("ref")), "ref", "left_anti").select("id").distinct()
        touched = inside.join(frontier.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
        frontier = saved(touched.join(waiting, "id", "left_anti").join(done.rows(), "id", "left_anti").withColumn("level", F.lit(level)))
        done.add(frontier)
    return done.rows().unionByName(ids.join(done.rows(), "id", "left_anti").withColumn("level", F.lit(-1)))


def children_of(parents: DataFrame, parent_id: str, rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """One row per parent with the ordered values of ``column`` of its rows (empty where there are none).

    A parent's values are one array, so they must fit a row; ``ordered_children`` has no such bound.
    """
    grouped = rows.groupBy(F.col(key).alias(parent_id)).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("_v")))), lambda x: x["_v"]).alias("items"))
    return parents.join(grouped, parent_id, "left").withColumn("items", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)))


def ordered_children(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` (from 0) among those of one parent."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
