"""Vector caches: nearest rows by Euclidean distance, upsert, stale detection, snapshot and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import canonical_json_sha256


def l2(a: Column, b: Column) -> Column:
    """Distance in double precision, summed in order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0).cast("double"), lambda s, x: s + x))


def checked(vectors: DataFrame, column: str, dimensions: int) -> DataFrame:
    """The rows; another dimension than declared stops the job."""
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    ok = F.when(F.size(column) == dimensions, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(column).cast("string"))))
    return vectors.withColumn(column, ok)


def nearest(vectors: DataFrame, id_column: str, column: str, query: list[float], k: int) -> DataFrame:
    """(id, distance): the k nearest, ties by id; top-k in every task, then of those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_column).alias("id"), l2(F.col(column), q).alias("distance")).orderBy("distance", "id").limit(k)


def nearest_entities(vectors: DataFrame, query: list[float], k: int, status: DataFrame, source: DataFrame, model: str) -> DataFrame:
    """Top k by vector first, then only those whose status is of the model and whose source row
    agrees in seq and id: fewer than k rows can come back."""
    top = nearest(vectors.where(F.col("model") == model), "seq", "vector", query, k)
    live = status.where(F.col("model") == model).select("seq", "id")
    return top.withColumnRenamed("id", "seq").join(live, "seq").join(source.select("seq", "id"), ["seq", "id"]).select("id", "seq", "distance").orderBy("distance", "id")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace those of ``table`` with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows)


def stale(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """Entities (id, content_hash) that have no vector for their present content."""
    return entities.join(existing.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def extract(vectors: DataFrame, status: DataFrame, source: DataFrame) -> DataFrame:
    """Snapshot rows (model, id, content_hash, vector) of vectors with status and source."""
    return vectors.join(status, ["model", "seq"]).join(source.select("seq", "id"), ["seq", "id"]).select("model", "id", "content_hash", "vector")


def restore(snapshot: DataFrame, entities: DataFrame) -> DataFrame:
    """Snapshot rows with outcome: orphaned (no such entity), stale (other content), restored (with its new seq)."""
    now = entities.select("id", F.col("seq").alias("new_seq"), F.col("content_hash").alias("now"))
    outcome = F.when(F.col("now").isNull(), "orphaned").when(F.col("now") != F.col("content_hash"), "stale").otherwise("restored")
    rows = snapshot.join(now, "id", "left")
    return rows.select(*[F.col(c) for c in snapshot.columns], outcome.alias("outcome"), F.when(F.col("now") == F.col("content_hash"), F.col("new_seq")).alias("seq"))


MODELS = "model string, provider string, model_name string, model_version string, content_digest string, dimensions int, created_at string"


def register_model(models: DataFrame, provider: str, model_name: str, model_version: str, content_digest: str, dimensions: int, created_at: str) -> DataFrame:
    """The registry (see ``MODELS``) with this model; its identity is a digest of the four names, and it is
    registered anew where it is there already.  ``created_at`` is the caller's, so runs repeat."""
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    identity = {"content_digest": content_digest, "model_name": model_name, "model_version": model_version, "provider": provider}
    row = (canonical_json_sha256(identity), provider, model_name, model_version, content_digest, dimensions, created_at)
    return upsert(models, models.sparkSession.createDataFrame([row], MODELS), ["model"])


def point_lookup(vectors: DataFrame, status: DataFrame, source: DataFrame, model: str, ids: DataFrame) -> DataFrame:
    """(id, vector) of the entities in ``ids`` (id) that have a live vector of the model."""
    live = status.where(F.col("model") == model).join(ids, "id", "left_semi").join(source.select("seq", "id"), ["seq", "id"]).select("seq", "id")
    return vectors.where(F.col("model") == model).join(live, "seq").select("id", "vector")


def checked_models(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Vectors (model, seq, vector) held against the registry; an unknown model or another dimension stops the job."""
    rows = vectors.join(models.select("model", "dimensions"), "model", "left")
    wrong = F.when(F.col("dimensions").isNull(), F.raise_error(F.concat(F.lit("unknown model "), "model")))
    wrong = wrong.when(F.size("vector") != F.col("dimensions"), F.raise_error(F.concat(F.lit("other dimensions than model "), "model")))
    return rows.select("model", "seq", F.when(wrong.isNull(), F.col("vector")).alias("vector"))
