"""Batch documents: one envelope row holds many items and the fields they inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def expand(envelopes: DataFrame, items: str, inherited: list[str]) -> DataFrame:
    """One row per item (maps), numbered from 1.  A key present in the item wins, even with a
    null value; only an absent one is inherited from the envelope."""
    rows = envelopes.select("*", F.posexplode(items).alias("_at", "_item")).drop(items)
    for field in inherited:
        own = F.map_contains_key("_item", F.lit(field))
        rows = rows.withColumn("_item", F.when(own | F.col(field).isNull(), F.col("_item")).otherwise(F.map_concat("_item", F.create_map(F.lit(field), F.col(field)))))
    return rows.select(*[c for c in rows.columns if c not in ("_at", "_item", *inherited)], (F.col("_at") + 1).alias("item_index"), F.col("_item").alias("item"))


def unknown_fields(envelopes: DataFrame, payload: str, allowed: list[str]) -> DataFrame:
    """Rows whose JSON payload has other top-level fields than those allowed, with these fields sorted."""
    keys = F.json_object_keys(payload)
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    return envelopes.withColumn("unknown", extra).where(F.size("unknown") > 0)


def shared(items: DataFrame, batch: list[str], field: str) -> DataFrame:
    """(batch, field): the value that all of a batch's items with one share; null where they differ or have none."""
    same = F.min(field).eqNullSafe(F.max(field)) & (F.count(field) == F.count(F.lit(1)))
    return items.groupBy(*batch).agg(F.when(same, F.min(field)).alias(field))


def lifted(items: DataFrame, batch: list[str], field: str) -> DataFrame:
    """As ``shared``, but items without a value do not count."""
    return items.groupBy(*batch).agg(F.when(F.min(field) == F.max(field), F.min(field)).alias(field))


def collapse(items: DataFrame, batch: list[str], order: str, inherited: list[str], fields: list[str]) -> DataFrame:
    """One envelope per batch: shared fields lifted, items in order without what is equal to the lifted value."""
    heads = items.groupBy(*batch).agg(*[F.when(F.min(f) == F.max(f), F.min(f)).alias(f) for f in inherited])
    rows = items.alias("i").join(heads.alias("h"), batch)
    kept = [F.when(F.col(f"i.{f}").eqNullSafe(F.col(f"h.{f}")), None).otherwise(F.col(f"i.{f}")).alias(f) for f in inherited]
    entry = F.struct(F.col(f"i.{order}").alias(order), *kept, *[F.col(f"i.{f}").alias(f) for f in fields])
    grouped = rows.groupBy(*batch).agg(F.sort_array(F.collect_list(entry)).alias("items"))
    return heads.join(grouped, batch)
