"""Strict reading of document files: YAML and JSON, unknown fields refused."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def yaml_files(spark: SparkSession, directory: str, schema: T.StructType | str) -> DataFrame:
    """(path, document) of the ``*.yaml`` files directly in a folder, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(directory)
    return strict(decode_yaml(files.select("path", "content"), "content"), "json", schema).select("path", "document").orderBy("path")


def decode_yaml(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``json``, the document in a YAML column as JSON text; broken YAML stops the job."""
    schema = T.StructType([*rows.drop(column).schema.fields, T.StructField("json", T.StringType())])

    def run(frames):
        import yaml

        for f in frames:
            f["json"] = [None if x is None else json.dumps(yaml.safe_load(x), default=str, ensure_ascii=False) for x in f[column]]
            yield f.drop(columns=[column])

    return rows.mapInPandas(run, schema)


def encode_yaml(rows: DataFrame, json_column: str) -> DataFrame:
    """``rows`` with ``yaml``: the JSON text as YAML, keys in order."""
    schema = T.StructType([*rows.schema.fields, T.StructField("yaml", T.StringType())])

    def run(frames):
        import yaml

        for f in frames:
            f["yaml"] = [None if x is None else yaml.safe_dump(json.loads(x), sort_keys=False, allow_unicode=True) for x in f[json_column]]
            yield f

    return rows.mapInPandas(run, schema)


def unknown_keys(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows whose JSON object has other keys than the known ones, with them, sorted."""
    extra = F.array_sort(F.array_except(F.json_object_keys(column), F.array(*[F.lit(k) for k in known])))
    return rows.withColumn("unknown", extra).where(F.size("unknown") > 0)


def _unknown(value: Column, kind: T.DataType, prefix: Column) -> Column | None:
    """Array of the paths of unknown fields at any level of a JSON text; None where the type has no records."""
    if isinstance(kind, T.StructType):
        own = F.array_except(F.json_object_keys(value), F.array(*[F.lit(f.name) for f in kind.fields]).cast("array<string>"))
        found = [F.transform(own, lambda k: F.concat(prefix, k))]
        for f in kind.fields:
            deeper = _unknown(F.get_json_object(value, f"$['{f.name}']"), f.dataType, F.concat(prefix, F.lit(f.name + ".")))
            found += [] if deeper is None else [deeper]
        none = F.array().cast("array<string>")
        return F.concat(*[F.coalesce(x, none) for x in found])
    if isinstance(kind, T.ArrayType):
        if _unknown(value, kind.elementType, prefix) is None:
            return None
        return F.flatten(F.transform(F.from_json(value, "array<string>"), lambda x: _unknown(x, kind.elementType, prefix)))
    return None


def strict(rows: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """``rows`` with ``document``; an unknown field at any level, a wrong type or a missing required field stops the job."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    extra = _unknown(F.col(column), kind, F.lit(""))
    document = F.from_json(column, kind, {"mode": "FAILFAST"})
    refused = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))))
    for f in kind.fields:
        if not f.nullable:
            refused = F.coalesce(refused, F.when(F.get_json_object(column, f"$.{f.name}").isNull(), F.raise_error(F.lit(f"missing field: {f.name}"))))
    return rows.withColumn("document", F.when(F.coalesce(refused.cast("string"), F.lit("")) == "", document))


def yaml_batches(spark: SparkSession, directory: str, items: str, item_schema: T.StructType | str, inherited: list[str]) -> DataFrame:
    """(path, item_index, item) of all envelope files; an item's own field wins over the envelope's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(directory)
    rows = decode_yaml(files.select("path", "content"), "content")
    allowed = F.array(*[F.lit(n) for n in [items, *inherited]])
    extra = F.array_except(F.json_object_keys("json"), allowed)
    rows = rows.withColumn("json", F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("json")))
    kind = T.StructType.fromDDL(item_schema) if isinstance(item_schema, str) else item_schema
    parsed = rows.select("path", "json", F.posexplode(F.from_json(F.get_json_object("json", f"$.{items}"), "array<string>")).alias("at", "own"))
    document = F.from_json("own", kind, {"mode": "FAILFAST"})
    fields = []
    for f in kind.fields:
        value = document.getField(f.name)
        if f.name in inherited:
            present = F.array_contains(F.json_object_keys("own"), f.name)
            value = F.when(present, value).otherwise(F.get_json_object("json", f"$.{f.name}").cast(f.dataType))
        fields.append(value.alias(f.name))
    return parsed.select("path", (F.col("at") + 1).alias("item_index"), F.struct(*fields).alias("item")).orderBy("path", "item_index")
