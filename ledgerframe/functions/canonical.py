"""Canonical JSON and digests.

The Column form is exact for strings, integers, booleans, nulls and arrays and structs
of those; doubles print differently in every engine and are refused.  The Python twin
serves driver-side payloads (schema catalogs, contract bodies).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def normalize_payload(value):
    """Mappings with string keys, sequences and scalars; sets become lists in canonical order."""
    if isinstance(value, Mapping):
        if any(not isinstance(k, str) for k in value):
            raise TypeError("keys must be strings")
        return {k: normalize_payload(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((normalize_payload(v) for v in value), key=canonical_json_text)
    if isinstance(value, (list, tuple)):
        return [normalize_payload(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("NaN and infinity have no JSON form")
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"no canonical form for {type(value).__name__}")


def canonical_json_text(value) -> str:
    return json.dumps(normalize_payload(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_json_sha256(value) -> str:
    return "sha256:" + hashlib.sha256(canonical_json_text(value).encode()).hexdigest()


def _sorted(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError("doubles have no engine-independent text; digest them with canonical_json_sha256")
    if isinstance(kind, T.StructType):
        parts = [_sorted(column.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _sorted(x, kind.elementType))
    return column


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Compact JSON of the columns, keys sorted, nulls kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [_sorted(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def version_id(df: DataFrame, columns: list[str]) -> Column:
    """Digest of a row's versioned columns."""
    return digest(canonical_json(df, columns))


def blob_oid(data: Column) -> Column:
    """The id that git gives a blob: sha1 over a header with the byte length, and the bytes."""
    data = data.cast("binary")
    header = F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), data))
