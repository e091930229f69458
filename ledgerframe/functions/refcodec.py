"""Codecs between logical references and path segments, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def identity(x: Column) -> Column:
    return x


def colon_to_double_underscore(x: Column) -> Column:
    return F.replace(x, F.lit(":"), F.lit("__"))


def double_underscore_to_colon(x: Column) -> Column:
    """The inverse for references without ``__``; a literal ``__`` comes back as a colon."""
    return F.replace(x, F.lit("__"), F.lit(":"))


def base64url(x: Column) -> Column:
    """URL-safe, without padding; Spark's line breaks are taken out."""
    plain = F.regexp_replace(F.base64(x.cast("binary")), "[\r\n]", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def from_base64url(x: Column) -> Column:
    padded = F.rpad(F.translate(x, "-_", "+/"), (F.length(x) + F.pmod(-F.length(x), F.lit(4))).cast("int"), F.lit("="))
    return F.unbase64(padded).cast("string")


def slug(x: Column) -> Column:
    """Lower-cased ASCII slug; an empty one is null (see ``required``)."""
    made = F.regexp_replace(F.lower(F.trim(x)), "[^A-Za-z0-9_-]+", "_")
    made = F.regexp_replace(made, "^[_-]+|[_-]+$", "")
    return F.when(made != "", made)


def safe_slug(x: Column) -> Column:
    """Letters and digits of any script, ``_``, ``-`` and ``.`` stay, but for the three at the ends; each
    other character becomes ``_`` (white space at the ends goes, as ``_`` does there)."""
    made = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_.\-]", "_"), r"^[._\-]+|[._\-]+$", "")
    return F.when(made != "", made)


def required(x: Column, what: str) -> Column:
    """The value; a null or empty one stops the job."""
    return F.when(x.isNotNull() & (x != ""), x).otherwise(F.raise_error(F.lit(f"{what} is empty")))


def fanout(encoded: Column, width: int = 2, depth: int = 1) -> Column:
    """Directory prefix from the digest of an encoded reference."""
    hexed = F.sha2(encoded.cast("binary"), 256)
    return F.concat_ws("/", *[F.substring(hexed, 1 + k * width, width) for k in range(depth)])


_REF = re.compile(r"refs/(?!.*(?:\.\.|//|@\{|\.lock(?:/|$)|/\.|\.$|/$))[^\x00-\x20\x7f~^:?*\[\\]+")


def valid_ref_name(x: Column) -> Column:
    """Whether a full ref name is well formed."""
    return F.coalesce(x.rlike("^" + _REF.pattern + "$"), F.lit(False))


def valid_version(x: Column) -> Column:
    """Calendar versions ``YYYY.MM.DD`` or ``YYYY.MM.DD.N`` whose date exists."""
    day = F.regexp_extract(x, r"^(\d{4}\.\d{2}\.\d{2})(\.[1-9]\d*)?$", 1)
    return F.coalesce((day != "") & F.try_to_timestamp(day, F.lit("yyyy.MM.dd")).isNotNull(), F.lit(False))


def normalize_path(x: Column) -> Column:
    """Forward slashes, none at the ends; ``.`` is the root."""
    made = F.trim(F.replace(x, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(made == ".", F.lit("")).otherwise(made)
