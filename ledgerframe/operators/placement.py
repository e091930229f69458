"""Where a document lies: reference to path, and path back to reference.

Each placement gives ``path(ref)`` and, where it can be scanned, ``ref(path)`` (null for
paths that are not its own).  A placement that cannot be scanned says so instead of
hiding a full scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions import refcodec

Codec = tuple[Callable[[Column], Column], Callable[[Column], Column] | None]
CODECS: dict[str, Codec] = {
    "identity": (refcodec.identity, refcodec.identity),
    "stem": (refcodec.identity, refcodec.identity),
    "colon_to_double_underscore": (refcodec.colon_to_double_underscore, refcodec.double_underscore_to_colon),
    "base64url": (refcodec.base64url, refcodec.from_base64url),
    "slug": (refcodec.slug, None),
    "safe_slug": (refcodec.safe_slug, None),
}


class NotScannable(ValueError):
    """The placement cannot tell its documents from a listing."""


@dataclass(frozen=True)
class Placement:
    namespace: str
    codec: str = "identity"
    extension: str = ".yaml"

    def _encode(self, ref: Column) -> Column:
        return refcodec.required(CODECS[self.codec][0](ref), "an encoded reference")

    def _decode(self, text: Column) -> Column:
        back = CODECS[self.codec][1]
        if back is None:
            raise NotScannable(f"{self.codec} has no inverse")
        return back(text)

    def path(self, ref: Column) -> Column:
        raise NotImplementedError

    def ref(self, path: Column) -> Column:
        raise NotScannable(type(self).__name__)

    def _relative(self, path: Column) -> Column:
        inside = path.startswith(self.namespace + "/")
        return F.when(inside, F.substring(path, len(self.namespace) + 2, 1 << 30))


class Flat(Placement):
    """``<namespace>/<encoded>.yaml``."""

    def path(self, ref: Column) -> Column:
        return F.concat(F.lit(self.namespace + "/"), self._encode(ref), F.lit(self.extension))

    def ref(self, path: Column) -> Column:
        rest = self._relative(path)
        return F.when(rest.endswith(self.extension), self._decode(F.regexp_replace(rest, r"\.[^./]*$", "")))


@dataclass(frozen=True)
class HashScattered(Placement):
    """``<namespace>/<digest prefix>/<encoded>.yaml``; with ``by_digest`` the name is the digest, and there is no way back."""

    width: int = 2
    depth: int = 1
    by_digest: bool = False

    def path(self, ref: Column) -> Column:
        encoded = self._encode(ref)
        name = F.sha2(encoded.cast("binary"), 256) if self.by_digest else encoded
        return F.concat(F.lit(self.namespace + "/"), refcodec.fanout(encoded, self.width, self.depth), F.lit("/"), name, F.lit(self.extension))

    def ref(self, path: Column) -> Column:
        if self.by_digest:
            raise NotScannable("a digest has no inverse")
        parts = F.split(self._relative(path), "/")
        name = F.element_at(parts, -1)
        stem = F.regexp_replace(name, r"\.[^.]*$", "")
        mine = (F.size(parts) == self.depth + 1) & name.endswith(self.extension) & (F.concat_ws("/", F.slice(parts, 1, self.depth)) == refcodec.fanout(stem, self.width, self.depth))
        return F.when(mine, self._decode(stem))


@dataclass(frozen=True)
class SubdirFixedFile(Placement):
    """``<namespace>/<encoded>/<file>``."""

    file: str = "index.yaml"

    def path(self, ref: Column) -> Column:
        return F.concat(F.lit(self.namespace + "/"), self._encode(ref), F.lit("/" + self.file))

    def ref(self, path: Column) -> Column:
        parts = F.split(self._relative(path), "/")
        return F.when((F.size(parts) == 2) & (F.element_at(parts, -1) == self.file), self._decode(parts[0]))


class NestedFlat(Placement):
    """``<namespace>/<directory>/<stem>.yaml`` for references ``directory/stem``."""

    def path(self, ref: Column) -> Column:
        parts = F.split(ref, "/")
        made = F.concat(F.lit(self.namespace + "/"), self._encode(parts[0]), F.lit("/"), self._encode(F.get(parts, F.lit(1))), F.lit(self.extension))
        return F.when(F.size(parts) == 2, made).otherwise(F.raise_error(F.concat(F.lit("no two-part reference: "), F.coalesce(ref, F.lit("null")))))

    def ref(self, path: Column) -> Column:
        parts = F.split(self._relative(path), "/")
        name = F.element_at(parts, -1)
        return F.when((F.size(parts) == 2) & name.endswith(self.extension), F.concat(self._decode(parts[0]), F.lit("/"), self._decode(F.regexp_replace(name, r"\.[^.]*$", ""))))


@dataclass(frozen=True)
class FixedFile(Placement):
    """One path, whatever the reference; not scannable."""

    file: str = "index.yaml"

    def path(self, ref: Column) -> Column:
        return F.lit(f"{self.namespace}/{self.file}")


@dataclass(frozen=True)
class Template(Placement):
    """A path from a template with ``{ref}``; not scannable."""

    template: str = "{ref}.yaml"

    def path(self, ref: Column) -> Column:
        before, _, after = self.template.partition("{ref}")
        return F.concat(F.lit(before), self._encode(ref), F.lit(after))


def branch_for(policy: str, owner: Column, primary: str, current: str, fixed: str = "", template: str = "{owner}", suffix: bool = False) -> Column:
    """A branch by policy: owner, primary, current, fixed or template.  With ``suffix`` a part of
    the digest is added where encoding changed the owner, so that two owners cannot meet."""
    if policy == "owner":
        return F.coalesce(owner, F.lit(current), F.lit(primary))
    if policy == "template":
        safe = refcodec.safe_slug(owner)
        name = F.when(safe == owner, safe).otherwise(F.concat(safe, F.lit("-"), F.substring(F.sha2(owner.cast("binary"), 256), 1, 8))) if suffix else safe
        before, _, after = template.partition("{owner}")
        return F.concat(F.lit(before), name, F.lit(after))
    return F.lit({"primary": primary, "current": current, "fixed": fixed}[policy])


@dataclass(frozen=True)
class Singleton(Placement):
    """The one document of a family, by its path alone; any listing that has the path has it."""

    file: str = "index.yaml"

    def path(self, ref: Column) -> Column:
        return F.lit(f"{self.namespace}/{self.file}")

    def ref(self, path: Column) -> Column:
        return F.when(path == f"{self.namespace}/{self.file}", F.lit(self.namespace))
