"""Content-addressed identities, canonical JSON, times and MIME types, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME types that count as HTML; everything else is a file.
HTML_TYPES = ("text/html", "application/xhtml+xml")
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"


def canonical_json(*pairs: tuple[str, Column]) -> Column:
    """Compact JSON of the named values, keys in code-point order, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(pairs)]), {"ignoreNullFields": "false"})


def digest(content: Column) -> Column:
    """'sha256:' and the hex digest of a text's UTF-8 bytes or of a binary."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def artifact_id(blob_sha256: Column, mime: Column, role: Column) -> Column:
    return F.concat(F.lit("artifact-"), F.sha2(canonical_json(("blob_sha256", blob_sha256), ("mime_type", mime), ("role", role)), 256))


def lineage_id(artifact: Column, observation: Column, source_artifact: Column, source_observation: Column) -> Column:
    body = canonical_json(("artifact_id", artifact), ("observation_id", observation), ("relation", F.lit("derived_from")), ("source_artifact_id", source_artifact), ("source_observation_id", source_observation))
    return F.concat(F.lit("lineage-"), F.sha2(body, 256))


def observation_id(*parts: Column) -> Column:
    """An id derived from its parts; a stable stand-in for a random one, so that reruns agree."""
    return F.concat(F.lit("observation-"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32))


def blob_path(sha256: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(".blob"))


# Names that no path segment may have before its first dot.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10)))


def portable_path(path: Column) -> Column:
    """Whether a relative path is portable: plain segments of letters, digits, dots, lines and hyphens, none dotted at its end or reserved."""
    plain = lambda p: p.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~p.endswith(".") & (F.length(p) <= 255) & ~F.upper(F.substring_index(p, ".", 1)).isin(*RESERVED)
    return F.coalesce((F.length(path) <= 1024) & F.forall(F.split(path, "/"), plain), F.lit(False))


def mime_valid(mime: Column) -> Column:
    """Whether a stored MIME type is lower-case type/subtype without parameters."""
    part = r"[a-z0-9][a-z0-9!#$%&'*+.^_`|~-]*"
    return F.coalesce(mime.rlike(rf"^{part}/{part}$"), F.lit(False))


def media_type(header: Column) -> Column:
    """struct<mime, code> of a Content-Type header: lower-case type/subtype, or the code that says why there is none."""
    head = F.lower(F.trim(F.split(header, ";").getItem(0)))
    code = F.when(F.coalesce(header, F.lit("")) == "", "gateway.mime_missing").when(header.rlike(r"[,\x00-\x1f\x7f]") | ~head.rlike(rf"^{_TOKEN}/{_TOKEN}$"), "gateway.mime_invalid")
    return F.struct(F.when(code.isNull(), head).alias("mime"), code.alias("code"))


def content_kind(mime: Column) -> Column:
    return F.when(mime.isNull(), None).when(mime.isin(*HTML_TYPES), "html").otherwise("file")


def utc_valid(text: Column) -> Column:
    """Whether a text is a whole UTC second that reads back to itself."""
    back = F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & (back == text), F.lit(False))


def version_key(version: Column) -> Column:
    """A dotted version as an array of longs, which sorts as versions do."""
    return F.transform(F.split(version, r"\."), lambda p: p.try_cast("bigint"))
