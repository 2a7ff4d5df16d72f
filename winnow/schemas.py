"""Schemas of stored relations; always given, never inferred."""

HASH_CACHE = "path string, size bigint, mtime double, sha256 string, duration double, verified boolean"
FRAMES = "array<struct<ts:double,h:bigint>>"
