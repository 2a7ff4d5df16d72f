"""Scalar functions as column expressions (and parse_size for options)."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Video file name endings.
VIDEO_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "mpg", "mpeg", "3gp", "ts", "ogv"]

#: Names of system folders and files that a scan can skip.
SYSTEM_IGNORE = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", "System Volume Information", "$RECYCLE.BIN",
    ".Trash*", ".Trashes", ".fseventsd", ".Spotlight-V100", ".DocumentRevisions-V100",
]

UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def format_size(n: Column) -> Column:
    """'0 B' up to zero, else two decimals in the largest fitting unit, rounded half to even."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(UNITS))):
        shown = F.concat(F.format_string("%.2f", F.bround(n.cast("double") / float(1024**k), 2)), F.lit(f" {unit}"))
        out = shown if k == len(UNITS) - 1 else F.when(n < 1024 ** (k + 1), shown).otherwise(out)
    return F.when(n <= 0, "0 B").otherwise(out)


def format_duration(s: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; N/A for null or negative."""
    t = s.cast("bigint")
    h, m, sec = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    short = F.format_string("%02d:%02d", m, sec)
    return F.when(s.isNull() | (s < 0), "N/A").when(h > 0, F.format_string("%02d:%02d:%02d", h, m, sec)).otherwise(short)


def hex_bits(h: Column) -> Column:
    """A hash of up to 16 hex digits as 64 bits; null if it is not one."""
    return F.when(h.rlike(r"\A[0-9a-fA-F]{1,16}\z"), F.conv(h, 16, -10).cast("bigint"))


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; 64 if either is no hash."""
    return F.coalesce(hamming_bits(hex_bits(a), hex_bits(b)), F.lit(64))


def parse_size(text: str) -> int:
    """Bytes of '10MB', '1.5 gb', '10B' or '10'; ValueError otherwise."""
    found = re.fullmatch(r"([0-9.]+)(TB|GB|MB|KB|B)", re.sub(r"\s", "", text.upper()))
    return int(float(found[1]) * 1024 ** UNITS.index(found[2])) if found else int(text)


def parse_size_column(c: Column) -> Column:
    """parse_size over a column; null where it would raise."""
    t = F.regexp_replace(F.upper(c), r"\s", "")
    unit, number = F.regexp_extract(t, r"\A[0-9.]+(TB|GB|MB|KB|B)?\z", 1), F.regexp_extract(t, r"\A([0-9]+(\.[0-9]*)?|\.[0-9]+)(?:TB|GB|MB|KB|B)\z", 1)
    factor = F.lit(None).cast("double")
    for k, name in enumerate(UNITS[:-1]):
        factor = F.when(unit == name, float(1024**k)).otherwise(factor)
    whole = F.when(t.rlike(r"\A[0-9]+\z"), t.cast("bigint"))
    return F.coalesce(whole, F.when(number != "", F.floor(F.expr("1.0D") * number.try_cast("double") * factor)).cast("bigint"))


def suffix(path: Column) -> Column:
    """The lower-cased last ending of a path's name, with its dot, else ''."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"\A.+(\.[^.]+)\z", 1))


def is_video(path: Column) -> Column:
    return suffix(path).isin([f".{x}" for x in VIDEO_EXTENSIONS])


def glob_regex(pattern: str) -> str:
    """A glob as an anchored Java pattern; * also crosses '/'."""
    return r"\A" + fnmatch.translate(pattern).removesuffix(r"\z").removesuffix(r"\Z") + r"\z"


def partial_sha(content: Column, chunk: int) -> Column:
    """SHA-256 of head and tail where there is more than both, else of all."""
    b = content.cast("binary")
    ends = F.concat(F.substring(b, 1, chunk), F.substring(b, -chunk, chunk))
    return F.sha2(F.when(F.octet_length(b) > 2 * chunk, ends).otherwise(b), 256)


def frame_count(duration: Column, base: int = 8) -> Column:
    most = F.greatest(F.lit(base).cast("bigint"), F.least(F.floor(duration / 15) + 1, F.lit(30).cast("bigint")))
    return F.when(duration <= 0, F.lit(base).cast("bigint")).otherwise(most)


def sample_times(duration: Column, n: Column, share: float = 0.03, most: float = 2.0) -> Column:
    """Times at which frames are taken: margins are cut off both ends."""
    margin = F.least(duration * share, F.lit(most))
    span = F.greatest(duration - margin * 2, F.lit(0.1))
    steps = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))), lambda i: margin + span * i / (n - 1))
    return F.when(n <= 1, F.array(duration / 2)).otherwise(steps)


def similarity(avg_distance: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(1.0) - avg_distance / 64.0) * 100.0)
