"""Durations and frame hashes of videos, by external tools.

Both run per batch in the workers, next to the files.  Where a tool is missing
or fails, the value is null; nothing else changes.  Tools are called by name or
path: `probe` like ffprobe, `grab` like ffmpeg.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from winnow.functions.scalars import frame_count, sample_times
from winnow.schemas import FRAMES

SIDE = 32  # places of a shrunken frame
LOW = 8  # lowest frequencies that are kept, in each direction
PROBE_SECONDS, GRAB_SECONDS = 15, 20
LEAST_SECONDS = 1.0  # shorter videos get no fingerprint


def _output(command: list[str], seconds: float) -> bytes | None:
    try:
        done = subprocess.run(command, stdin=subprocess.DEVNULL, capture_output=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def probe_duration(path: str, probe: str = "ffprobe") -> float | None:
    """Seconds by the container, else by the first video stream, else null."""
    for entry in (["-show_entries", "format=duration"], ["-select_streams", "v:0", "-show_entries", "stream=duration"]):
        said = _output([probe, "-v", "error", *entry, "-of", "default=noprint_wrappers=1:nokey=1", path], PROBE_SECONDS)
        try:
            return float(said)
        except (TypeError, ValueError):
            continue
    return None


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits of a SIDE x SIDE gray picture: which of its lowest cosine
    frequencies lie above their median, row by row from the highest bit."""
    k = np.arange(SIDE)
    basis = np.cos(np.pi * np.outer(np.arange(LOW), 2 * k + 1) / (2 * SIDE))
    low = basis @ gray.astype(np.float64) @ basis.T
    bits = (low > np.median(low)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), signed=True)


def grab_frame(path: str, at: float, grab: str = "ffmpeg") -> int | None:
    size = SIDE * SIDE
    raw = _output([grab, "-v", "error", "-ss", f"{at:.2f}", "-i", path, "-frames:v", "1", "-vf", f"scale={SIDE}:{SIDE}", "-pix_fmt", "gray", "-f", "rawvideo", "-"], GRAB_SECONDS)
    return perceptual_hash(np.frombuffer(raw[:size], np.uint8).reshape(SIDE, SIDE)) if raw and len(raw) >= size else None


def with_duration(files: DataFrame, probe: str = "ffprobe") -> DataFrame:
    """Sets duration on the rows that are videos; null on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shutil.which(probe)
        for b in batches:
            rows = zip(b.column("path").to_pylist(), b.column("is_video").to_pylist(), strict=True)
            got = [probe_duration(p, probe) if there and v else None for p, v in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*kept, "duration"])

    base = files.drop("duration")
    kept = base.columns
    return base.mapInArrow(run, base.select("*").schema.add("duration", "double"))


def with_frames(videos: DataFrame, base_frames: int = 8, grab: str = "ffmpeg") -> DataFrame:
    """Adds frames, array<struct<ts, h>>, from path and duration; null for
    videos of a second or less and ones of which no frame can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shutil.which(grab)
        for b in batches:
            out = []
            for path, times in zip(b.column("path").to_pylist(), b.column("times").to_pylist(), strict=True):
                found = [(t, h) for t in times or [] if there and (h := grab_frame(path, t, grab)) is not None]
                out.append([{"ts": t, "h": h} for t, h in found] or None)
            kind = pa.list_(pa.struct([("ts", pa.float64()), ("h", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=names)

    d = F.col("duration")
    times = F.when(d > LEAST_SECONDS, sample_times(d, frame_count(d, base_frames)))
    timed = videos.withColumn("times", times)
    names = [*timed.columns, "frames"]
    schema = timed.select("*").schema.add("frames", DataType.fromDDL(FRAMES))
    return timed.mapInArrow(run, schema).drop("times")
