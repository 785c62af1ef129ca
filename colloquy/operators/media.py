"""Availability of media files by their paths, digests and WAV headers."""

from __future__ import annotations

import io
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.audit import violations
from colloquy.sources.files import listing, opened, sha256

EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wav")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below path. Only the listing is read; a large file is a partition of its own."""
    return listing(spark, path)


def with_stem(paths: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return paths.withColumns({"stem": F.regexp_extract(name, r"^(.*)\.[^.]+$", 1), "extension": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})


def located(rows: DataFrame, paths: DataFrame, key: str, preferred: str = "utterances_final") -> DataFrame:
    """rows with the path of their file (stem = key) or a failure. Of several files, the only one under the preferred folder counts."""
    known = with_stem(paths).filter(F.col("extension").isin(*EXTENSIONS))
    per = known.groupBy(F.col("stem").alias(key)).agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__any"), F.count_if(F.col("path").contains(preferred)).alias("__k"), F.min(F.when(F.col("path").contains(preferred), F.col("path"))).alias("__p"))
    out = rows.join(per, key, "left")
    path = F.when(F.col("__n") == 1, F.col("__any")).when(F.col("__k") == 1, F.col("__p"))
    failure = F.when(F.col("__n").isNull(), "VIDEO_NOT_FOUND").when(path.isNull(), "MULTIPLE_VIDEO_CANDIDATES")
    return out.withColumns({"path": path, "failure": failure}).drop("__n", "__any", "__k", "__p")


def manifest(found: DataFrame) -> DataFrame:
    """path, length, sha256 of files, digested in pieces, so a file of any size takes the same memory. A file that is gone raises an error."""

    def run(batches):
        for batch in batches:
            digests = pa.array([sha256(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), digests], ["path", "length", "sha256"])

    return found.select("path", "length").mapInArrow(run, "path string, length long, sha256 string")


def coverage(rows: DataFrame, availability: DataFrame, key: str, level: str) -> DataFrame:
    """level, total, video_found, video_coverage, audio_extractable, audio_coverage. availability: key, video_found, audio_extractable."""
    met = rows.select(key, level).join(availability.select(key, "video_found", "audio_extractable"), key, "left")
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    out = met.groupBy(level).agg(F.count(F.lit(1)).alias("total"), n("video_found").alias("video_found"), n("audio_extractable").alias("audio_extractable"))
    return out.withColumns({"video_coverage": F.col("video_found") / F.col("total"), "audio_coverage": F.col("audio_extractable") / F.col("total")})


def gate(availability: DataFrame, least: int = 150) -> DataFrame:
    """valid, status: whether enough rows have audio."""
    valid = F.count_if(F.coalesce(F.col("audio_extractable"), F.lit(False)))
    return availability.agg(valid.alias("valid")).withColumn("status", F.when(F.col("valid") >= least, "PASS").otherwise(f"AUDIO_BELOW_{least}_STOP"))


def with_media(review: DataFrame, availability: DataFrame, key: str) -> DataFrame:
    """Review rows whose media are usable, with the path and the digest of their audio."""
    usable = availability.filter("video_found and audio_extractable and failure is null").select(key, F.col("path").alias("target_audio_path"), F.col("sha256").alias("target_audio_sha256"))
    return review.join(usable, key)


def media_violations(availability: DataFrame, preferred: str = "utterances_final") -> DataFrame:
    """rule, violations among rows that are said to be usable."""
    valid = availability.filter("video_found and audio_extractable and failure is null")
    return violations(valid, duration=F.col("duration") > 0, channels=F.col("channels") >= 1, sample_rate=F.col("sample_rate") > 0, length=F.col("length") > 0, digest=F.col("sha256").rlike("^[0-9a-f]{64}$"), preferred_folder=F.col("path").contains(preferred))


def wav_header(content: bytes) -> dict:
    """channels, rate, bits and frames of a RIFF/WAVE file, or a failure."""
    return wav_head(io.BytesIO(content), len(content))


def wav_head(f, length: int) -> dict:
    """What wav_header gives, of an open file: the heads of its chunks are read, the rest is passed over."""
    out = {"channels": None, "rate": None, "bits": None, "frames": None, "failure": None}
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return out | {"failure": "NOT_WAV"}
    at, block = 12, 0
    while at + 8 <= length:
        f.seek(at)
        chunk = f.read(24)
        name, size = chunk[:4], struct.unpack_from("<I", chunk, 4)[0]
        if name == b"fmt " and len(chunk) == 24:
            _, out["channels"], out["rate"], _, block, out["bits"] = struct.unpack_from("<HHIIHH", chunk, 8)
        if name == b"data":
            if not block:
                return out | {"failure": "NO_FORMAT"}
            held = min(size, length - at - 8)
            return out | {"frames": held // block, "failure": "TRUNCATED" if held < size else None}
        at += 8 + size + size % 2
    return out | {"failure": "NO_DATA"}


def wav_audit(found: DataFrame, rate: int = 16_000) -> DataFrame:
    """path, length, channels, rate, bits, frames, failure, valid (mono, 16 bit, the rate, some frames)."""
    schema = pa.schema([("channels", pa.int32()), ("rate", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("failure", pa.string())])

    def head(path: str, length: int) -> dict:
        with opened(path) as f:
            return wav_head(f, length)

    def run(batches):
        for batch in batches:
            heads = pa.RecordBatch.from_pylist([head(p, n) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)], schema)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), *heads.columns], ["path", "length", *schema.names])

    out = found.select("path", "length").mapInArrow(run, "path string, length long, channels int, rate int, bits int, frames long, failure string")
    return out.withColumn("valid", F.coalesce(F.col("failure").isNull() & (F.col("channels") == 1) & (F.col("bits") == 16) & (F.col("rate") == rate) & (F.col("frames") > 0), F.lit(False)))
