"""Audio records as a pipe carries them, from files, and splice sections from packets' payloads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the record format: a header of seven little-endian 64-bit fields, its magic number, and the sample types by size.
HEADER = struct.Struct("<7q")
MAGIC = 0x12345678ABCDEFFE
SAMPLES = {2: "<i2", 4: "<i4"}


def records(blob: bytes, skip: int = 0) -> Iterator[tuple]:
    """(pts_us, sample_rate, bytes per sample, samples per channel and frame) of each whole record.

    A header with another magic number, or an unknown sample size, is passed over by itself. Whole records go until `skip` samples have gone by, and so
    does the one in which they run out.
    """
    at = 0
    while at + HEADER.size <= len(blob):
        magic, channels, n, rate, width, seconds, nanoseconds = HEADER.unpack_from(blob, at)
        at += HEADER.size
        if magic != MAGIC or width not in SAMPLES:
            continue
        size = channels * n * width
        if channels < 0 or n < 0 or at + size > len(blob):
            return
        data = np.frombuffer(blob, SAMPLES[width], channels * n, at).reshape(n, channels)
        at += size
        if skip > n:
            skip -= n
        elif skip > 0:
            skip = 0
        else:
            yield seconds * 1_000_000 + nanoseconds // 1000, rate, width, data.T.astype(float).tolist()


def read_records(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Audio frames of record files, one stream and one task per file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, i, pts, rate, width, len(s[0]) if s else 0, s) for i, (pts, rate, width, s) in enumerate(records(bytes(blob), skip))]
                yield pd.DataFrame(rows, columns=["stream_id", "seq", "pts_us", "sample_rate", "bytes_per_sample", "n_samples", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "stream_id string, seq long, pts_us long, sample_rate long, bytes_per_sample long, n_samples long, samples array<array<double>>")


def splice_section(payload: Column) -> Column:
    """The fixed fields of a splice information section; null if the table id is another one or bytes are missing."""
    digits = F.hex(payload)
    bits = lambda byte, n: F.conv(F.substring(digits, 2 * byte + 1, 2 * n), 16, 10).cast("long")
    fields = F.struct(
        bits(1, 2).bitwiseAND(0xFFF).alias("section_length"),
        bits(3, 1).alias("protocol_version"),
        (bits(4, 1) >= 128).alias("encrypted"),
        bits(4, 5).bitwiseAND((1 << 33) - 1).alias("pts_adjustment"),
        bits(9, 1).alias("cw_index"),
        F.shiftright(bits(10, 2), 4).alias("tier"),
        bits(11, 2).bitwiseAND(0xFFF).alias("command_length"),
        bits(13, 1).alias("command_type"),
    )
    return F.when((F.length(payload) >= 14) & digits.startswith("FC"), fields)
