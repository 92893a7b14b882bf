"""Helpers that the corpus operators share: reading tables, Arrow text slices and written stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at a time; a longer text is one slice of its own.
SLICE_BYTES = 4 << 20


#: Rows and bytes that a task hands to Python at a time, and the size of a row group that it writes: they bound an executor's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
ROW_GROUP = 16 << 20
#: Rows of a narrow table that are worth a task of their own.
TASK_ROWS = 20_000


def frugal(spark: SparkSession) -> SparkSession:
    """Makes Arrow batches small for this session, in rows and in bytes, unless they are smaller still."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int("".join(c for c in spark.conf.get(name) if c in "-0123456789")) <= most:
            spark.conf.set(name, most)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, where it may be unset, one under the warehouse serves."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def sized(df: DataFrame, what: str, most: int | None = None) -> tuple[DataFrame, int]:
    """written(), and the number of rows. Where at most so many rows are known to come, no more tasks write than they are worth."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if most is not None:
        df = df.coalesce(max(1, -(-most // TASK_ROWS)))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def written(df: DataFrame, what: str, most: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and returns it read again: later plans start from files that survive a lost executor."""
    return sized(df, what, most)[0]


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables that written() returned and that no later plan reads.

    Spark deletes the shuffle files of finished plans once the driver's memory is collected, which a driver with little to do puts off; so it is asked to.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
            p.getFileSystem(hadoop).delete(p, True)
    spark.sparkContext._jvm.System.gc()


def row_key(*cols: str | Column) -> Column:
    """A 64-bit key of a row's contents: equal rows share it, and nulls have one too."""
    return F.xxhash64(*cols)


#: Bits of the filters that tell tasks which rows are needed: of fixed size, whatever the number of keys. A false hit costs work only.
FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each residue of the keys, gathered as bitmaps of 4 KB."""
    # Spark numbers the bits of a bitmap from 1
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    rows = keys.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r["at"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def in_filter(spark: SparkSession, bits: np.ndarray, column: str) -> Column:
    """Whether a filter knows a column's keys, or seems to. Only the keys go to Python."""
    sent = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def known(keys: pa.Array) -> pa.Array:
        key = np.mod(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), FILTER_BITS)
        return pa.array((sent.value[key >> 3] >> (key & 7).astype(np.uint8) & 1).astype(bool))

    return known(F.col(column))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) for runs of rows of about `most` bytes; null counts as empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
    if len(texts) == 0:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of several texts as one uint32 array of code points, and the offsets in it."""
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, starts[offsets]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(32)
    return x


def model_bytes(path: str) -> bytes:
    """A tokenizer's file, read on the driver: its size is that of a vocabulary and doesn't depend on the data."""
    return Path(path).read_bytes()
