"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On each level equal neighbours first join into one symbol (with their number); deterministic coin tossing
then labels each symbol by the lowest bit in which it differs from its left neighbour, again and again until six labels are left;
symbols whose label is a local maximum begin a phrase; and a phrase is named by a hash of its symbols. A name depends on the symbols
near it only, so equal substrings get equal names in their interior wherever they stand.

The fingerprint keeps the `keep` smallest hashes of the names from level `from_level` upwards (of all levels for texts shorter than
`short` code points), as 8 hex digits each. Two fingerprints' likeness is the Dice coefficient of the name sets, estimated from the
smallest hashes of their union; it is exact as long as both sets are kept whole.

Null counts as the empty text, whose fingerprint is empty; two empty fingerprints have likeness 1, one empty one has 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm.common import frugal, mixed

KEEP = 64
FROM_LEVEL = 2
SHORT = 96
#: Shorter texts also keep their single code points.
TINY = 24
#: Ranges of ids that the table is cut into at most, as the driver holds one id of each; a range streams through its task, whatever its size.
MOST_BUCKETS = 20_000
#: Code points that are parsed at a time.
AT_ONCE = 1 << 20
#: Powers of an odd number, for hashes of phrases; a phrase has at most some twenty symbols.
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))
_LOWEST = np.zeros(64, dtype=np.uint8)
for _i in range(64):
    _LOWEST[((1 << _i) * 0x03F79D71B4CB0A89 & (1 << 64) - 1) >> 58] = _i


def _toss_table(n: int) -> np.ndarray:
    """Label of (symbol, left symbol) for symbols below n: twice the lowest differing bit, plus that bit of the symbol."""
    out = np.zeros((n, n), dtype=np.uint8)
    for a in range(n):
        for b in range(n):
            if a != b:
                k = ((a ^ b) & -(a ^ b)).bit_length() - 1
                out[a, b] = 2 * k + (a >> k & 1)
    return out.ravel()


_TOSS128, _TOSS14, _TOSS8 = _toss_table(128), _toss_table(14), _toss_table(8)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six, different for neighbours of a text. first: where texts begin; x has no equal neighbours within a text."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    diff = x ^ before
    bit = _LOWEST[(diff & (~diff + np.uint64(1))) * np.uint64(0x03F79D71B4CB0A89) >> np.uint64(58)]
    label = (bit << np.uint8(1)) | ((x >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for table, width in ((_TOSS128, 128), (_TOSS14, 14), (_TOSS8, 8)):
        left = np.empty(len(label), dtype=np.uint16)
        left[1:] = label[:-1]
        left[first] = np.where(label[first] == 0, 1, 0)
        label = table[label.astype(np.uint16) * np.uint16(width) + left]
    return label


def _level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: names of phrases, and where each text begins among them. Texts of one symbol stay as they are."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    if not new.all():
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(x)))
        first = np.searchsorted(at, first)
        x = x[at]
        long = run > 1
        x[long] = mixed(x[long] ^ mixed(run[long].astype(np.uint64)))
    label = _labels(x, first)
    start = np.zeros(len(x), dtype=bool)
    if len(x) > 2:
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # a phrase has two symbols at least: none begins at a text's second or last symbol
    last = np.append(first[1:], len(x)) - 1
    start[last] = False
    start[np.minimum(first + 1, len(x) - 1)] = False
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(x)))
    place = np.arange(len(x)) - np.repeat(at, size)
    name = np.add.reduceat(mixed(x) * _POWERS[place & 63], at) + _POWERS[size & 63]
    lone = size == 1
    name = mixed(name)
    name[lone] = x[at[lone]]
    return name, np.searchsorted(at, first)


def _names(texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, text of each name) for texts as arrays of code points, none of them empty."""
    sizes = np.array([len(t) for t in texts])
    owner_of = np.arange(len(texts))
    x = mixed(np.concatenate(texts).astype(np.uint64) + np.uint64(1))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    level = 0
    while len(x):
        level += 1
        x, first = _level(x, first)
        n = np.diff(np.append(first, len(x)))
        yield level, x, np.repeat(owner_of, n)
        more = n > 1
        if not more.all():
            x, owner_of, n = x[np.repeat(more, n)], owner_of[more], n[more]
            first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n


def sketches(texts: list[np.ndarray], keep: int = KEEP) -> list[np.ndarray]:
    """For each text of code points the smallest hashes of its names, sorted."""
    full = [i for i, t in enumerate(texts) if len(t)]
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not full:
        return out
    sizes = np.array([len(texts[i]) for i in full])
    tiny = [k for k in range(len(full)) if sizes[k] < TINY]
    keys = [np.uint64(k << 32) | mixed(texts[full[k]].astype(np.uint64)) >> np.uint64(32) for k in tiny]
    for level, names, owner in _names([texts[i] for i in full]):
        ok = np.ones(len(names), dtype=bool)
        if level < FROM_LEVEL:
            # what repeats at once is named with its number further up, so that its own name is kept here
            ok = (sizes < SHORT)[owner] | (np.bincount(owner, minlength=len(full)) == 1)[owner]
            ok[1:] |= (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
        keys.append(owner[ok].astype(np.uint64) << np.uint64(32) | names[ok] >> np.uint64(32))
    key = np.unique(np.concatenate(keys))
    owner = (key >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(owner, np.arange(len(full) + 1))
    low = key.astype(np.uint32)
    for k, i in enumerate(full):
        out[i] = low[at[k] : min(at[k] + keep, at[k + 1])]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Dice coefficient of the sets behind two sketches, from the smallest hashes of their union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # a full sketch says nothing about hashes beyond its last one
    edge = min(a[-1] if len(a) == keep else 0xFFFFFFFF, b[-1] if len(b) == keep else 0xFFFFFFFF)
    a, b = a[: np.searchsorted(a, edge, side="right")], b[: np.searchsorted(b, edge, side="right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 2 * both / max(1, len(a) + len(b))


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def fingerprint(docs: DataFrame, text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """docs with a column fingerprint (one of that name is replaced). No shuffle."""
    frugal(docs.sparkSession)
    kept = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            prints = [text_of(s) for part in _parts(texts) for s in sketches([_points(t) for t in part], keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, "fingerprint"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, fingerprint string")


def _parts(texts: list[str], most: int = AT_ONCE) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 512) -> DataFrame:
    """Rows (bucket, id, text, extra) such that within a bucket, ordered by id and text with extra rows last, each row but the extra one
    is followed by the next row of the whole table (the last by the first).

    Buckets are ranges of ids of about `rows_each` rows, and MOST_BUCKETS at most. Each text moves once; besides, the first row of a
    bucket is copied to close the bucket before. The driver sees one id per bucket.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = rows.select("id")
    buckets = min(MOST_BUCKETS, -(-ids.count() // rows_each))
    marks = ids.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    sent = spark.sparkContext.broadcast(np.array(sorted({int(m) for m in marks}), dtype=np.int64))

    @F.arrow_udf("int")
    def bucket_of(known: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sent.value, known.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    bucket = bucket_of(F.coalesce("id", F.lit(-(1 << 63)))).alias("bucket")
    rows = rows.select(bucket, "id", "text", F.lit(False).alias("extra"))
    heads = ids.select(bucket, "id").groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("head")).select("bucket", "head.id").collect()
    at = sorted(heads)
    closes = [(r["bucket"], r["id"], at[i - 1]["bucket"]) for i, r in enumerate(at)]
    closing = spark.createDataFrame(closes, "of int, head long, to int")
    order = F.struct(F.col("text").isNotNull().alias("known"), F.sha2("text", 256).alias("hash"))
    copies = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(closing), F.col("id").eqNullSafe(F.col("head")))
        .groupBy(F.col("to").alias("bucket"))
        .agg(F.min("id").alias("id"), F.min_by("text", order).alias("text"))
        .select("bucket", "id", "text", F.lit(True).alias("extra"))
    )
    return rows.unionByName(copies)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """Fingerprints of documents and of their edited texts: the last half (rounded down) of the code points gives way to as many code
    points (or all) from the start of the next document by id, the first one following the last.

    One row per row of docs. Rows with equal ids follow each other by text (null first, then by hash); null ids come first.
    """
    rows = next_in_order(docs, id_col, text_col)
    frugal(docs.sparkSession)
    placed = rows.repartition("bucket").withColumn("hash", F.sha2("text", 256)).sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_first(), F.col("hash").asc_nulls_first()).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int | None, str, bool]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                waiting.append((row[0], row[1], row[2] or "", row[3]))
                size += len(waiting[-1][2])
                if size >= AT_ONCE:
                    yield done(waiting)
                    waiting, size = waiting[-1:], len(waiting[-1][2])
        if len(waiting) > 1:
            yield done(waiting)

    def done(rows: list[tuple[int, int | None, str, bool]]) -> pa.RecordBatch:
        pairs = [(a, b[2]) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
        texts = [r[2] for r in rows]
        whole = sketches([_points(t) for t in texts], keep)
        own = {i: k for k, i in enumerate(i for i, r in enumerate(rows[:-1]) if not r[3])}
        new = [a[2][: len(a[2]) - len(a[2]) // 2] + b[: len(a[2]) // 2] for a, b in pairs]
        other = [s for part in _parts(new) for s in sketches([_points(t) for t in part], keep)]
        cols = [
            [a[1] for a, _ in pairs], [len(a[2]) for a, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in new],
            [text_of(whole[i]) for i in own], [text_of(s) for s in other],
            [likeness(whole[i], other[k], keep) for i, k in own.items()], [likeness(whole[i], whole[i + 1], keep) for i in own],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, EDITED.types, strict=True)], schema=EDITED)

    kind = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.mapInArrow(run, kind)


EDITED = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
