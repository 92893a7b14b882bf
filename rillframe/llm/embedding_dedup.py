"""Near duplicates among embeddings by cross-polytope hashing.

Each table turns a unit vector by fast Hadamard rotations (three rounds of random signs and a Hadamard transform) and takes the largest
coordinate with its sign, for two rotations at once. Besides its own bucket a vector probes those that its second-largest coordinates name. What meets in
a bucket is verified by cosine in double precision. A pair counts in the first table, and there in the first bucket, in which it meets.

Equal vectors are one class with a count, so that they meet others once. A bucket of more than BLOCK classes is cut into blocks, and pairs of blocks
are compared as rows of their own; none is dropped.

Null and zero vectors, and those with null or non-finite components, link with nothing. Only vectors of one length link. Each row is a vector of its own,
so that repeated rows link with each other; a component is named by its least id (null ids first). An empty table gives an empty one. Results may lack links that no table finds: see the
README for measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import bit_filter, frugal, in_filter, sized, written
from rillframe.llm.components import stars

#: Hash tables for vectors of up to so many dimensions: more dimensions have more buckets, in which near vectors meet less often.
TABLES = {64: 5, 256: 7, 768: 10, 1 << 30: 12}
PROBES = 3
BLOCK = 512
THRESHOLD = 0.9
SEED = 20_240_117


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of two; lengths are kept."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def tables_for(dims: int) -> int:
    return next(t for most, t in TABLES.items() if dims <= most)


def codes(x: np.ndarray, tables: int | None = None) -> np.ndarray:
    """Buckets of unit vectors: rows x tables x probes, the own bucket first."""
    n, d = x.shape
    tables = tables or tables_for(d)
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.empty((n, tables, PROBES), dtype=np.int64)
    rng = np.random.default_rng(SEED)
    rows = np.arange(n)
    for t in range(tables):
        first, second = [], []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            a = np.abs(y)
            one = a.argmax(axis=1)
            a[rows, one] = -1
            two = a.argmax(axis=1)
            first.append(2 * one + (y[rows, one] < 0))
            second.append(2 * two + (y[rows, two] < 0))
        for p, (i, j) in enumerate(((first[0], first[1]), (second[0], first[1]), (first[0], second[1]))):
            out[:, t, p] = i * (2 * size) + j
    return out


def _vectors(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of numbers, and whether each may link."""
    rows = [np.array([np.nan if v is None else v for v in r], dtype=np.float64) if r else np.zeros(0) for r in column.to_pylist()] if column.null_count or column.flatten().null_count else None
    if rows is None:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum([len(r) for r in column]) if len(column) else []
        rows = np.split(flat, ends[:-1]) if len(column) else []
    with np.errstate(over="ignore", invalid="ignore"):
        fine = np.array([len(r) > 0 and bool(np.isfinite(r).all()) and bool(np.abs(r).max() > 0) for r in rows], dtype=bool)
    return rows, fine


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch], tables: int | None, single: bool, keys_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows (dims, table, bucket) for each bucket of each class, and unless keys_only its name, count, vector and all buckets (as bytes)."""
    kind = np.float32 if single else np.float64
    for batch in batches:
        rows, fine = _vectors(batch.column(2))
        lengths = np.array([len(r) for r in rows])
        for d in np.unique(lengths[fine]) if len(rows) else []:
            which = np.flatnonzero(fine & (lengths == d))
            c = codes(_unit(np.stack([rows[i] for i in which])), tables)
            for t in range(c.shape[1]):
                for p in range(PROBES):
                    k = np.flatnonzero((c[:, t, p : p + 1] != c[:, t, :p]).all(axis=1)) if p else np.arange(len(which))
                    cols = [pa.array(np.full(len(k), d, np.int32)), pa.array(np.full(len(k), t, np.int32)), pa.array(c[k, t, p])]
                    if not keys_only:
                        own = pa.array(which[k])
                        cols += [batch.column(0).take(own), batch.column(1).take(own), pa.array([rows[i].astype(kind).tobytes() for i in which[k]], pa.binary()), pa.array([c[i].astype(np.int32).tobytes() for i in k], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["dims", "table", "bucket", "class", "n", "vector", "codes"][: len(cols)])


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index that links reach, for a symmetric matrix of links with a full diagonal."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met(group: dict[str, np.ndarray], x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Of one group of classes: the links that count here, weighted by the other class's size, and the least class of each one's local component."""
    cos = x @ x.T
    linked = cos >= threshold
    close = np.abs(cos - threshold) < 1e-9
    if close.any():  # sums in one fixed order for what lies on the edge
        i, j = np.nonzero(close)
        linked[i, j] = (x[i] * x[j]).sum(axis=1) >= threshold
        linked |= linked.T
    np.fill_diagonal(linked, True)
    if linked.sum() == len(x):
        return None
    counted = linked.copy()
    np.fill_diagonal(counted, False)
    if group["low"][0] != group["high"][0]:  # two blocks: pairs within one are compared where that block meets itself
        counted &= group["block"][:, None] != group["block"][None, :]
        linked &= (group["block"][:, None] != group["block"][None, :]) | np.eye(len(x), dtype=bool)
    t0, bucket = int(group["table"][0]), int(group["bucket"][0])
    for t in range(t0 + 1):
        for i in range(PROBES):
            for j in range(PROBES):
                same = c[:, t, i][:, None] == c[:, t, j][None, :]
                counted &= ~(same if t < t0 else same & (c[:, t, i] < bucket)[:, None])
    return counted @ group["n"], _labels(linked)


def _compared(batches: Iterator[pa.RecordBatch], threshold: float, single: bool) -> Iterator[pa.RecordBatch]:
    """Rows (class, links, root) from rows sorted by group."""
    names = ("dims", "table", "bucket", "low", "high")
    rest: pa.Table | None = None

    def groups(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        key = np.stack([table.column(k).to_numpy() for k in names], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.append(cuts, len(key))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        cols = {k: table.column(k).to_numpy() for k in ("class", "n", "block", *names)}
        vectors, code = table.column("vector").to_pylist(), table.column("codes").to_pylist()
        out: list[list] = [[], [], []]
        for s, e in zip(starts, ends, strict=True):
            if e - s < 2:
                continue
            x = _unit(np.frombuffer(b"".join(vectors[s:e]), dtype=np.float32 if single else np.float64).reshape(e - s, -1).astype(np.float64))
            c = np.frombuffer(b"".join(code[s:e]), dtype=np.int32).reshape(e - s, -1, PROBES)
            got = _met({k: v[s:e] for k, v in cols.items()}, x, c, threshold)
            if got is None:
                continue
            own = cols["class"][s:e]
            busy = (got[0] > 0) | (got[1] != np.arange(e - s)) | (np.bincount(got[1], minlength=e - s) > 1)
            out[0].append(own[busy])
            out[1].append(got[0][busy])
            out[2].append(own[got[1]][busy])
        done = [pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=["class", "links", "root"])] if out[0] else []
        return done, table.slice(int(ends[-1]) if len(ends) else 0)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        done, rest = groups(rest, last=False)
        yield from done
    if rest is not None and rest.num_rows:
        yield from groups(rest, last=True)[0]


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int | None = None) -> DataFrame:
    """Per row of vectors: its id, n_links and component_id. `tables`: in place of as many as the vectors' dimensions ask for.

    What moves is each distinct vector once for its class and once for each of its buckets; buckets that are cut move once more.
    """
    frugal(vectors.sparkSession)
    # a class is known by 128 bits of its vector, so that null ids and ids that several vectors share do no harm
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"), F.xxhash64(vector_col).alias("k1"), F.xxhash64(F.lit(SEED), vector_col).alias("k2"))
    classes, n_classes = sized(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.any_value("e").alias("e")), "classes")
    # one half names it, or the other where several classes share the first
    shared = classes.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1").select("k1", F.lit(True).alias("shared"))
    shared = written(shared, "shared-names", n_classes)
    classes = classes.join(F.broadcast(shared), "k1", "left").withColumn("class", F.when(F.col("shared"), F.col("k2")).otherwise(F.col("k1"))).drop("shared") if not shared.isEmpty() else classes.withColumn("class", F.col("k1"))
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    given = classes.select("class", "n", "e")
    keys = ["dims", "table", "bucket"]
    buckets = given.mapInArrow(lambda b: _hashed(b, tables, single, True), "dims int, table int, bucket long")
    big = written(buckets.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1").withColumn("of", F.xxhash64(*keys)), "big-buckets")
    hashed = given.mapInArrow(lambda b: _hashed(b, tables, single, False), "dims int, table int, bucket long, class long, n long, vector binary, codes binary")
    hashed = hashed.withColumn("of", F.xxhash64(*keys))
    large = in_filter(vectors.sparkSession, bit_filter(big.select("of"), "of"), "of")
    whole = hashed.where(~large).drop("of").withColumn("blocks", F.lit(1)).withColumn("other", F.lit(0))
    cut = hashed.where(large).drop("of").join(big.drop("of"), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = whole.unionByName(cut).withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), "blocks").cast("int"))
    placed = placed.select("class", "n", "vector", "codes", *keys, "block", F.least("block", "other").cast("int").alias("low"), F.greatest("block", "other").cast("int").alias("high"))
    order = [*keys, "low", "high"]
    found = placed.repartition(*order).sortWithinPartitions(*order, "class").mapInArrow(lambda b: _compared(b, threshold, single), "class long, links long, root long")
    found, n_found = sized(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = stars(found.where("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v")), n_found)
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(least, "root").join(links, "class", "left").select("k1", "k2", "n", F.coalesce("links", F.lit(0)).alias("links"), "component")
    may = F.exists(F.coalesce("e", F.array()), lambda v: v != 0) & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = rows.join(known, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.coalesce(may, F.lit(False)), F.col("links") + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.coalesce(may, F.lit(False)), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    )

