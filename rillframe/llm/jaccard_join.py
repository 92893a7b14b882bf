"""Links between documents whose word shingles are alike, and the groups that they form.

Documents with equal shingle sets are one class. Shingles have one global order: those that many documents share come last, by the logarithm of their count,
all others stand by hash. The counts are kept per bucket of hashes, in a table of fixed size, so that a shingle's count is its bucket's. Two sets of Jaccard similarity t or more share a shingle among the first n - ceil(t n) + 1 of either; that gives the candidates. To verify them, the order
of hashes is cut into fragments: each class has a segment per fragment, overlaps are counted fragment by fragment, and the counts are summed per pair.

Groups of near copies may hold a large part of all documents, so that not all of their pairs can be listed. First each class is compared with one other
for each of some minimum hashes, which joins such groups; from then on only pairs of classes that no links join yet are candidates. For a shingle that few
classes share these pairs are listed. Classes that meet in shingles that many share form clusters; in a cluster, the classes outside its largest joined
part are compared with all others, block by block, and only the links that join something leave a block. No pair is left out unless links already join it,
so that the groups are exact.

Null texts and texts without words have no shingles and link with nothing; with fewer words than a shingle has, the whole sequence is one. Ties and repeated rows share a class. A group is named by its smallest non-null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.llm import words as W
from rillframe.llm.common import bit_filter, dropped, frugal, in_filter, mixed, row_key, sized, slices, written
from rillframe.llm.components import stars

SHINGLE = 5
PERCENT = 75
#: Fragments of the order of hashes.
FRAGMENT_BITS = 3
#: Buckets of hashes whose shingles are counted together, and those in a row. Any order gives the same links.
COUNTED_BITS = 22
CHUNK_BITS = 14
MIN_HASHES = 4
#: Classes that share a shingle, up to which all pairs of them are compared at once.
FEW = 256
#: Classes in a block of a cluster, and shingles that they have together, on average.
BLOCK = 256
BLOCK_SHINGLES = 1 << 17
#: A token's bit at which the level of its bucket begins, the level (about 100,000 classes) from which a token's classes are dealt over several tasks, and over how many.
LEVEL_AT = 55
HOT_LEVEL = 134
HOT_TASKS = 64


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each text."""
    hashes, _, at = W.word_hashes(raw, offsets, lower=True)
    runs = W.run_hashes(hashes, SHINGLE) >> np.uint64(1)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            s = np.sort(runs[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(mixed(W.run_hashes(hashes[a:b], n) + np.uint64(n)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names_of(sets: list[np.ndarray], taken: dict[int, set[int]], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each set a 64-bit name and 64 more bits that tell sets of one name apart; sets whose name is taken go by those."""
    name, other = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    for i, s in enumerate(sets):
        m = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
        one = int(np.add.reduce(m)) & (1 << bits) - 1
        two = int(np.add.reduce(m * (m >> np.uint64(32)))) & (1 << 64) - 1
        name[i], other[i] = np.array([one, two], dtype=np.uint64).astype(np.int64)
        if taken and int(other[i]) in taken.get(int(name[i]), ()):
            name[i] = other[i]
    return name, other


def _sets(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for first, end, raw, offsets in slices(batch, column, W.AT_ONCE):
        yield first, end, shingle_sets(raw, offsets)


class _Counter:
    """A task's counts of shingles by bucket, kept as a table only once there are many."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.table: np.ndarray | None = None

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(_bucket(hashes))
        self.held += len(hashes)
        if self.held > 1 << COUNTED_BITS - 3:
            if self.table is None:
                self.table = np.zeros(1 << COUNTED_BITS, dtype=np.int32)
            at, n = self._waiting()
            self.table[at] += n
            self.waiting, self.held = [], 0

    def _waiting(self) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return at, n.astype(np.int32)

    def chunks(self) -> Iterator[tuple[int, bytes | None, bytes]]:
        """(chunk, places, counts up to 255) of the chunks that have any; without places the counts are those of all places, where that is shorter."""
        at, n = self._waiting()
        if self.table is not None:
            self.table[at] += n
            at = np.flatnonzero(self.table).astype(np.int32)
            n = self.table[at]
        cuts = np.searchsorted(at, np.arange(0, (1 << COUNTED_BITS) + 1, 1 << CHUNK_BITS))
        for chunk in np.flatnonzero(np.diff(cuts)):
            some = slice(cuts[chunk], cuts[chunk + 1])
            places, counts = (at[some] & (1 << CHUNK_BITS) - 1).astype(np.uint16), np.minimum(n[some], 255).astype(np.uint8)
            if 3 * len(places) < 1 << CHUNK_BITS:
                yield int(chunk), places.tobytes(), counts.tobytes()
            else:
                whole = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
                whole[places] = counts
                yield int(chunk), None, whole.tobytes()


SUMMARY = "key long, id long, n long, name long, other long, mins array<long>, places binary, counts binary"


def _summary(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (key, id, n, name, other, minimum hashes) and a task's counts of shingles (the chunk in id, places and counts)."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    salts = mixed(np.arange(1, MIN_HASHES + 1, dtype=np.uint64))
    counter = _Counter()
    for batch in batches:
        for first, end, sets in _sets(batch, "text"):
            name, other = names_of(sets, {}, bits)
            mins = [[int(mixed(s ^ x).min()) - (1 << 63) for x in salts] if len(s) else [] for s in sets]
            none = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(name), pa.array(other), pa.array(mins, pa.list_(pa.int64())), none, none], names=names)
            for i in np.unique(name, return_index=True)[1]:
                counter.add(sets[i])
    got = list(counter.chunks())
    if got:
        none = pa.nulls(len(got), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array([g[0] for g in got], pa.int64()), none, none, none, pa.nulls(len(got), pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary())], names=names)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << COUNTED_BITS) - 1)).astype(np.int32)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each chunk, from rows sorted by chunk."""
    at, total = None, np.zeros(1 << CHUNK_BITS, dtype=np.int64)
    for batch in batches:
        for chunk, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != at and at is not None:
                yield _sum_of(at, total)
                total = np.zeros(1 << CHUNK_BITS, dtype=np.int64)
            at = chunk
            where = slice(None) if places is None else np.frombuffer(places, dtype=np.uint16)
            total[where] += np.frombuffer(counts, dtype=np.uint8)
    if at is not None:
        yield _sum_of(at, total)


def _sum_of(chunk: int, counts: np.ndarray) -> pa.RecordBatch:
    counts = np.minimum(counts, 0xFFFFFFFF)
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(counts.sum())]), pa.array([counts.astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "total", "counts"])


def levels(counts: np.ndarray, usual: float) -> np.ndarray:
    """For each bucket 0, or if it holds far more than the usual count, which chance gives, the eighths of powers of two of its count, below 256."""
    frequent = counts > usual + 5 * np.sqrt(usual + 1) + 5
    return np.where(frequent, 1 + np.minimum(8 * np.log2(np.maximum(counts, 1)), 254), 0).astype(np.uint8)


def global_order(summary: DataFrame) -> np.ndarray:
    """The level of every bucket: a byte each, all that the driver gets of the counts."""
    chunks = summary.where("counts is not null").select(F.col("id").alias("chunk"), "places", "counts")
    sums = written(chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk long, total long, counts binary"), "counts")
    usual = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << COUNTED_BITS)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [levels(np.frombuffer(c, dtype=np.uint32), usual).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["chunk", "levels"])

    out = np.zeros((1 << COUNTED_BITS - CHUNK_BITS, 1 << CHUNK_BITS), dtype=np.uint8)
    for r in sums.select("chunk", "counts").mapInArrow(level, "chunk long, levels binary").collect():
        out[r["chunk"]] = np.frombuffer(r["levels"], dtype=np.uint8)
    dropped(summary.sparkSession, sums)
    return out.ravel()


def _prefixes(batches: Iterator[pa.RecordBatch], level: np.ndarray, taken: dict[int, set[int]], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, class, n): the first shingles of each set in the global order."""
    for batch in batches:
        for _, _, sets in _sets(batch, "text"):
            cols: list[list[np.ndarray]] = [[], [], []]
            classes = names_of(sets, taken, bits)[0]
            for i in np.unique(classes, return_index=True)[1]:
                n = len(sets[i])
                if not n:
                    continue
                # a token keeps 55 bits of its hash: two that coincide make candidates, not links
                key = level[_bucket(sets[i])].astype(np.uint64) << np.uint64(LEVEL_AT) | sets[i] >> np.uint64(8)
                key = np.sort(key)[: n - -(-n * PERCENT // 100) + 1]
                cols[0].append(key)
                cols[1].append(np.full(len(key), classes[i]))
                cols[2].append(np.full(len(key), n, dtype=np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0]).astype(np.int64)), *(pa.array(np.concatenate(c)) for c in cols[1:])], names=["token", "class", "n"])


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class, those whose token several classes have or whose level is hot (such tokens lie in many tasks), each class once."""
    held: pa.RecordBatch | None = None  # the last row seen, which may begin or continue a token
    kept = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = token[1:] == token[:-1]
        new = np.concatenate([[True], ~same | (name[1:] != name[:-1])])
        other = same & new[1:]  # another class with the token of the row before
        # a row stays if its token has another class before or after it
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        several = (np.add.reduceat(np.concatenate([[0], other.astype(np.int64)]), starts) > 0) | (token[starts] >> LEVEL_AT >= hot)
        if held is not None and kept:
            several[0] = True
        stays = new & np.repeat(several, np.diff(np.append(starts, len(token))))
        last_several = bool(several[-1])
        if held is not None and kept:
            stays[0] = False  # it was put out already
        # the last row waits: what follows decides on its token
        if last_several:
            kept = True
        else:
            stays[-1] = False
            kept = False
        if stays.any():
            yield batch.take(pa.array(np.flatnonzero(stays)))
        held = batch.slice(batch.num_rows - 1)


def _segments(batches: Iterator[pa.RecordBatch], taken: dict[int, set[int]], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, fragment, shingles as bytes) of texts."""
    for batch in batches:
        for _, _, sets in _sets(batch, "text"):
            out: list[list] = [[], [], []]
            for s, c in zip(sets, names_of(sets, taken, bits)[0], strict=True):
                cuts = np.searchsorted(s, np.arange(1, 1 << FRAGMENT_BITS, dtype=np.uint64) << np.uint64(63 - FRAGMENT_BITS))
                for f, piece in enumerate(np.split(s, cuts)):
                    if len(piece):
                        out[0].append(c)
                        out[1].append(f)
                        out[2].append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["class", "fragment", "shingles"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, na, b, nb, fragment, partial overlap)."""
    for batch in batches:
        left, right = batch.column(5), batch.column(6)
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            both = np.concatenate([np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)])
            both.sort()
            n[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n)], names=["a", "na", "b", "nb", "fragment", "n"])


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Of pairs (a, na, b, nb) of classes and their sizes those that link: partial overlaps per fragment, summed per pair. Segments may repeat."""
    # both joins deal segments out alike, so that Spark moves them once
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit((1 << FRAGMENT_BITS) - 1))))
    one = each.join(segments.select(F.col("class").alias("a"), "fragment", F.col("shingles").alias("left")), ["a", "fragment"])
    two = one.join(segments.select(F.col("class").alias("b"), "fragment", F.col("shingles").alias("right")), ["b", "fragment"])
    partial = two.select("a", F.col("na").cast("long"), "b", F.col("nb").cast("long"), "fragment", "left", "right").mapInArrow(_overlaps, "a long, na long, b long, nb long, fragment int, n long")
    counted = partial.groupBy("a", "na", "b", "nb").agg(F.collect_set(F.struct("fragment", "n")).alias("each"))
    common = F.aggregate("each", F.lit(0).cast("long"), lambda x, s: x + s["n"])
    return counted.where(100 * common >= PERCENT * (F.col("na") + F.col("nb") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _may_link(n: str, m: str) -> Column:
    """Whether sets of these sizes can be alike enough."""
    return (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def _clusters(shared: DataFrame, rows: int, segments: DataFrame) -> DataFrame:
    """Links (u, v) that join parts of clusters. shared: a written table of at most so many rows (token, class, n, root) of tokens that many classes share.

    A cluster holds the classes that such tokens join. Its classes outside the largest part meet all of them, in pairs of blocks.
    """
    hubs = shared.groupBy("token").agg(F.min("class").alias("v"))
    joined = sized(shared.join(hubs, "token").select(F.col("class").alias("u"), "v").distinct(), "hubs", rows)
    clusters = stars(*joined).withColumnsRenamed({"node": "class", "root": "cluster"})
    own = shared.select("class", "n", "root").distinct().join(clusters, "class", "left").withColumn("cluster", F.coalesce("cluster", "class"))
    own, rows = sized(own, "cluster-members", rows)
    part = own.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    size = part.groupBy("cluster").agg(F.max(F.struct("n", "c", "root")).alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("c > main.c")
    blocks = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    size = size.select("cluster", F.col("main.root").alias("main"), blocks(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("rests"), blocks(F.col("c"), F.col("n")).alias("blocks"))
    placed = written(own.join(size, "cluster"), "cluster-blocks", rows)
    block = lambda n: F.pmod(F.xxhash64("class", F.lit(3)), F.col(n)).cast("int")
    rest = placed.where("root <> main").select("class", "root", "cluster", block("rests").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    every = placed.select("class", "root", "cluster", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), block("blocks").alias("j"), F.lit(1).alias("side"))
    sets = segments.groupBy("class").agg(F.collect_set(F.struct("fragment", "shingles")).alias("segments"))
    met = rest.unionAll(every).join(sets, "class").select("cluster", "i", "j", "side", "class", "root", "segments")
    order = ["cluster", "i", "j"]
    return met.repartition(*order).sortWithinPartitions(*order, "side", "class").mapInArrow(_blocks_met, "u long, v long")


def _blocks_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two sides of each pair of blocks, from rows sorted by cluster, i, j and side."""
    held: list[dict] = []
    at: tuple | None = None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["cluster"], row["i"], row["j"])
            if key != at and held:
                yield _joined(held)
                held = []
            at = key
            held.append(row)
    if held:
        yield _joined(held)


def _joined(rows: list[dict]) -> pa.RecordBatch:
    """Of the linked pairs of two blocks, those that join parts that neither roots nor earlier pairs join."""
    left, right = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    n = [np.zeros(len(side), dtype=np.int64) for side in (left, right)]
    for f in range(1 << FRAGMENT_BITS):
        sets = [[np.frombuffer(next((s["shingles"] for s in r["segments"] if s["fragment"] == f), b""), np.uint64) for r in side] for side in (left, right)]
        for k in (0, 1):
            n[k] += [len(s) for s in sets[k]]
        values = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in sets]
        both = np.intersect1d(values[0], values[1])
        for low in range(0, len(both), 8192):
            some = both[low : low + 8192]
            dense = []
            for side, value in zip(sets, values, strict=True):
                owner = np.repeat(np.arange(len(side)), [len(s) for s in side])
                place = np.minimum(np.searchsorted(some, value), len(some) - 1)
                hit = some[place] == value
                m = np.zeros((len(side), len(some)), dtype=np.float32)
                m[owner[hit], place[hit]] = 1
                dense.append(m)
            common += dense[0] @ dense[1].T
    c = common.astype(np.int64)
    a, b = np.nonzero((100 * c >= PERCENT * (n[0][:, None] + n[1][None, :] - c)) & (c > 0))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out: list[tuple[int, int]] = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(left[i]["root"]), top(right[j]["root"])
        if x != y:
            up[x] = y
            out.append((left[i]["class"], right[j]["class"]))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])


def _beyond(n: str) -> Column:
    """Shingles of a set of n that its prefix doesn't hold."""
    return F.ceil(F.col(n) * PERCENT / 100) - 1


def _classes(members: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(class, other, most, best, key, n, mins): the sets there are, with the row of the smallest id of each (null ids last)."""
    named = members.where("n > 0").groupBy(F.col("name").alias("class"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    named = named.agg(F.min("other").alias("other"), F.max("other").alias("most"), best, F.first("n").alias("n"), F.first("mins").alias("mins"))
    return sized(named.withColumn("key", F.col("best.key")), "set-classes", most)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64, hot_level: int = HOT_LEVEL) -> DataFrame:
    """Per row of docs: its id, n_shingles and component_id."""
    got = groups(docs, id_col, text_col, name_bits, hot_level)
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64, hot_level: int = HOT_LEVEL) -> DataFrame:
    """Per row of docs (key, id, n, component, first): row_key of its id and text, its id, its shingles, its component, and whether it is the row of its
    component that has the smallest id, then the smallest key (null ids last). Rows without shingles are the first ones of their own.
    """
    spark = frugal(docs.sparkSession)
    rows = docs.select(row_key(F.col(id_col).cast("long"), text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    summary, n_docs = sized(rows.mapInArrow(lambda b: _summary(b, name_bits), SUMMARY), "sets")
    members = summary.where("counts is null")
    # different sets of one name are next to impossible: the driver sees those there are
    classes, n_classes = _classes(members, n_docs)
    taken: dict[int, set[int]] = {}
    twice = classes.where("other <> most")
    if not twice.isEmpty():
        again = members.where("n > 0").join(twice.select(F.col("class").alias("name"), F.col("other").alias("first")), "name").where("other <> first")
        for r in again.select("name", "other").distinct().collect():
            taken.setdefault(r["name"], set()).add(r["other"])
        moved = F.broadcast(spark.createDataFrame([(k, o) for k, others in taken.items() for o in others], "name long, other long").withColumn("moved", F.col("other")))
        members = members.join(moved, ["name", "other"], "left").withColumn("name", F.coalesce("moved", "name")).drop("moved")
        classes, n_classes = _classes(members, n_docs)
        if not classes.where("other <> most").isEmpty():
            raise RuntimeError("two sets share 128 bits of hashes")
    # the global order
    sent = spark.sparkContext.broadcast(global_order(summary))
    prefixes = rows.select("text").mapInArrow(lambda b: _prefixes(b, sent.value, taken, name_bits), "token long, class long, n int")
    spread_out = F.when(F.shiftright("token", LEVEL_AT) >= hot_level, F.pmod("class", F.lit(HOT_TASKS))).otherwise(0)
    prefixes = prefixes.repartition(F.col("token"), spread_out).sortWithinPartitions("token", "class")
    shared, n_shared = sized(prefixes.mapInArrow(lambda b: _shared(b, hot_level), "token long, class long, n int"), "shared")
    # one partner for each minimum hash
    mins = classes.select("class", "n", "key", F.posexplode("mins").alias("i", "low"))
    hub = mins.groupBy("i", "low").agg(F.min(F.struct("class", "n", "key")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("i", "low", F.col("hub.class").alias("a"), F.col("hub.n").alias("na"), F.col("hub.key").alias("ka"))
    first = mins.join(hub, ["i", "low"]).where(F.col("class") != F.col("a")).where(_may_link("n", "na")).select("a", "na", "ka", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("key").alias("kb"))
    first, n_first = sized(first.distinct(), "first-pairs", MIN_HASHES * n_classes)

    def segments_of(keys: DataFrame) -> DataFrame:
        """Segments of one text of each class needed. A text that the filter lets through by chance gives a class's segments again."""
        some = rows.where(in_filter(spark, bit_filter(keys, "key"), "key")).select("text")
        return written(some.mapInArrow(lambda b: _segments(b, taken, name_bits), "class long, fragment int, shingles binary"), "segments")

    segments = segments_of(first.select(F.explode(F.array("ka", "kb")).alias("key")))
    roots = stars(*sized(verified(first.drop("ka", "kb"), segments), "links", n_first << FRAGMENT_BITS))
    dropped(spark, segments)
    now = shared.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    spread = now.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "size")
    now, n_open = sized(now.join(spread, "token"), "open", n_shared)
    dropped(spark, shared)
    few, many = now.where(F.col("size") <= FEW), now.where(F.col("size") > FEW)
    crowded = not many.isEmpty()
    one, other = (few.select(F.col("token").alias(f"token_{x}"), F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = (F.col("token_a") == F.col("token_b")) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    met = one.join(other, apart & _may_link("na", "nb"))
    met = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # what the first shingles have in common, counted, leaves too little for most pairs: beyond them one of the two has n - prefix(n) shingles
    most = F.col("c") + F.greatest(_beyond("na"), _beyond("nb"))
    if crowded:
        unlisted = written(many.groupBy("class").agg(F.count("*").alias("u")), "unlisted", n_open)
        met = met.join(unlisted.withColumnsRenamed({"class": "a", "u": "ua"}), "a", "left").join(unlisted.withColumnsRenamed({"class": "b", "u": "ub"}), "b", "left")
        most = most + F.least(F.coalesce("ua", F.lit(0)), F.coalesce("ub", F.lit(0)))
    pairs, n_pairs = sized(met.where((100 + PERCENT) * most >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "na", "b", "nb"), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    if crowded:
        needed = needed.unionAll(many.select("class"))
    segments = segments_of(classes.select("class", "key").join(needed, "class", "left_semi"))
    links, n_links = sized(verified(pairs, segments), "links", n_pairs << FRAGMENT_BITS)
    if crowded:
        more, n_more = sized(_clusters(many, n_open, segments), "links")
        links, n_links = links.unionAll(more), n_links + n_more
    if n_links:
        roots = stars(links.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), n_links + n_classes)
    dropped(spark, segments, now)
    named = classes.select("class", "best").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("best").alias("best"))
    known = named.select(F.col("class").alias("name"), "root").join(least, "root").select("name", "best")
    out = members.where("n > 0").select("key", "id", "n", "name").join(known, "name", "left")
    out = out.select("key", "id", "n", F.col("best.id").alias("component"), (F.col("key") == F.col("best.key")).alias("first"))
    return out.unionAll(members.where("n = 0").select("key", "id", "n", F.col("id").alias("component"), F.lit(True).alias("first")))
