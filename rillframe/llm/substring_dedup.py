"""Removal of passages that earlier documents hold, by a log-structured index of window hashes.

A window is 50 words on end. Each window picks its anchor, the least hash among its runs of 8 words, so that equal windows pick equal anchors; the windows of
a document that share an anchor make one entry: the anchor's hash, and a hash of all the words that these windows cover. The index holds
each distinct entry once, with the first document that has it, as immutable runs: tables in buckets by hash, sorted by it. A batch is dealt as the runs are and
merge-joined with them where they stand; what it adds becomes a run of its own, and runs are compacted when there are many.

An entry known from a smaller document settles all its windows at once. Where entries share an anchor but not all their words, which
is at the edges of common passages, the texts of these entries are read again and their single windows compared by two more hashes.

Words are runs of bytes other than ASCII white space. Null texts have none, an empty table gives an empty one. Rows with equal ids, whatever their texts, never remove each other's words, and rows with a null id
neither remove nor lose any. Equal rows have equal results.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm import words as W
from rillframe.llm.common import ROW_GROUP, bit_filter, dropped, frugal, in_filter, mixed, row_key, shared_dir, sized, slices, written

WINDOW = 50
ANCHOR = 8
#: Batches that a whole table is taken in, and runs that the index keeps before it compacts them.
BATCHES = 3
RUNS = 2
#: Entries that are worth a bucket of their own, beyond those that the session's shuffles have.
BUCKET_ROWS = 5_000_000
RUN = "key long, ctx long, doc long, last long"
ENTRY = "key long, ctx long, doc long, row long, low int, high int"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values on end."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _entries(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, hash of all words, first window, last window) of each entry; windows count from the start of their text."""
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = W.run_hashes(hashes, ANCHOR)
    place = np.uint64(30)
    order = (grams >> place << place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(order, WINDOW - ANCHOR + 1) & np.uint64((1 << 30) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(at, starts, side="right") - 1
    inside = starts + WINDOW <= at[text + 1]
    starts, text, anchor = starts[inside], text[inside], anchor[inside]
    if not len(starts):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    low, high, text, anchor = starts[new], starts[last], text[new], anchor[new]
    powers, inverse = W.powers_and_inverses(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mixed(hashes + np.uint64(7)) * powers, out=sums[1:])
    words = (sums[high + WINDOW] - sums[low]) * inverse[low]
    shape = ((high - low).astype(np.uint64) << np.uint64(32)) | (anchor - low).astype(np.uint64)
    return text, grams[anchor], mixed(words ^ mixed(shape)), low - at[text], high - at[text]


def entries(docs: DataFrame) -> DataFrame:
    """Rows (key, ctx, doc, row, low, high) of docs (row, doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, offsets in slices(batch, "text", W.AT_ONCE):
                hashes, _, at = W.word_hashes(raw, offsets, lower=False)
                text, key, ctx, low, high = _entries(hashes, at)
                own = pa.array(text + first)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ctx.astype(np.int64)), batch.column(1).take(own), batch.column(0).take(own), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["key", "ctx", "doc", "row", "low", "high"])

    return docs.select("row", "doc", "text").mapInArrow(run, ENTRY)


class Index:
    """Immutable sorted runs of distinct entries, with the smallest document of each and the largest of its batch. Batches with smaller ids than earlier ones don't change what those lost.

    Each run is a table in `buckets` buckets by (key, ctx), sorted by them, in a folder of its own; a manifest names the runs, so that a later session opens
    the index by its folder and goes on. A batch's distinct entries are dealt and sorted as the runs are and merged with them: the runs themselves don't move.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, most_runs: int = RUNS):
        self.spark, self.most_runs = spark, most_runs
        self.folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        known = self._read_manifest()
        self.buckets = known["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = known["runs"] if known else []
        self.tables: list[str] = []
        self.runs: list[DataFrame] = [self._opened(n) for n in self.names]

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _read_manifest(self) -> dict | None:
        path = self._path("manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.text(path.toString()).collect()  # one line a run
        return {"buckets": int(rows[0]["value"]), "runs": [r["value"] for r in rows[1:]]}

    def _write_manifest(self) -> None:
        """A new manifest takes the place of the old one only once it is whole."""
        fs = self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        lines = self.spark.createDataFrame([(str(self.buckets),), *[(n,) for n in self.names]], "value string").coalesce(1)
        lines.write.mode("overwrite").text(f"{self.folder}/manifest-new")
        fs.delete(self._path("manifest"), True)
        fs.rename(self._path("manifest-new"), self._path("manifest"))

    def _opened(self, name: str) -> DataFrame:
        """A run by its place, known to Spark as bucketed and sorted."""
        at = f"rillframe_{uuid.uuid4().hex}"
        self.tables.append(at)
        self.spark.sql(f"CREATE TABLE {at} ({RUN}) USING parquet CLUSTERED BY (key, ctx) SORTED BY (key, ctx) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(at)

    def _run(self, entries: DataFrame) -> None:
        """Writes a run of distinct entries."""
        name, at = f"run-{uuid.uuid4().hex}", f"rillframe_{uuid.uuid4().hex}"
        self.tables.append(at)
        writer = entries.select("key", "ctx", "doc", "last").write.format("parquet").option("parquet.block.size", ROW_GROUP)
        writer.bucketBy(self.buckets, "key", "ctx").sortBy("key", "ctx").option("path", f"{self.folder}/{name}").saveAsTable(at)
        self.names.append(name)
        self.runs.append(self.spark.table(at))

    def _merged(self, batch: DataFrame) -> DataFrame:
        """(key, ctx, doc, last) of a batch's distinct entries: the smallest document that has each, of the index or the batch, and the largest of the batch.

        Entries are counted together before they move, so that one that many documents share is one row for each task.
        """
        out = batch.where("doc is not null").groupBy("key", "ctx").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            out = out.repartition(self.buckets, "key", "ctx")
        for run in self.runs:
            out = out.join(run.select("key", "ctx", F.col("doc").alias("known")), ["key", "ctx"], "left").withColumn("doc", F.least("doc", "known")).drop("known")
        return out

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of entries as a run; returns those (row, doc, low, high) that an entry of a smaller document settles."""
        self._run(self._merged(batch))
        # a plain table: Spark may split a join with it where one entry is in very many rows
        settled = written(self.runs[-1].where("doc < last").select("key", "ctx", F.col("doc").alias("owner")), "settled")
        hits = written(batch.join(settled, ["key", "ctx"]).where("owner < doc").select("row", "doc", "low", "high").distinct(), "hits")
        dropped(self.spark, settled)
        if len(self.runs) > self.most_runs:
            self.compact()
        self._write_manifest()
        return hits

    def history(self) -> DataFrame:
        """All runs' entries, each once with its smallest document."""
        merged = self.runs[0].select("key", "ctx", "doc", "last")
        for run in self.runs[1:]:
            other = run.select("key", "ctx", F.col("doc").alias("other"), F.col("last").alias("end"))
            merged = merged.join(other, ["key", "ctx"], "full").select("key", "ctx", F.least("doc", "other").alias("doc"), F.greatest("last", "end").alias("last"))
        return merged

    def compact(self) -> None:
        """Merges all runs into one that keeps the smallest document of each entry."""
        old, merged, tables = self.names, self.history(), self.tables
        self.names, self.runs, self.tables = [], [], []
        self._run(merged)
        self._write_manifest()
        fs = self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for name, at in zip(old, tables, strict=True):
            self.spark.sql(f"DROP TABLE IF EXISTS {at}")
            fs.delete(self._path(name), True)

    def close(self) -> None:
        """Forgets the runs' names in the catalogue; their files stay."""
        for at in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {at}")

    def delete(self) -> None:
        """Removes the index and its files."""
        self.close()
        path = self._path("manifest").getParent()
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def contested(self, entries: DataFrame) -> DataFrame:
        """Entries (row, doc, low, high) whose anchor other entries share: their windows are yet to be compared one by one.

        The history names an entry once, with its document; `entries` has all places of it in all rows of that document.
        """
        known = self.history()
        shared = known.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        named = written(known.join(shared, "key").select("key", "ctx", "doc"), "named")
        return entries.join(named, ["key", "ctx", "doc"]).select("row", "doc", "low", "high")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _spans(of: DataFrame) -> DataFrame:
    return of.groupBy("row", "doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def windows(texts: DataFrame) -> DataFrame:
    """Rows (one, two, doc, row, at) of the windows in the spans of texts (row, doc, text, spans): two hashes and the place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3).to_pylist()
            for first, end, raw, offsets in slices(batch, "text", W.AT_ONCE):
                hashes, _, at = W.word_hashes(raw, offsets, lower=False)
                one, two = W.run_hashes(hashes, WINDOW), W.run_hashes(mixed(hashes ^ np.uint64(0x6C62272E07BB0142)), WINDOW)
                where = [np.unique(np.concatenate([np.arange(s["low"], s["high"] + 1) for s in spans[i]])) for i in range(first, end)]
                own = pa.array(np.repeat(np.arange(first, end), [len(w) for w in where]))
                place = np.concatenate([w + at[i] for i, w in enumerate(where)])
                yield pa.RecordBatch.from_arrays([pa.array(one[place].astype(np.int64)), pa.array(two[place].astype(np.int64)), batch.column(1).take(own), batch.column(0).take(own), pa.array(np.concatenate(where).astype(np.int32))], names=["one", "two", "doc", "row", "at"])

    return texts.select("row", "doc", "text", "spans").mapInArrow(run, "one long, two long, doc long, row long, at int")


def compare_windows(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """Windows (row, doc, low, high) of contested entries that also start in a smaller document. docs: (row, doc, text)."""
    needed = bit_filter(contested.select("row"), "row")
    texts = docs.where(in_filter(docs.sparkSession, needed, "row")).join(_spans(contested), ["row", "doc"])
    found = written(windows(texts), "windows")
    first = found.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("one", "two", "least")
    return found.join(first, ["one", "two"]).where("least < doc").select("row", "doc", F.col("at").alias("low"), F.col("at").alias("high")).distinct()


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """(words, words removed, what is left) of a text whose windows in the spans go."""
    words = (text or "").encode().split()
    n = len(words)
    if not spans:
        return n, 0, b" ".join(words)
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        edge[s["low"]] += 1
        edge[s["high"] + WINDOW] -= 1
    stays = np.cumsum(edge[:n]) == 0
    return n, int(n - stays.sum()), b" ".join([words[i] for i in np.flatnonzero(stays)])


def _result(texts: DataFrame, id_col: str, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            if keep_text:
                cols.append(pa.array([g[2].decode() for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    return texts.select(F.col("doc").alias(id_col), "text", "spans").mapInArrow(run, f"{id_col} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, keep_text: bool = False) -> DataFrame:
    """Per row of docs: its id, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    The table is taken in batches of ascending ids, as it would arrive over time. A text moves once if it may lose words, and once if it has contested entries.
    """
    frugal(docs.sparkSession)
    rows = docs.select(row_key(F.col(id_col).cast("long"), text_col).alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    marks = sorted(set(rows.select("doc").approxQuantile("doc", [i / batches for i in range(1, batches)], 0.02))) if batches > 1 else []
    number = sum([(F.col("doc") >= m).cast("int") for m in marks], F.lit(0))
    found, n = sized(entries(rows), "entries")
    index = Index(docs.sparkSession, buckets=max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_ROWS))
    hits = [index.ingest(found.where(F.coalesce(number, F.lit(0)) == b)) for b in range(len(marks) + 1)]
    contested = written(index.contested(found), "contested")
    index.delete()
    gone = written(_spans(_union([*hits, compare_windows(rows, contested)])), "gone")
    dropped(docs.sparkSession, found, contested, *hits)
    loses = in_filter(docs.sparkSession, bit_filter(gone.select("row"), "row"), "row")
    some = rows.withColumn("loses", loses)
    moved = some.where("loses").join(gone, ["row", "doc"], "left")
    stay = some.where("not loses").withColumn("spans", F.lit(None).cast("array<struct<low:int,high:int>>"))
    return _result(moved.select("doc", "text", "spans").unionAll(stay.select("doc", "text", "spans")), id_col, keep_text)
