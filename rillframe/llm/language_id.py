"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed letter n-grams (one to three letters, whole text) of unit length. Each language has several
centroids, found by spherical k-means among its training vectors. The nearest centroid by cosine names the language. A text is marked as
rejected if its cosine is below (1 - `slack`) times the one that all but a hundredth of the language's training texts of its length reach: short texts
are farther from every centroid, so each length (in powers of two of n-grams) has a limit of its own, learned from whole texts and their beginnings. Each half of
the texts is held against centroids of the other half. A text without letters has language `und`.

Document frequencies are counted over all training rows. The centroids are fitted on at most about `per_language` rows of each
language, chosen by a hash of the row's id and text.

Null texts, and texts without letters, give `und`, score 0 and rejected. Rows with a null language or a null id are not learned
from. With nothing to learn from every text is `und`. Repeated rows give repeated results; ties go to the first language by name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import code_points, frugal, slices

#: Number of hashed n-gram features.
DIMS = 8192
#: Texts whose dense vectors are made at a time, and bytes of text: what a worker holds besides a batch is some 30 times as much.
AT_ONCE = 64
BYTES_AT_ONCE = 1 << 19
#: Training rows of each language that centroids are fitted on, about.
PER_LANGUAGE = 400
CENTROIDS = 4
#: A table that names more languages is refused: every one of them has centroids in the model.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Share of a language's training texts that may lie beyond its radius.
BEYOND = 0.01
#: Letters of the beginnings of texts from which limits of short texts are learned, and the number of classes of length.
BEGINNINGS = (16, 64, 256, 1024)
LENGTHS = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for all that isn't a letter."""
    out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of n-gram counts of texts."""
    n = len(offsets) - 1
    points, offsets = code_points(raw, offsets)
    x = _letters()[points]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    letter = x != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    x, owner = x[keep], owner[keep]
    bins = []
    for size in (1, 2, 3):
        if len(x) < size:
            break
        h = np.zeros(len(x) - size + 1, dtype=np.uint32)
        for k in range(size):
            h = (h + x[k : len(x) - size + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h += np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        h *= np.uint32(0xC2B2AE35)
        same = owner[: len(h)] == owner[size - 1 :]
        bins.append(owner[: len(h)][same].astype(np.int64) * DIMS + (h[same] >> np.uint32(19)))
    if not bins:
        return np.zeros((n, DIMS), dtype=np.float32)
    return np.bincount(np.concatenate(bins), minlength=n * DIMS).astype(np.float32).reshape(n, DIMS)


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, n-gram counts) over a batch."""
    for first, end, raw, offsets in slices(batch, column, BYTES_AT_ONCE):
        for at in range(0, end - first, AT_ONCE):
            part = offsets[at : min(at + AT_ONCE, end - first) + 1]
            yield first + at, first + at + len(part) - 1, _counts(raw[part[0] : part[-1]], part - part[0])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: For each language and class of length, the least cosine that isn't rejected.
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)
        blank = counts.sum(axis=1) == 0
        score[blank] = 0
        named = [UNKNOWN if b else self.languages[i] for b, i in zip(blank, self.owner[best], strict=True)]
        return named, score, blank | (score < self.least[self.owner[best], _length(counts.sum(axis=1))])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means that starts from points far from each other."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c = _unit(c)
    return c


def _length(grams: np.ndarray) -> np.ndarray:
    """Class of length of texts with so many n-grams."""
    return np.clip(np.log2(np.maximum(grams, 1)).astype(int), 0, LENGTHS - 1)


def _dense(rows: list) -> np.ndarray:
    """Unit vectors of sampled rows."""
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["x"], np.float16)
    return _unit(x)


def _limits(rows: list, texts: np.ndarray, whole: np.ndarray, k: int, slack: float) -> np.ndarray:
    """The least cosine by class of length. rows are whole texts and beginnings, texts the vectors of whole ones. A class without texts takes the next shorter one's."""
    half, half_of_text = np.cumsum(whole) % 2, np.arange(1, len(texts) + 1) % 2
    cos, grams = np.zeros(len(rows)), np.array([r["grams"] for r in rows])
    for h in (0, 1):
        others, mine = texts[half_of_text != h], np.flatnonzero(half == h)
        if len(mine):
            c = _centroids(others if len(others) else texts, k)
        # beginnings are dense a few at a time: all of a language would be some 60 MB
        for some in np.split(mine, range(AT_ONCE, len(mine), AT_ONCE)):
            if len(some):
                cos[some] = (_dense([rows[i] for i in some]) @ c.T).max(axis=1)
    out, at = np.zeros(LENGTHS), _length(grams)
    for c in range(LENGTHS):
        mine = cos[at == c]
        out[c] = (1 - slack) * np.quantile(mine, BEYOND) if len(mine) else out[c - 1] if c else 0
    return out


def fit(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, slack: float = 0.25
) -> Model:
    """Learns from the rows where `learn` holds and the language isn't null."""
    frugal(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS, dtype=np.int64)
        for batch in batches:
            for _, _, counts in _blocks(batch, "text"):
                seen += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS)), pa.array(seen)], names=["bin", "df"])

    df = np.zeros(DIMS)
    for r in rows.select("text").mapInArrow(frequencies, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect():
        df[r["bin"]] = r["df"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, counts in _blocks(batch, "text"):
                x = _unit(np.log1p(counts) * idf).astype(np.float16)
                at = [np.flatnonzero(r).astype(np.int16) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(counts.sum(axis=1).astype(np.int64)), pa.array([a.tobytes() for a in at]), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)])], names=["id", "lang", "part", "grams", "at", "x"])

    # by id and text, and each such pair once: neither one id on many rows nor a row that is repeated often makes the sample large
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("text")), *[F.struct(F.lit(n).alias("part"), F.when(F.length("text") > n, F.substring("text", 1, n)).alias("text")) for n in BEGINNINGS])
    some = rows.where(share < rate).select("id", "lang", "text").distinct().select("id", "lang", F.xxhash64("text").alias("_text"), F.explode(parts).alias("p"))
    cut = some.where("p.text is not null").select("id", "lang", F.struct("_text", "p.part").alias("part"), "p.text")
    got = cut.mapInArrow(sampled, f"id {kind}, lang string, part struct<_text: long, part: int>, grams long, at binary, x binary").collect()
    got = sorted((r for r in got if r["grams"]), key=lambda r: (r["lang"], r["id"], r["part"]["_text"], r["part"]["part"]))
    if not got:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)))
    names, each, least = [], [], []
    for name, group in groupby(got, key=lambda r: r["lang"]):
        mine = list(group)
        whole = np.array([r["part"]["part"] == 0 for r in mine])
        texts = _dense([r for r, w in zip(mine, whole, strict=True) if w])
        names.append(name)
        each.append(_centroids(texts, centroids))
        least.append(_limits(mine, texts, whole, centroids, slack))
    c, owner = np.concatenate(each), np.repeat(np.arange(len(names)), [len(e) for e in each])
    return Model(names, idf, c.astype(np.float32), owner, np.stack(least))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_rejected; columns of these names are replaced. Only the text is read for it."""
    sent = frugal(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(texts: pa.Array) -> pa.Array:
        names, score, out = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for first, end, counts in _blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            got = sent.value.predict(counts)
            names += got[0]
            score[first:end], out[first:end] = got[1:]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(out)], names=["lang", "score", "rejected"])

    kept = docs.drop("lang_pred", "lang_score", "lang_rejected")
    own = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("doc")
    got = kept.select(own, nearest(F.col(f"`{text_col}`")).alias("near"))
    return got.select("doc.*", F.col("near.lang").alias("lang_pred"), F.col("near.score").alias("lang_score"), F.col("near.rejected").alias("lang_rejected"))
