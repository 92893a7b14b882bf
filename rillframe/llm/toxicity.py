"""Toxicity scoring with subword embeddings averaged into a linear softmax.

A word is the average of the embeddings of its hashed character n-grams (three to six characters, with its borders), and a linear
softmax over that average gives its two class scores. Embeddings and softmax are trained jointly in numpy. Only whole documents carry labels, and one
insult among hundreds of clean words would vanish in an average over all of them, so a document scores as its most toxic word, in
training too; with `pool="mean"` it scores as the average of its words. Misspellings that training never saw share most n-grams with the words it saw.

A word is a run of letters and digits, in lower case. Training reads about `per_class` documents of each label, chosen by a
hash of id and text, and of these as many as have WORDS_PER_CLASS distinct words together. Null texts and texts without words score as the model's base rate does. Repeated rows give repeated results, rows without a
label or an id aren't learned from, and with labels of one class or none at all every score is that class's share (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.llm.common import code_points, frugal, slices

BUCKET_BITS = 17
SIZES = (3, 4, 5, 6)
#: Training documents of each label, about.
PER_CLASS = 4000
#: Distinct words of the texts of a label, summed over its texts, that training takes: what the driver holds doesn't follow the texts' lengths.
WORDS_PER_CLASS = 2_000_000
#: Distinct words whose n-grams training widens to 64 bits at a time.
WORDS_AT_ONCE = 20_000


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter or digit, or a space for all others."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@dataclass
class Grams:
    """Words of several texts: for each word its text, and for each n-gram its word and bucket."""

    text: np.ndarray
    word: np.ndarray
    bucket: np.ndarray


def grams(raw: np.ndarray, offsets: np.ndarray) -> Grams:
    n = len(offsets) - 1
    points, offsets = code_points(raw, offsets)
    x = np.full(len(points) + n + 1, 32, dtype=np.uint32)  # a space before each text and at the end
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    x[np.arange(len(points)) + owner + 1] = _folded()[points]
    inner = x != 32
    keep = inner.copy()
    keep[1:] |= inner[:-1]
    keep[:-1] |= inner[1:]
    first = inner & ~np.concatenate([[False], inner[:-1]])
    bounds = offsets[:-1] + np.arange(n)  # where each text's space stands
    text = (np.searchsorted(bounds, np.flatnonzero(first), side="right") - 1).astype(np.int32)
    # word k owns its letters and the space after it; the space before it belongs to its n-grams too
    number = np.cumsum(first).astype(np.int32) - 1
    x, inner, number = x[keep], inner[keep], number[keep]
    words, buckets = [], []
    for size in SIZES:
        m = len(x) - size + 1
        if m <= 0:
            break
        h = np.full(m, size * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
        ok = np.ones(m, dtype=bool)
        for k in range(size):
            h = (h ^ x[k : m + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if 0 < k < size - 1:
                ok &= inner[k : m + k]
        words.append(number[1 : m + 1][ok])
        buckets.append((h[ok] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))
    none = np.zeros(0, np.int32)
    return Grams(text, np.concatenate(words) if words else none, np.concatenate(buckets) if buckets else none)


@dataclass
class Model:
    #: For each bucket, embedding times the difference of the softmax's two rows.
    weight: np.ndarray
    bias: float
    fixed: float | None = None
    pool: str = "top"

    def words(self, g: Grams) -> np.ndarray:
        """Log-odds of each word."""
        n = len(g.text)
        size = np.bincount(g.word, minlength=n)
        return np.bincount(g.word, weights=self.weight[g.bucket], minlength=n) / np.maximum(size, 1) + self.bias

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.fixed is not None:
            return np.full(n, self.fixed)
        g = grams(raw, offsets)
        best = np.full(n, self.bias)
        if self.pool == "mean":
            count = np.bincount(g.text, minlength=n)
            best = np.where(count, np.bincount(g.text, weights=self.words(g), minlength=n) / np.maximum(count, 1), best)
        else:
            np.maximum.at(best, g.text, self.words(g))
        return 1 / (1 + np.exp(-best))


def _by_word(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, word by word, and each one's word."""
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for low in range(0, len(words), WORDS_AT_ONCE):
        some = words[low : low + WORDS_AT_ONCE]
        g = grams(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in some])]).astype(np.int64))
        owner = g.text[g.word] if len(g.text) else g.word
        order = np.argsort(owner, kind="stable")
        buckets.append(g.bucket[order].astype(np.int32))
        owners.append((owner[order] + low).astype(np.int32))
    return np.concatenate(buckets), np.concatenate(owners)


def train(texts: list[bytes], labels: np.ndarray, dims: int = 8, rounds: int = 120, rate: float = 0.05, decay: float = 1e-5, seed: int = 7, pool: str = "top") -> Model:
    """Full-batch Adam on the cross-entropy of each text's most toxic word.

    At first all words of a text share its label; the share of a word then sharpens with its own score, until in the last third of
    the rounds the top word alone counts. Otherwise rare words of toxic texts would be learned before the ones that such texts share.
    """
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.float32), 0.0, float(labels[0]) if len(labels) else 0.0)
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in text.split()] for text in texts]
    n_words, bucket, owner = len(number), *_by_word(list(number))
    del number
    edges = np.searchsorted(owner, np.arange(0, n_words + WORDS_AT_ONCE, WORDS_AT_ONCE))
    parts = [(k * WORDS_AT_ONCE, min((k + 1) * WORDS_AT_ONCE, n_words), slice(edges[k], edges[k + 1])) for k in range(len(edges) - 1)]
    size = np.ones(n_words, dtype=np.float32)
    for low, high, at in parts:
        size[low:high] = np.maximum(np.bincount(owner[at] - low, minlength=high - low), 1)
    per_text = np.array([len(w) for w in words])
    used = per_text > 0
    y = labels[used].astype(np.float32)
    word = np.fromiter((i for w in words for i in w), dtype=np.int32, count=int(per_text.sum()))
    del words
    text_at = np.concatenate([[0], np.cumsum(per_text[used])])[:-1]
    which = np.repeat(np.arange(len(text_at), dtype=np.int32), per_text[used])
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (1 << BUCKET_BITS, dims)).astype(np.float32)
    w = rng.normal(0, 0.5, (2, dims)).astype(np.float32)
    b = np.array([1.0, -1.0], dtype=np.float32)
    params = [e, w, b]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        d = w[1] - w[0]
        u = e @ d
        logit = np.empty(n_words, dtype=np.float32)
        for low, high, at in parts:
            logit[low:high] = np.bincount(owner[at] - low, weights=u[bucket[at]], minlength=high - low)
        logit = (logit / size)[word]
        top = np.maximum.reduceat(logit, text_at)
        if pool == "mean":
            a = np.ones(len(logit), dtype=np.float32)
        elif 3 * step <= 2 * rounds:
            a = np.exp(np.minimum(12.0 * step / rounds, 8.0) * (logit - top[which]))
        else:
            a = (logit == top[which]).astype(np.float32)
        a /= np.add.reduceat(a, text_at)[which]
        p = 1 / (1 + np.exp(-(np.add.reduceat(a * logit, text_at) + b[1] - b[0])))
        g = (p - y) / len(y)
        # through the words' shares to their n-grams
        share = np.bincount(word, weights=a * g[which], minlength=n_words) / size
        sums = np.zeros(len(e))
        for _, _, at in parts:
            np.add.at(sums, bucket[at], share[owner[at]])
        sums = sums.astype(np.float32)
        grad_d = sums @ e
        for k, grad in enumerate((np.outer(sums, d) + decay * e, np.stack([-grad_d, grad_d]) + decay * w, np.array([-g.sum(), g.sum()]))):
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.001 * (grad * grad - v[k])
            params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]), pool=pool)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, pool: str = "top") -> Model:
    """Learns from the labelled rows where `learn`, a condition on the id, holds."""
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = {r["label"]: r["count"] for r in rows.select("id").join(known, "id").groupBy("label").count().collect()}
    if not sizes:
        return train([], np.zeros(0, int))
    # by id and text, and each such pair once: neither one id on many rows nor a row that is repeated often makes the sample large
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("share", share)
    rates = {k: per_class / n for k, n in sizes.items()}
    rate = F.when(F.col("label") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    # ids and shares meet the labels; about per_class of each come back to the table, whose other texts don't move
    few = rows.where(F.col("share") < max(rates.values())).select("id", "share").join(known, "id").where(F.col("share") < rate).distinct()
    chosen = rows.join(F.broadcast(few), ["id", "share"]).distinct()
    words = chosen.select("id", "label", "share", _distinct_words("text").alias("words"))
    so_far = F.sum(F.size(F.split("words", " "))).over(Window.partitionBy("label").orderBy("share", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = words.withColumn("so_far", so_far).where(F.col("so_far") <= WORDS_PER_CLASS).select("id", "label", "words").collect()
    got.sort(key=lambda r: (r["id"], r["words"], r["label"]))
    return train([r["words"].encode() for r in got], np.array([r["label"] for r in got]), pool=pool)


def _distinct_words(column: str) -> Column:
    """The distinct words of a text, which is all that training needs."""
    return F.array_join(F.array_distinct(F.split(F.lower(column), r"[^\p{L}\p{N}]+")), " ")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column toxicity (0 to 1; one of that name is replaced)."""
    sent = frugal(docs.sparkSession).sparkContext.broadcast(model)
    kept = docs.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, end, raw, offsets in slices(batch, text_col):
                out[first:end] = sent.value.scores(raw, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, toxicity double")
