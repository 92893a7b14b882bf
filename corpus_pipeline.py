"""A corpus in five stages: language, near copies, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm import jaccard_join, language_id, mixing, pii, sentencepiece_bpe
from rillframe.llm.common import bit_filter, dropped, in_filter, row_key, table, written
from rillframe.llm.queries import SURROGATE_KEY, fold, tokenizer_path


def _aside(docs: DataFrame, *own: str) -> DataFrame:
    """docs with all columns but the named ones called by their place, so that none clashes with what an operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in own else f"_own_{i}") for i, c in enumerate(docs.columns)])


def _back(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of docs from what came of _aside()."""
    return df.select(*[F.col(c if c in own else f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no learned language is near; fills in languages that are missing."""
    own = ("doc_id", "text", "lang")
    rows = _aside(docs, *own)
    got = language_id.predict(rows, language_id.fit(rows, fold(3) != 1)).where("not lang_rejected")
    return _back(got.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, *own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest id (null ids last), of unlike texts with that id the one that jaccard_join puts
    first, of rows with equal id and text the one whose other columns have the least hash. Rows without words stay.
    """
    own = ("doc_id", "text")
    rows = _aside(docs, *own).withColumn("_key", row_key(F.col("doc_id").cast("long"), "text"))
    found = jaccard_join.groups(docs.select(*own)).where("n > 0")
    known = written(found.groupBy("key", "id").agg(F.count("*").alias("c"), F.first("first").alias("first")).where("c > 1 or not first"), "copies")
    maybe = rows.withColumn("_maybe", in_filter(spark, bit_filter(known, "key"), "_key"))
    of = (F.col("_key") == F.col("key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("id"))
    met = maybe.where("_maybe").join(known, of, "left").where("first is null or first")
    others = [c for c in rows.columns if c not in ("_key", *own)]
    once = met.where("c > 1").groupBy("_key", *own).agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_others")) if others else met.where("c > 1").select("_key", *own).distinct()
    once = once.select(*own, "_others.*") if others else once
    stay = maybe.where("not _maybe").select(*own, *others).unionByName(met.where("c is null or c = 1").select(*own, *others)).unionByName(once.select(*own, *others))
    return _back(stay, docs, *own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars, if there is such a column, follows the text."""
    own = ("text", "n_chars")
    got = pii.replace(_aside(docs, *own), SURROGATE_KEY)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _back(got, docs, *own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that their tokens meet the targets of sources, languages and topics."""
    own = ("doc_id", "text", "source", "lang")
    rows = mixing.counted(_aside(docs, *own), mixing.topic_of(F.col("text")))
    return _back(mixing.weigh(rows).where("stays"), docs, *own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their digests."""
    return sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: Several stages can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if number:
            dropped(spark, before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
