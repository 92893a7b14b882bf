"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm import embedding_dedup, fingerprints, html_extraction, jaccard_join, language_id, mixing, pii, sentencepiece_bpe, substring_dedup, toxicity
from rillframe.llm.common import table, written


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    spec = find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / name)


def fold(of: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold(3) != 1)
    got = language_id.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: The key of the registered query's surrogates; a deployment passes its own.
SURROGATE_KEY = "rillframe"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    got = toxicity.score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embedding_dedup.link(table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Share of the tokens that op9 aims at, and its rounds: fixed ones, so that SQL can follow.
MIX_SHARE, MIX_ROUNDS = 0.4, 30


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = mixing.weigh(written(mixing.counted(docs, mixing.topic_of(F.col("text"))).drop("text"), "counted"), share=MIX_SHARE, rounds=MIX_ROUNDS)
    named = [F.coalesce(d, F.lit("")).alias(d) for d in ("source", "lang", "topic")]
    return got.select("doc_id", *named, "n_tokens", F.round("weight", 6).alias("weight"), F.round("chance", 6).alias("chance"), "stays")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_language_id": op2_language_id, "op3_substring_dedup": op3_substring_dedup, "op4_html_extraction": op4_html_extraction, "op5_pii": op5_pii, "op6_toxicity": op6_toxicity, "op7_jaccard_join": op7_jaccard_join, "op8_embedding_dedup": op8_embedding_dedup, "op9_mixing": op9_mixing, "op10_sentencepiece": op10_sentencepiece}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.oracle_sql(MIX_SHARE, MIX_ROUNDS)}
