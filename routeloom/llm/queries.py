"""The registered queries of the operators in this subpackage, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import bpe

    out = bpe.encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import chat_format

    out = chat_format.repair_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select(
        "conv_id", "turn", "role", "repaired_role", "action", F.size("inserted").cast("long").alias("n_inserted"), "cost",
        F.sha2("fragment", 256).alias("fragment_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import exact_dedup

    out = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import near_dedup

    out = near_dedup.near_groups(documents(spark, sf_dir), shingle=2, threshold=0.8)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import quality_rules

    vocabularies = [vocabulary(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    out = quality_rules.judge(documents(spark, sf_dir), vocabularies)
    measures = [F.col("fertility")[k][c].alias(f"{c}_{k + 1}") for k in range(2) for c in ("n_tokens", "byte_tokens", "entropy")]
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *measures
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import suffix_dedup

    out = suffix_dedup.remove_repeats(documents(spark, sf_dir), window=50)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def crc(column: str = "doc_id"):
    """crc32 of an id as decimal text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import language_model

    out, total = language_model.score_texts(documents(spark, sf_dir), divisor=10, held_out=0)
    return out.select(
        "doc_id", (crc() % 10 == 0).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import quality_classifier

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_classifier.fit(docs, labels, crc() % 5 != 0)
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", (crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import packing

    pieces = packing.cut_pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)
    out = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm import language_id

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    fitted = language_id.fit(docs, crc() % 3 != 1)
    out = language_id.identify(docs.select("doc_id", "text"), fitted)
    return out.select("doc_id", (crc() % 3 == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_chat_format, op3_exact_dedup, op4_suffix_dedup, op5_near_dedup, op6_quality_rules, op7_lm_scoring, op8_quality_classifier, op9_packing, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL}
