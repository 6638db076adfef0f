"""Corpus preparation: five stages over ``documents``, each on all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``documents``.

In every stage each row is a document, also when ids repeat or are null; null ids rank behind all others; an empty table gives an
empty result; texts are whole, whatever their length; further columns, whatever their names, stay with their rows.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm import exact_dedup, language_id, near_dedup, packing, queries, store, suffix_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or without a letter, or that no known language explains."""
    fitted = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    return language_id.identify(docs, fitted, carry=True).where(~F.col("rejected")).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered; null is empty) the row with the largest id stays, one only if ids repeat."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at similarity 0.8 or more the row with the smallest id stays, one only if ids repeat.

    Texts without words are linked with nothing and stay.
    """
    return near_dedup.keep_one(docs, shingle=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte passages that a document of a smaller id has, whole characters only; drops documents of which nothing is left.

    Rows of one id take nothing from each other; a null text stays null.
    """
    others = docs.drop("text")
    extra = F.to_json(F.struct(F.col("text").isNull().alias("none"), F.struct(*[F.col(f"`{c}`") for c in others.columns]).alias("of")))
    cut = suffix_dedup.remove_repeats(docs, window=50, extra=extra, whole_characters=True)
    shorter = F.size("spans") > 0
    text = F.when(F.col("extra_of.none"), F.lit(None)).otherwise(F.col("kept").cast("string"))
    kind = T.StructType([T.StructField("none", T.BooleanType()), T.StructField("of", others.schema)])
    cut = cut.withColumn("extra_of", F.from_json("extra", kind))
    cut = cut.select("extra_of.of", text.alias("left"), shorter.alias("shorter"))
    cut = cut.where(~(F.col("shorter") & (F.trim("left") == "")))

    def column(name: str):
        if name == "text":
            return F.col("left").alias(name)
        own = F.col(f"of.`{name}`")
        return (F.when(F.col("shorter"), F.length("left").cast("long")).otherwise(own) if name == "n_chars" else own).alias(name)

    return cut.select(*[column(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of at most 2048; a null or empty text is the end id alone."""
    pieces = packing.cut_pieces(docs, queries.vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)
    out = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _stage(f):
    """A stage whose own tables go when the next one starts: by then its result has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.release(spark, "pipeline")
        with store.group("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _stage(identify_language)),
    ("exact copies", _stage(drop_exact_copies)),
    ("near copies", _stage(drop_near_copies)),
    ("repeats", _stage(cut_repeats)),
    ("packing", _stage(pack)),
]
#: Language identification, MinHash and the packing search have no SQL form; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else store.materialize(out, f"stage{i}")
    return docs
