"""Exact deduplication by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition is a run of digests, which sort aggregation brings in order of digest with one row for each.  Runs then meet in
binomial rounds: a round merges ``fan_in`` neighbouring runs on (digest, group of runs),
and each digest keeps its copy count and the verified row that stays.
The number of rounds follows the logarithm of the number of runs, and a very
common digest is one row per run, so no task sees more than ``fan_in`` partial rows of
it in a round.  The answer goes back the same way: to the groups of runs of the first round that have the digest, then
to their rows, so the copies of one text, however many, are spread over as many keys as they have groups.

Verified: texts count as equal when their SHA-256 digests are equal; every merge also compares byte length and a second, independent
64-bit hash, and a digest met with two of either stops the job.

Defined cases: a null text is the empty text; of rows repeated with one
``doc_id`` and text exactly one stays; a null ``doc_id`` stays only in a group without other
ids; a very long text is one row like any other; an empty table gives an empty result; other columns are ignored, whatever their names, and stay
with the rows that :func:`keep_one` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """Text with A-Z lowered (no other character changes); null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def runs(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """One row per document: doc_id, tag (unique), norm digest, byte length, run number."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"), *row)
    return base.select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("tag"),
        *(["row"] if carry else []),
    )


def _best(id_col: Column, tag: Column, keep: str) -> Column:
    """Orders rows so that the maximum is the one that stays."""
    order = id_col if keep == "last" else -id_col
    return F.struct(id_col.isNotNull().alias("known"), order.alias("rank"), id_col.alias("id"), (-tag).alias("tag"))


def merged(level: DataFrame, *keys: Column) -> DataFrame:
    """Rows of ``level`` with equal keys as one."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("n_bytes", "check") for n, f in (("least", F.min), ("most", F.max))]
    out = level.groupBy("digest", *keys).agg(F.max("best").alias("best"), F.sum("size").alias("size"), *ends)
    same = (F.col("least_n_bytes") == F.col("most_n_bytes")) & (F.col("least_check") == F.col("most_check"))
    size = F.when(same, F.col("size")).otherwise(F.raise_error(F.lit("one digest for different texts")).cast("long"))
    return out.select("digest", *([c for c in out.columns if c == "run"]), "best", size.alias("size"), F.col("least_n_bytes").alias("n_bytes"), F.col("least_check").alias("check"))


def _runs_and_best(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The written runs, and for every digest of two rows or more (``of``) and group of runs (``at``) its staying row and size."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    table = store.materialize(runs(docs, id_col, text_col, carry), "digests").withColumn("run", F.floor(F.shiftright("tag", 33) / fan_in))
    n = (table.agg(F.max("run")).first()[0] or 0) + 1
    one = F.lit(1).cast("long").alias("size")
    first = merged(table.select("digest", "run", _best(F.col("doc_id"), F.col("tag"), keep).alias("best"), one, "n_bytes", "check"), F.col("run"))
    first = store.materialize(first, "merged")
    level = first
    while n > fan_in:
        n = -(-n // fan_in)
        level = merged(level, F.floor(F.col("run") / fan_in).alias("run"))
    best = merged(level).where(F.col("size") > 1).select(F.col("digest").alias("of"), F.struct("best", "size").alias("answer"))
    back = first.join(best, F.col("digest") == F.col("of")).select("of", F.col("run").alias("at"), "answer.best", "answer.size")
    return table, store.materialize(back, "survivors")


def _here() -> Column:
    return (F.col("digest") == F.col("of")) & (F.col("run") == F.col("at"))


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "last", fan_in: int = 16
) -> DataFrame:
    """One row per input row: doc_id, digest, n_bytes, keep_id, group_size, kept.

    ``keep`` says whether the largest id (``last``) or the smallest (``first``) of equal texts stays.
    """
    table, best = _runs_and_best(docs, id_col, text_col, keep, fan_in, False)
    joined = table.join(best, _here(), "left")
    alone = F.col("of").isNull()
    return joined.select(
        "doc_id",
        "digest",
        "n_bytes",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("tag") == -F.col("best.tag"))).alias("kept"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "last", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    table, best = _runs_and_best(docs, id_col, text_col, keep, fan_in, True)
    dropped = table.select("digest", "tag", "run").join(best, _here()).where(F.col("tag") != -F.col("best.tag"))
    return store.without(table, dropped.select("tag"), "tag").select("row.*")
