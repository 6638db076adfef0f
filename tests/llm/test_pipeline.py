"""The corpus pipeline against a plain version of its stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from routeloom.llm import bpe, queries
from tests.llm.test_dedup import brute_components, brute_repeats, corpus, norm


def whole(text, spans):
    """The text without the characters that lie wholly in a span of its bytes."""
    out, at = "", 0
    for c in text:
        end = at + len(c.encode())
        if not any(a <= at and end <= b for a, b in spans):
            out += c
        at = end
    return out


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in corpus(11, 90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


def test_against_plain_stages(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(folder))
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    rows = [(i, t) for i, t in rows if t is not None and any(c.isalpha() for c in t)]
    assert kept <= {i for i, _ in rows} and len(kept) >= len(rows) - 2
    rows = sorted((i, t) for i, t in rows if i in kept)
    groups: dict = {}
    for i, t in rows:
        groups[norm(t)] = max(i, groups.get(norm(t), i))
    rows = [(i, t) for i, t in rows if groups[norm(t)] == i]
    _, component = brute_components(rows, 5)
    rows = [(i, t) for i, t in rows if component[i] == i]
    cut = brute_repeats(rows, 50)
    rows = [(i, whole(t, cut[i][1])) for i, t in rows]
    rows = [(i, t) for i, t in rows if t.strip(" ") or not cut[i][1]]
    codec = bpe.codec(queries.vocabulary("byte_bpe_50k.json"))
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(folder)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(codec.encode(t)) + 1 for i, t in rows}


def test_middle_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(folder))
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()


def test_null_ids_clashing_columns_and_long_texts(spark):
    """Rows with names that stages use inside, null ids, repeated rows, nulls and a long text go through every stage."""
    base = " ".join(f"word{i}" for i in range(40))
    texts = [(1, base), (1, base), (None, base), (2, None), (3, ""), (4, "12 34"), (5, "x " + "é" * 100), (6, "yx " + "é" * 100), (7, base + " tail"), (8, "lang word " * 60_000)]
    names = "doc_id long, text string, lang string, source string, n_chars long, node long, digest string, tag long, row string, key long, kept boolean"
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), 1, "d", 2, "r", 3, True) for i, t in texts], names)
    results = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes
        results.append(out.collect())
        assert all(r["digest"] == "d" and r["key"] == 3 for r in results[-1])
    language, exact, near, cut = ([(r["doc_id"], r["text"]) for r in rows] for rows in results)
    assert not {2, 3, 4} & {i for i, _ in language}
    assert sorted(i or 0 for i, _ in exact) == [1, 2, 4, 5, 6, 7, 8] or sorted(i or 0 for i, _ in exact) == [1, 3, 4, 5, 6, 7, 8]
    assert sorted(i or 0 for i, _ in near) == [1, 2, 3, 4, 5, 6, 8]
    left = dict((i, t) for i, t in cut)
    assert sum(i == 1 for i, _ in cut) == 2 and None not in left and left[2] is None and left[3] == ""
    assert left[6] == "yx" or left[6] == "yx é" or left[6] == "y" and "\ufffd" not in left[6]
    assert sum(r["length"] for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()) > 120_000


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
