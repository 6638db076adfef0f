"""Exact, near and passage deduplication against brute force."""

from __future__ import annotations

import gc
import hashlib
import random
import re

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from routeloom.llm import blocks, exact_dedup, kernels, language_id, near_dedup, store, suffix_dedup

WORDS = [f"w{i}" for i in range(60)]
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=120):
    """Random texts with copies, near copies, shared passages, empties and repeated rows."""
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    passage, base = text(20), text(60).split()
    rows = []
    for i in range(n):
        kind = rnd.randint(0, 7)
        if kind == 0 and rows:
            t = rnd.choice(rows)[1]
        elif kind == 1:
            t = " ".join(w if rnd.random() > 0.06 else rnd.choice(WORDS) for w in base)
        elif kind == 2:
            t = text(rnd.randint(1, 30)) + " " + passage + " " + text(rnd.randint(0, 9))
        else:
            t = text(rnd.randint(1, 80))
        rows.append((i, t.upper() if rnd.random() < 0.1 else t))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "é" * 60), (n + 6, "x" + "é" * 60)]


def frame(spark, rows, parts=6):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, node int")
    return df.repartition(parts)


def norm(t):
    return (t or "").encode().translate(FOLD)


def test_exact_groups(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, rows, 7), fan_in=2).collect()}
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for i, t in rows:
        own = groups[norm(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) == (max(own), len(own), i == max(own), hashlib.sha256(norm(t)).digest())
    first = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(frame(spark, rows), keep="first").collect()}
    assert all(first[i] == min(groups[norm(t)]) for i, t in rows)


def test_exact_repeated_rows_null_ids_and_empty(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "B")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 2
    for broadcast in (0, 100):
        monkeypatch.setattr(store, "_BROADCAST_ROWS", broadcast)
        kept = exact_dedup.keep_one(frame(spark, rows)).collect()
        assert sorted((r["text"].lower(), r["doc_id"]) for r in kept) == [("a", 1), ("b", None)] and all(r["digest"] == "clash" for r in kept)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_repeats(rows, w):
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - w + 1):
            k = b[p : p + w]
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - w + 1):
            if first[b[p : p + w]] < i:
                gone[p : p + w] = b"\1" * w
        spans, k = [], 0
        while k < len(b):
            if gone[k]:
                e = k
                while e < len(b) and gone[e]:
                    e += 1
                spans.append((k, e))
                k = e
            else:
                k += 1
        out[i] = (len(b), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block", [400, 1 << 21])
def test_passages(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    rows = [*corpus(3), (500, "ab" * 300), (501, "z" + "ab" * 200), (502, "q" * 49), (503, "q" * 50), (504, "q" * 51), (505, "p " * 400000), (506, "tail " + "p " * 30)]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, rows), window=50).collect()}
    want = brute_repeats(rows, 50)
    for i, _ in rows:
        r = got[i]
        assert (r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) == want[i], i
    assert want[505] == (800000, [], b"p " * 400000) and want[506][1] == [(4, 65)]


def test_passages_special_rows(spark):
    t = "0123456789" * 9
    got = suffix_dedup.remove_repeats(frame(spark, [(1, t), (1, t), (None, t), (2, None)])).collect()
    by = sorted(((r["doc_id"] is None, r["doc_id"] or 0, len(r["kept"])) for r in got))
    assert by == [(False, 1, 90), (False, 1, 90), (False, 2, 0), (True, 0, 0)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_radix_groups():
    import numpy as np

    rng = np.random.default_rng(0)
    digits = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    rows, starts = suffix_dedup.equal_windows(500, 4, lambda at, k: digits[at, k])
    got = {frozenset(map(int, g)) for g in np.split(rows, starts[1:])}
    want: dict = {}
    for i, d in enumerate(digits):
        want.setdefault(tuple(d), set()).add(i)
    assert got == {frozenset(s) for s in want.values() if len(s) > 1}


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", norm(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(spark, monkeypatch, k):
    monkeypatch.setattr(near_dedup, "_TILE", 8)
    rows = corpus(7, 260)
    got = {r["doc_id"]: r for r in near_dedup.near_groups(frame(spark, rows), shingle=k).collect()}
    sets, component = brute_components(rows, k)
    for i, _ in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), component[i], component[i] == i), i


def test_near_fewer_words_than_a_shingle(spark):
    """Also where a whole slab has fewer words than a shingle."""
    for rows, want in (([(1, "one two")], {1: (1, 1)}), ([(1, "one two"), (2, "ONE  two"), (3, "two")], {1: (1, 1), 2: (1, 1), 3: (1, 3)})):
        got = near_dedup.near_groups(frame(spark, rows, 1), shingle=5).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_special_rows(spark):
    t = " ".join(WORDS[:20])
    df = frame(spark, [(1, t), (1, t), (None, t), (2, None), (3, ""), (4, "a"), (5, "A")])
    got = near_dedup.near_groups(df, shingle=5).collect()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [1, 2, 3, 4] and len(got) == 7
    kept = near_dedup.keep_one(df, shingle=5)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4] and kept.dtypes == df.dtypes
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


def thue_morse(n):
    """Two different words of n bytes that any polynomial hash modulo 2**64 takes for one (n at least 1024)."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_near_long_words(spark):
    """Texts that differ only in words of equal polynomial hash are not linked; a very long text is whole."""
    x, y = thue_morse(1024)
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, f"one {x} two"), (2, f"one {y} two"), (3, long), (4, long + " tail"), (5, " " * 1_000_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(frame(spark, rows), shingle=2).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (199_999, 3), 4: (200_000, 3), 5: (0, 5)}


def test_pruning_bound():
    from math import comb

    for i, m in enumerate(near_dedup.least_matches(30, 6, 0.8, 1e-9), 1):
        n = 30 * i
        tail = lambda m, n=n: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))
        assert tail(m) >= 1e-9 and (m == 0 or tail(m - 1) < 1e-9)


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)]
    links = [(a, b) for a, b in links if a != b]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    nodes = {n for link in links for n in link}
    assert set(got) == nodes
    assert {frozenset(n for n in nodes if got[n] == c) for c in set(got.values())} == {frozenset(n for n in nodes if find(n) == c) for c in map(find, nodes)}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_are_united_without_rounds(spark):
    """One task for a small table, whatever the number of shuffle partitions; the same components as by rounds."""
    rnd = random.Random(8)
    links = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(25)] + [(1000 + i, 1001 + i) for i in range(6)] + [(-5, -9), (7, 7)]
    table = spark.createDataFrame(links, "a long, b long").coalesce(1)
    by_rounds = {(r["node"], r["component"]) for r in near_dedup.components(table, few=0).collect()}
    spark.sparkContext.setJobGroup("few links", "")
    try:
        united = near_dedup.components(table)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6
    assert {(r["node"], r["component"]) for r in united.collect()} == by_rounds
    assert (-5, -9) in by_rounds and (1006, 1000) in by_rounds


def test_rows_cross_to_python_with_their_text_once(spark):
    docs = frame(spark, corpus(3, 40))
    fitted = language_id.fit(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    for out in (language_id.identify(docs, fitted, carry=True), near_dedup.features(docs, 5, 36, 5, "doc_id", "text", True)):
        assert "__text" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["doc_id"], r["row"]["text"]): r["lang_pred"] for r in language_id.identify(docs, fitted, carry=True).collect()}
    assert got == {(r["doc_id"], r["text"]): r["lang_pred"] for r in language_id.identify(docs, fitted).join(docs.select(F.col("doc_id").alias("of"), "text"), F.col("doc_id") == F.col("of")).collect()}


def test_a_task_gives_back_its_memory():
    """What a stage needed in a worker is free for the next one, though something small above it is still in use."""
    own, kept = psutil.Process(), []

    def run(batches):
        held = [np.ones(50_000, np.uint8) for _ in range(4_000)]
        kept.append(np.ones(50_000, np.uint8))
        yield own.memory_info().rss
        del held

    gc.collect()
    before = own.memory_info().rss
    (most,) = kernels.lean(run)(iter(()))
    assert most - before > 100e6 and own.memory_info().rss - before < 0.2 * (most - before)


def test_native_column_types(spark):
    out = exact_dedup.exact_dedup(frame(spark, corpus()))
    assert dict(out.dtypes)["group_size"] == "bigint" and out.select(F.max("group_size")).first()[0] >= 1
