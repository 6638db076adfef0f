"""BPE, packing and chat formatting."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.llm import bpe, chat_format, packing, queries

VOCAB = queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab -'\n1é漢🙂<|endoftext|>", max_size=60))
def test_ids_and_text_as_the_library(text):
    from tokenizers import Tokenizer

    own, lib = bpe.codec(VOCAB), test_ids_and_text_as_the_library.__dict__.setdefault("lib", Tokenizer.from_file(VOCAB))
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int32)) == lib.decode(ids, skip_special_tokens=False)


def test_long_runs_and_added_tokens(library):
    for text in ("a" * 5000, " " * 3000, "-" * 777 + "<|endoftext|><|endoftext|>x", "ñ" * 999, "<|endoftext"):
        assert bpe.codec(VOCAB).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


SPECIAL = [(1, None, "x"), (2, "", "x"), (3, "Hello world" * 3, "x"), (3, "Hello world" * 3, "x"), (None, "no id", None), (5, "long " * 60000, "y")]


def docs(spark, rows=SPECIAL):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_encode_decode_cases(spark):
    got = bpe.encode_decode(docs(spark), VOCAB).collect()
    assert len(got) == len(SPECIAL)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["ids"] == [] and by[2]["decoded"] == "" and by[5]["decoded"] == "long " * 60000 and by[None]["decoded"] == "no id"
    assert bpe.encode_decode(docs(spark, []), VOCAB).count() == 0


def _check_packing(rows, capacity):
    own: dict = {}
    for r in rows:
        own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in own.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(own)


def test_pieces_and_packing(spark):
    pieces = packing.cut_pieces(docs(spark), VOCAB, capacity=64)
    got = pieces.orderBy("doc_id", "piece").collect()
    long = [r for r in got if r["doc_id"] == 5]
    n = len(bpe.codec(VOCAB).encode("long " * 60000)) + 1
    assert sum(r["length"] for r in long) == n and all(r["length"] == 64 for r in long[1:]) and [r["start"] for r in long] == [0, *range(n % 64 or 64, n, 64)]
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in long])
    assert ids[-1] == 0 and ids[:-1].tolist() == bpe.codec(VOCAB).encode("long " * 60000).tolist()
    packed = packing.pack(pieces.drop("ids"), capacity=64, shard=16).collect()
    assert len(packed) == len(got)
    _check_packing(packed, 64)
    assert packing.pack(packing.cut_pieces(docs(spark, []), VOCAB)).count() == 0


def test_pieces_as_the_library(spark, library):
    """Ids, places and checksums of whole texts, a million blanks, line ends and letters among them."""
    rows = [*SPECIAL, (6, " " * 1_000_000, "x"), (7, "\n" * 1_000_000, "x"), (8, "a" * 1_000_000, "x"), (9, "x \n\n y<|endoftext|> é漢", "x")]
    got = packing.cut_pieces(docs(spark, rows), VOCAB).withColumn("crc", F.crc32("ids")).drop("ids").collect()
    own: dict = {}
    for r in got:
        own.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["crc"]))
    for i, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
        assert sorted(set(own[i])) == want, i


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab -'\n\t1é漢🙂<|endoftext|>", max_size=60))
def test_packed_ids_as_the_library(text):
    from tokenizers import Tokenizer

    lib = test_packed_ids_as_the_library.__dict__.setdefault("lib", Tokenizer.from_file(VOCAB))
    assert packing.encoder(VOCAB)(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_search_beats_best_fit():
    """Fewer bins than largest-first best fit wherever that is above the bound, and none below the bound."""
    rng = np.random.default_rng(0)
    shards = [rng.integers(200, 1000, 1000), rng.integers(400, 900, 500), rng.integers(520, 1000, 600), np.minimum(2047, rng.lognormal(6.2, 0.8, 1000).astype(int) + 1)]
    for sizes in shards:
        p = packing.Packer(sizes, 2048, 1)
        plain = -p.fitness(p.best_fit(np.full(len(sizes), -1, np.int64), p.by_size))[0]
        found = p.evolve(p.start(8), 24, 8)[0]
        assert p.fill(found).max() <= 2048 and (found >= 0).all()
        assert p.least <= -p.fitness(found)[0] and (-p.fitness(found)[0] < plain or plain == p.least)


def test_packing_is_nearly_full(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([rnd.randint(1, 100), rnd.randint(100, 999)])) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, length long"), capacity=1000, shard=500).collect()
    bins = _check_packing(got, 1000)
    assert bins <= -(-sum(s for _, s in sizes) // 1000) + 3 and len(got) == 3000


def test_packer_against_exhaustive_search():
    rnd = random.Random(2)
    for _ in range(8):
        sizes = np.array([rnd.randint(2, 9) for _ in range(6)])
        best = min(len(set(a)) for a in itertools.product(range(6), repeat=6) if all(sizes[[i for i in range(6) if a[i] == b]].sum() <= 12 for b in set(a)))
        p = packing.Packer(sizes, 12, 0)
        assert -p.fitness(p.evolve(p.start(6), 200, 6)[0])[0] == best


# ---- chats


def _brute(roles, costs, limit=2):
    """Least total cost over all ways to label, merge and insert."""
    r = chat_format.Repair(costs)
    best = None

    def go(i, state, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(roles):
            best = cost if best is None else min(best, cost)
            return
        for to in (1, 2, 3):
            label = 0 if to == roles[i] else costs.name if roles[i] == 0 else costs.relabel
            if to == state:
                go(i + 1, to, cost + label + costs.merge)
            for n in range(limit + 1):
                for path in itertools.product((1, 2, 3), repeat=n):
                    seq = (state, *path, to)
                    if all(b in chat_format._NEXT[a] for a, b in zip(seq, seq[1:], strict=False)):
                        go(i + 1, to, cost + label + costs.insert * n)

    go(0, 0, 0)
    assert r is not None
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=6))
def test_repair_has_least_cost(roles):
    costs = chat_format.Costs()
    ways = chat_format.Repair(costs).solve(roles)
    assert sum(w[1] for w in ways) == _brute(roles, costs)
    state = 0
    for to, _, action, inserted in ways:
        assert action == "merge" and to == state or all(b in chat_format._NEXT[a] for a, b in itertools.pairwise((state, *inserted, to)))
        state = to


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 7))
def test_borders_do_not_change_the_repair(roles, size):
    """Chunks joined by their matrices give the very turns that the whole conversation gives."""
    import pyarrow as pa

    r = chat_format.Repair(chat_format.Costs())
    parts = [roles[i : i + size] for i in range(0, len(roles), size)]
    table = pa.table({"conv_id": [1] * len(parts), "chunk": list(range(len(parts))), "costs": [r.matrix(p) for p in parts]})
    at = chat_format._borders(table).to_pylist()
    assert [w for p, b in zip(parts, at, strict=True) for w in r.solve(p, b["entry"], b["leave"])] == r.solve(roles)


def test_chats_in_any_chunks(spark):
    rnd = random.Random(4)
    names = ["system", "user", "assistant", "USER ", None, "tool"]
    rows = [(c, t, rnd.choice(names), rnd.choice([None, "", "hi <|im_start|>", "text " * 50]), "x") for c in [1, 2, 3, None] for t in range(rnd.randint(1, 40))]
    rows += [(9, t, ["user", "assistant"][t % 2], f"t{t}", "x") for t in range(300)] + [(7, 0, "user", "same", "x")] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    whole = chat_format.repair_chats(df, chunk_bits=12).collect()
    cut = chat_format.repair_chats(df, chunk_bits=3).collect()
    assert len(whole) == len(cut) == len(rows)
    plain = lambda got: sorted(map(repr, (r.asDict() | {"pos": 0} for r in got)))
    assert plain(whole) == plain(cut) == plain(chat_format.repair_chats(df.repartition(7), chunk_bits=2).collect())
    for got in (whole, cut):
        for c in (1, 2, 3, None, 9, 7):
            text = "".join(r["fragment"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["pos"]))
            turns = text.split("<|im_start|>")[1:]
            state = 0
            for t in turns:
                role, body = t.split("\n", 1)
                assert body.endswith("<|im_end|>\n") and body.count("<|im_") == 1
                to = chat_format.ROLES.index(role) + 1
                assert to in chat_format._NEXT[state]
                state = to
    assert all(r["action"] == "keep" and r["cost"] == 0 for r in whole if r["conv_id"] == 9)
    assert [r["action"] for r in whole if r["conv_id"] == 7].count("merge") == 4
    assert chat_format.repair_chats(df.where("false")).count() == 0
