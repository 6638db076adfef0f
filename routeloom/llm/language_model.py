"""Language-model scores by deleted interpolation of uniform, unigram, bigram and trigram estimates.

The maximum-likelihood estimates of the orders are mixed with weights that depend on how often the longest known
context was seen (two buckets for every doubling).  The weights are learned by expectation-maximisation on held-out counts:
a tenth of the training texts (by a hash of their id) is counted apart, its tokens are predicted by the counts of the
other nine, and the weights that suit them best then mix the counts of all training texts.  Contexts seen
once use the lower orders only.

Counts cover every training text.  A block sends its distinct words, then its distinct word pairs, then its
distinct triples, to their key ranges, which add up and answer (see ``blocks``); a pair is asked about only where
its context was seen twice, a triple where its context pair was.  Words go by their full 128-bit digest, pairs and
triples by 64-bit hashes made from those digests.  Blocks of held-out texts then say how
many of their tokens fall into each cell of a grid over the logarithms of the estimates; the grid
has a fixed size, whatever the corpus, and is all that the driver gets besides the totals.

A text is its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then an end mark, which counts as a token;
the first word's context is a start mark seen once in every text.

Defined cases: a null or empty text is the end mark alone; every row is a text, also when ids repeat; ids are integers, a null id's
checksum is 0 (which makes it held out in the registered query); without training rows all estimates are
uniform, without held-out texts the weights are equal; a very long text is one row of a block of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm import blocks as B
from routeloom.llm import kernels as K
from routeloom.llm import store

_START, _END = K.U(0x243F6A8885A308D3), K.U(0x13198A2E03707344)
_ODD = K.U(0x9E3779B97F4A7C15)
#: Kinds of blocks: texts to score only, training texts, and training texts held out for the weights.
REST, KEPT, HELD = 0, 1, 2
#: Context buckets of an order; a row of the weights belongs to (order, bucket).
_BUCKETS = 96
_FLOOR = 40


def bucket(c: np.ndarray) -> np.ndarray:
    """Half doublings of a context's count."""
    return np.minimum(_BUCKETS - 1, np.floor(2 * np.log2(np.maximum(c, 1)) + 1e-9).astype(np.int64))


def block_words(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest (two parts) of each word of a block, and its text number."""
    one, two, doc = [np.zeros(0, K.U)], [np.zeros(0, K.U)], [np.zeros(0, np.int64)]
    for lo, _, data, offs in block.chunks():
        low = K.FOLD[data]
        starts, ends, d = K.words(low, offs)
        for to, x in zip((one, two), K.digests(low, starts, ends), strict=True):
            to.append(x)
        doc.append(d + lo)
    return np.concatenate(one), np.concatenate(two), np.concatenate(doc)


def _send(block: B.Block, keys: np.ndarray, check: np.ndarray | None, counts: np.ndarray, n: int) -> pa.RecordBatch | None:
    """Rows (part, block, kind, keys, check, counts) of ascending keys; texts that are only scored count nothing."""
    if not len(keys):
        return None
    at, a, b = B.cut(keys, n)
    rows = [
        (B.pack_keys(keys[x:y]), None if check is None else B.pack(check[x:y]), None if block.kind == REST else B.pack(counts[x:y].astype(np.int32)))
        for x, y in zip(a, b, strict=True)
    ]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
    columns = [at, np.full(len(at), block.number), np.full(len(at), block.kind), *zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block", "kind", "keys", "check", "counts"])


SENT = "part int, block long, kind int, keys binary, check binary, counts binary"


def _words_of(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (both parts, ascending), which of them each word is, and text numbers."""
    one, two, doc = block_words(block)
    first, which = K.classes(one, two)
    return one[first], two[first], which, doc


def _send_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = B.Block(row)
                one, two, which, _ = _words_of(block)
                out = _send(block, one, two, np.bincount(which, minlength=len(one)), n)
                if out is not None:
                    yield out

    return run


def _add(table: pa.Table) -> pa.Table:
    """Counts of each block's keys over all training texts, and to held-out blocks those without held-out texts too.

    Totals stand on the first row: tokens and distinct keys of both kinds of counts.
    """
    kinds = table["kind"].to_pylist()
    keys = [B.unpack_keys(x) for x in table["keys"].to_pylist()]
    parts = [np.concatenate(keys)]
    if table["check"].null_count == 0:
        parts.append(np.concatenate([B.unpack(x, K.U) for x in table["check"].to_pylist()]))
    first, which = K.classes(*parts)
    every, kept = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    ends = np.cumsum([len(k) for k in keys])
    for kind, raw, a, b in zip(kinds, table["counts"].to_pylist(), ends - [len(k) for k in keys], ends, strict=True):
        if kind != REST:
            own = B.unpack(raw, np.int32)
            every[which[a:b]] += own  # the keys of a block are distinct
            if kind == KEPT:
                kept[which[a:b]] += own
    mine = np.split(which, ends[:-1])
    lead = [1, *[0] * (len(keys) - 1)]
    total = {"total": every.sum(), "types": (every > 0).sum(), "kept_total": kept.sum(), "kept_types": (kept > 0).sum()}
    return pa.table({
        "block": table["block"], "part": table["part"], "kind": table["kind"],
        "counts": pa.array([B.pack(every[w].astype(np.uint32)) for w in mine], pa.binary()),
        "kept": pa.array([B.pack(kept[w].astype(np.uint32)) if k == HELD else None for w, k in zip(mine, kinds, strict=True)], pa.binary()),
        **{c: pa.array([int(x) * f for f in lead], pa.int64()) for c, x in total.items()},
    })


ANSWER = "block long, part int, kind int, counts binary, kept binary, total long, types long, kept_total long, kept_types long"


@dataclass(frozen=True)
class Totals:
    """Tokens, distinct tokens and texts that a set of counts covers."""

    tokens: int
    types: int
    texts: int


def _counts(answers: list[dict], order: int, column: str) -> np.ndarray:
    mine = sorted((r for r in answers if r["level"] == order), key=lambda r: r["part"])
    return np.concatenate([np.zeros(0, np.int64), *(B.unpack(r[column], np.uint32).astype(np.int64) for r in mine)])


class Text:
    """The token stream of a block with its counts as far as they are known; ``texts`` is how often the start mark was seen."""

    def __init__(self, block: B.Block, answers: list[dict], texts: int, known: int):
        one, two, which, doc = _words_of(block)
        docs = len(block.ids)
        words = np.bincount(doc, minlength=docs)
        self.edges = np.concatenate(([0], np.cumsum(words + 1)))
        size, at = int(self.edges[-1]), np.arange(len(doc)) + doc
        self.at, self.which, self.size = at, which, size
        token = np.full(size, _END)
        token[at] = K.mix(one ^ K.mix(two + K.U(9)))[which]
        before = np.full(size, _START)
        before[at + 1] = token[at]
        pair = K.mix(token * _ODD + K.mix(before))
        self.begins = np.zeros(size, bool)
        self.begins[self.edges[:-1]] = True
        self.c = [self._words(_counts(answers, 1, "counts"), texts)]
        self.asked: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        gram = pair
        for order in (2, 3)[: known - 1]:
            context = self.context(self.c, order, texts)
            asked = np.flatnonzero((context >= 2) & (self.c[order - 2] >= 1))
            keys, first, place = np.unique(gram[asked], return_index=True, return_inverse=True)
            self.asked.append(asked)
            self.keys.append(keys)
            self.places.append(place)
            if order == known:
                break
            self.c.append(self._grams(order, _counts(answers, order, "counts")))
            last = np.roll(pair, 1)
            gram = K.mix(token * _ODD + K.mix(last ^ _ODD))

    def _words(self, counts: np.ndarray, texts: int) -> np.ndarray:
        out = np.full(self.size, texts, np.int64)
        out[self.at] = counts[self.which]
        return out

    def _grams(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Counts of the grams that end at each token; 0 where none was asked for."""
        out = np.zeros(self.size, np.int64)
        out[self.asked[order - 2]] = counts[self.places[order - 2]]
        return out

    def context(self, c: list[np.ndarray], order: int, texts: int) -> np.ndarray:
        """How often each token's context of ``order - 1`` tokens was seen; a text's first token has the start mark, and no longer one."""
        out = np.roll(c[order - 2], 1)
        out[self.begins] = texts if order == 2 else 0
        return out

    def counts(self, answers: list[dict], column: str, texts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts of the grams of orders 1 to 3, and of the contexts of orders 2 and 3."""
        c = [self._words(_counts(answers, 1, column), texts), *(self._grams(o, _counts(answers, o, column)) for o in (2, 3))]
        return c, [self.context(c, o, texts) for o in (2, 3)]


def estimates(c: list[np.ndarray], context: list[np.ndarray], t: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (orders 0 to 3 by rows) of each token, and the row of weights that mixes them."""
    p = np.zeros((4, len(c[0])))
    p[0] = 1 / (t.types + 1)
    p[1] = c[0] / max(1, t.tokens)
    row = np.zeros(len(c[0]), np.int64)
    for order in (2, 3):
        seen = context[order - 2] >= 2
        p[order, seen] = np.minimum(1.0, c[order - 1][seen] / context[order - 2][seen])
        row[seen] = (order - 1) * _BUCKETS + bucket(context[order - 2][seen])
    return p, row


def _cells(t: Totals):
    def apply(block: B.Block, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        """Tokens of a held-out block by weight row and quantised estimates, with the sums of the estimates."""
        if block.kind != HELD or not len(block.ids):
            return
        text = Text(block, answers, _texts(answers), 3)
        p, row = estimates(*text.counts(answers, "kept", t.texts), t)
        key = row
        for q in p[1:]:
            key = key * 64 + np.where(q > 0, np.minimum(_FLOOR, np.floor(-np.log2(np.maximum(q, 1e-300))).astype(np.int64)), 63)
        cells, which = np.unique(key, return_inverse=True)
        columns = [pa.array(cells), pa.array(np.bincount(which)), *(pa.array(np.bincount(which, q)) for q in p[1:])]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "s1", "s2", "s3"])

    return apply, "cell long, n long, s1 double, s2 double, s3 double"


def _texts(answers: list[dict]) -> int:
    return answers[0]["texts"] if answers else 0


def learn_weights(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, types: int, steps: int = 80) -> np.ndarray:
    """Weights of orders 0 to 3 for every row by expectation-maximisation; ``sums`` has the estimates of orders 1 to 3 added up."""
    rows, p0 = cells >> 18, 1 / (types + 1)
    p = np.concatenate((np.full((1, len(n)), p0), sums / np.maximum(n, 1)))
    out = np.zeros((3 * _BUCKETS, 4))
    for r in range(len(out)):
        free = np.array([1.0, 1.0, r >= _BUCKETS, r >= 2 * _BUCKETS], float)
        if 2 * _BUCKETS <= r:  # a trigram's context has a bigram estimate too
            free[2] = 1.0
        w = free / free.sum()
        own = rows == r
        if own.any():
            part, weight = p[:, own], n[own].astype(float)
            for _ in range(steps):
                share = part * w[:, None]
                share /= share.sum(0)
                w = (share @ weight + free / free.sum()) / (weight.sum() + 1)
        out[r] = w
    return out


def _score(t: Totals, weights: np.ndarray):
    def apply(block: B.Block, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        text = Text(block, answers, t.texts, 3)
        c, context = text.counts(answers, "counts", t.texts)
        p, row = estimates(c, context, t)
        mixed = (p * weights[row].T).sum(0)
        base = np.log10((c[0] + 0.1) / (t.tokens + 0.1 * (t.types + 1)))
        at = text.edges[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                block.doc_ids(), pa.array(np.diff(text.edges)), pa.array(np.add.reduceat((c[0] > 0).astype(np.int64), at)),
                pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(mixed), at)),
            ],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    return apply, "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _send_grams(n: int, texts: int, order: int):
    def apply(block: B.Block, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        t = Text(block, answers, texts, order)
        out = _send(block, t.keys[-1], None, np.bincount(t.places[-1], minlength=len(t.keys[-1])), n)
        if out is not None:
            yield out

    return apply, SENT


def score_texts(docs: DataFrame, *, divisor: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Scores of every row, and the number of training tokens.

    Learns from rows whose id's crc32 is not ``held_out`` modulo ``divisor``.  Columns: doc_id, n_tokens, n_known,
    base_score (add-0.1 unigrams) and score (this model), both log10 probabilities of the whole text.
    """
    spark = docs.sparkSession
    crc = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0))
    tenth = F.pmod(F.xxhash64(id_col, F.lit("weights")), F.lit(10)) == 0
    kind = F.when(crc % divisor == held_out, REST).when(tenth, HELD).otherwise(KEPT)
    table = B.make_blocks(docs, "texts", id_col, text_col, kind=kind, times=2)  # the larger a block, the fewer of its keys others send too
    texts = {r["kind"]: r["n"] for r in table.groupBy("kind").agg(F.sum("n_docs").alias("n")).collect()}
    kept_texts = texts.get(KEPT, 0)
    all_texts = kept_texts + texts.get(HELD, 0)
    n = B.ranges(table)

    def ask(sent: DataFrame, order: int) -> DataFrame:
        got = store.materialize(sent.groupBy("part").applyInArrow(_add, ANSWER), f"grams{order}").withColumns({"level": F.lit(order), "texts": F.lit(all_texts).cast("long")})
        store.tidy(spark)
        return got

    words = ask(table.mapInArrow(_send_words(n), SENT), 1)
    sums = words.agg(*[F.sum(c) for c in ("total", "types", "kept_total", "kept_types")]).first()
    full = Totals((sums[0] or 0) + all_texts, (sums[1] or 0) + (all_texts > 0), all_texts)
    kept = Totals((sums[2] or 0) + kept_texts, (sums[3] or 0) + (kept_texts > 0), kept_texts)
    columns = ["block", "part", "level", "texts", "counts", "kept"]
    answers = words.select(columns)
    for order in (2, 3):
        apply, schema = _send_grams(n, all_texts, order)
        answers = answers.unionByName(ask(B.back_to_blocks(table, answers.select(columns), apply, schema), order).select(columns))
    apply, schema = _cells(kept)
    held = B.back_to_blocks(table.where(F.col("kind") == HELD), answers.where("kept is not null"), apply, schema)
    found = held.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3")]).collect()
    cells = np.array([r["cell"] for r in found], np.int64)
    sums = np.array([[r[c] for r in found] for c in ("s1", "s2", "s3")]).reshape(3, -1)
    weights = learn_weights(cells, np.array([r["n"] for r in found], np.int64), sums, kept.types)
    apply, schema = _score(full, weights)
    return B.back_to_blocks(table, answers, apply, schema), full.tokens
