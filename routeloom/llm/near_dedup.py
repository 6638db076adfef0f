"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian verification, exact links.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a MinHash signature of ``bands * rows`` values and
   ``bands`` keys of ``rows`` values each.  Texts with equal sets become one node.
2. Nodes that share a band key are candidates.  First every node of a bucket is compared with one node of it only, its
   lead, the one that meets most others anywhere.  Verified pairs are links, and links make components.
3. Without their leads, whose pairs are decided, some buckets still hold several components.  Their pairs across
   components are compared in tiles: a bucket goes to the component that has most of it, that component's nodes meet the
   others of its buckets, and the others meet each other.  Tiles give out links only.  A bucket whose nodes all meet in
   one component has no such pair, so a large group of copies costs one comparison a copy and bucket, and still no pair
   that shares a bucket is passed over.
4. Verification looks at signatures in batches.  After each batch a pair is dropped when the posterior probability
   (uniform prior) that its similarity reaches the threshold is below ``miss``; the others are confirmed on
   the full sets: 100 * intersection >= 100 * threshold * union.

A bucket, a text or a lead that a third of all rows share is dealt by key and salt (:func:`attach`): what is known about the key goes
only to the salts that its rows have, so no task gets all rows of a key.  Shingles are told apart by 64-bit hashes made from 128-bit
digests of their words: two different ones of a pair of texts of n shingles coincide with probability n**2 / 2**64.

At 36 bands of 5 rows a pair at similarity 0.8 shares no band with probability 7e-7, and one at 0.9 with 1e-14.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a text of fewer words
than a shingle is one shingle; rows repeated with one id are separate rows of one node, of which one is kept;
null ids rank behind all others; an empty table gives an empty result; other columns are ignored, and stay with the
rows that :func:`keep_one` returns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.llm import kernels as K
from routeloom.llm import store

_RNG = np.random.Generator(np.random.PCG64(99))
_FLIP = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint64).astype(np.uint32)
_ODD = (_RNG.integers(0, 1 << 32, 1024, dtype=np.uint64) | 1).astype(np.uint32)
#: Rows of one key are spread over so many salts.
_SALTS = 256
#: Up to so many candidate nodes are sent to all executors to pick their texts (8 bytes each); beyond that the texts are joined.
_BROADCAST_NODES = 500_000
#: Up to so many links (16 bytes each) are made components in one task; beyond that in rounds over all of them.
_FEW_LINKS = 500_000


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of a slab, in order."""
    low = K.FOLD[data]
    starts, ends, doc = K.words(low, offs)
    one, two = K.digests(low, starts, ends)
    h = K.mix(one ^ K.mix(two + K.U(9)))
    count = np.bincount(doc, minlength=len(offs) - 1)
    total = np.zeros(len(h), K.U)
    short = np.zeros(len(h), bool)
    for i in range(min(k, len(h))):
        total[: len(h) - i] = K.mix(total[: len(h) - i] + K.U(i + 1)) + h[i:]
    own = count[doc]
    place = np.arange(len(h)) - (np.cumsum(count) - count)[doc]
    full = place + k <= own
    # a text of fewer words: one shingle over all of them
    few = (own < k) & (place == 0)
    at = np.flatnonzero(few)
    t = np.zeros(len(at), K.U)
    for i in range(k - 1):
        more = own[at] > i
        t[more] = K.mix(t[more] + K.U(i + 1)) + h[at[more] + i]
    total[at] = t + K.U(0x5851F42D4C957F2D) * own[at].astype(K.U)
    short[at] = True
    use = full | short
    h, doc = K.mix(total[use]), doc[use]
    order = np.argsort(K.with_doc(h, doc))
    key = K.with_doc(h, doc)[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    pick = np.sort(order[new])
    return doc[pick], h[pick]


def signatures(h: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (uint32) of the sets ``h[edges[i]:edges[i + 1]]``, none of them empty."""
    out = np.empty((size, len(edges) - 1), np.uint32)
    x = (h >> K.U(32)).astype(np.uint32)
    y = np.empty_like(x)
    for k in range(size):
        np.bitwise_xor(x, _FLIP[k], out=y)
        np.multiply(y, _ODD[k], out=y)
        np.minimum.reduceat(y, edges[:-1], out=out[k])
    return np.ascontiguousarray(out.T)


def least_matches(batch: int, batches: int, threshold: float, miss: float) -> list[int]:
    """After each batch, the fewest equal values with which a pair stays.

    With a uniform prior the posterior of the similarity after m of n equal values is Beta(m + 1, n - m + 1), and
    its mass above t is the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for i in range(1, batches + 1):
        n, mass = batch * i, 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                out.append(m)
                break
    return out


def features(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str, carry: bool) -> DataFrame:
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    inside = docs.columns.index(text_col) if carry and text_col in docs.columns else None  # a row that has the text goes once
    text = [F.col(text_col).alias("__text")] if inside is None else []
    base = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).alias("doc_id"), *row, *text)
    own = [c for c in base.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1) if inside is None else batch.column(batch.num_columns - 1).field(inside)
            for lo, hi, data, offs in K.slabs(texts, 1 << 18):
                n = hi - lo
                doc, h = shingles(data, offs, k)
                count = np.bincount(doc, minlength=n)
                full = np.flatnonzero(count)
                sums = [np.zeros(n, K.U), np.zeros(n, K.U)]
                sig = np.zeros((n, bands * rows), np.uint32)
                keys = np.zeros((n, bands), K.U)
                if len(full):
                    edges = np.concatenate(([0], np.cumsum(count[full])))
                    for s, salt in zip(sums, (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25), strict=True):
                        s[full] = np.add.reduceat(K.mix(h ^ K.U(salt)), edges[:-1])
                    sig[full] = signatures(h, edges, bands * rows)
                    for b in range(bands):
                        key = np.full(n, K.U(b + 1))
                        for r in range(rows):
                            key = K.mix(key * _BIG + sig[:, b * rows + r])
                        keys[:, b] = key
                some = np.where(count > 0, bands, 0)
                key_offs = np.concatenate(([0], np.cumsum(some))).astype(np.int32)
                columns = [batch.column(i).slice(lo, n) for i in range(len(own))]
                columns += [pa.array(count.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64))]
                columns.append(pa.ListArray.from_arrays(pa.array(key_offs), pa.array(keys[full].view(np.int64).ravel())))
                brief = sig.astype(np.uint16)
                columns.append(pa.array([brief[i].tobytes() if c else b"" for i, c in enumerate(count)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*own, "n", "fp1", "fp2", "keys", "sig"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(own)])
    return base.mapInArrow(K.lean(run), f"{kept}, n long, fp1 long, fp2 long, keys array<long>, sig binary")


_BIG = K.U(0x9E3779B97F4A7C15)


def salt(dice: str = "node") -> Column:
    return F.pmod(F.xxhash64(dice), F.lit(_SALTS)).cast("int")


def attach(rows: DataFrame, facts: DataFrame, key: str, dice: str = "node", how: str = "inner") -> DataFrame:
    """Join on a ``key`` that is unique in ``facts`` and may be very common in ``rows``."""
    salted = rows.withColumn("__salt", salt(dice))
    present = salted.select(key, "__salt").distinct().join(facts, key)
    return salted.join(present, [key, "__salt"], how).drop("__salt")


def _likely(pairs: DataFrame, nodes: DataFrame, bands: int, rows: int, threshold: float, miss: float) -> DataFrame:
    """Candidate pairs (a, b) that signatures do not rule out."""
    least = least_matches(rows * 6, bands // 6, threshold, miss)
    step, width = rows * 6, bands * rows
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist() + batch.column(3).to_pylist()), np.uint16).reshape(-1, width)
            at = np.arange(batch.num_rows)
            alive = _compare(at, at + batch.num_rows, sig, least, step)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in (0, 1)], ["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    joined = attach(pairs.join(left, "a"), right, "b", "a")
    sized = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(K.lean(run), "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node and set (sorted hashes) of the ``wanted`` nodes, from the texts of one row each."""
    need = nodes.join(wanted, "node").select("node", "fp1", "fp2", "n", F.col("first.doc_id").alias("of"))
    need = store.materialize(need, "need")
    ids = need.select("of").distinct()
    few = need.count() <= _BROADCAST_NODES
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = base.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in K.slabs(batch.column(0), 1 << 18):
                doc, h = shingles(data, offs, k)
                count = np.bincount(doc, minlength=hi - lo)
                own = np.split(h, np.cumsum(count)[:-1])
                fps = [[int(K.mix(s ^ K.U(salt)).sum(dtype=K.U).view(np.int64)) for s in own] for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(count.astype(np.int64)), pa.array(fps[0], pa.int64()), pa.array(fps[1], pa.int64()), pa.array([np.sort(s).tobytes() for s in own], pa.binary())],
                    ["n", "fp1", "fp2", "members"],
                )

    found = texts.select("text").mapInArrow(K.lean(run), "n long, fp1 long, fp2 long, members binary")
    return found.join(need, ["n", "fp1", "fp2"]).select("node", "members").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), K.U) for c in (2, 3))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int32())) for c in (0, 1)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    return attach(pairs.join(left, "a"), right, "b", "a").select("a", "b", "set_a", "set_b").mapInArrow(K.lean(run), "a long, b long")


def unite(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u[i], v[i]), ascending, and the least node that each one's links reach."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    name = np.arange(len(nodes))
    while len(a):
        least = np.minimum(name[a], name[b])
        for x in (name[a], name[b]):
            np.minimum.at(name, x, least)
        while (name != name[name]).any():
            name = name[name]
        apart = name[a] != name[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[name]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if pairs:
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in unite(u, v)], ["node", "component"])


def components(links: DataFrame, few: int = _FEW_LINKS) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b); a component is named after one of its nodes, the least of most.

    Up to ``few`` links are united in one task, since a round over a small table costs as many tasks as one over a large one.
    Beyond that, every round gives a node the least name among its neighbours, and that name's own, and then contracts the links to
    names, so later rounds see few of them; the rounds follow the logarithm of the longest path.
    """
    edges = store.materialize(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct(), "links")
    if edges.count() <= few:
        return store.materialize(edges.coalesce(1).mapInArrow(K.lean(_united), "node long, component long"), "labels")
    labels = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = store.materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("name")), "near")
        jump = near.select(F.col("u").alias("name"), F.col("name").alias("root"))
        step = store.materialize(attach(near, jump, "name", "u").select("u", "root"), "names")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("root").alias("component"))
        else:
            moved = step.select(F.col("u").alias("component"), "root")
            labels = attach(labels, moved, "component", "node", "left").select("node", F.coalesce("root", "component").alias("component"))
            labels = store.materialize(labels, "labels")
        left = attach(edges, step.select("u", F.col("root").alias("x")), "u", "v")
        left = attach(left, step.select(F.col("u").alias("v"), F.col("root").alias("y")), "v", "u")
        left = left.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        edges = store.materialize(left, "links")
        if edges.isEmpty():
            return labels


def _members(slots: DataFrame) -> DataFrame:
    """(key, node, lead): buckets of two nodes or more, and the bucket's node that meets most others in any bucket.

    The original of a family of copies meets more of it than any copy does.
    """
    slots = slots.withColumn("salt", salt())
    part = slots.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("size"))
    whole = part.groupBy("key").agg(F.sum("size").alias("size"), F.collect_list("salt").alias("salts")).where("size > 1")
    met = slots.join(whole.select("key", "size", F.explode("salts").alias("salt")), ["key", "salt"])
    met = met.select("key", "node", F.struct(-F.sum("size").over(W.partitionBy("node")), "node").alias("rank"))
    met = store.materialize(met, "met")
    leads = met.groupBy("key").agg(F.min_by("node", "rank").alias("lead"))
    return store.materialize(attach(met.select("key", "node"), leads, "key"), "members")


def _first_pairs(member: DataFrame) -> DataFrame:
    """Every node of a bucket against the bucket's lead."""
    return member.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()


def _mixed(member: DataFrame, names: DataFrame) -> DataFrame:
    """(key, node, component, main): members but leads of buckets that hold more than one component; ``main`` has most of the bucket."""
    placed = member.where("node != lead").join(names, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return attach(placed, keys.where("parts > 1").select("key", "main"), "key")


def _compare(x: np.ndarray, y: np.ndarray, sig: np.ndarray, least: list[int], step: int) -> np.ndarray:
    """Which pairs (x[i], y[i]) signatures do not rule out."""
    alive, same = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, m in enumerate(least):
        part = slice(i * step, (i + 1) * step)
        same[alive] += (sig[x[alive], part] == sig[y[alive], part]).sum(1)
        alive = alive[same[alive] >= m]
    return alive


def _family_links(least: list[int], step: int, width: int, percent: int):
    """Links between components inside one tile of a family; a link that joins nothing new is left out."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.num_rows
        node = table["node"].to_numpy()
        side = table["side"].to_numpy()
        component = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(rows, width)
        sets = [np.frombuffer(m, K.U) for m in table["members"].to_pylist()]
        size = np.array([len(m) for m in sets], np.int64)
        words, local = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.concatenate(([0], np.cumsum(size)))
        keys = table["keys"].to_pylist()
        flat, owner = np.concatenate([np.array(k, np.int64) for k in keys]), np.repeat(np.arange(rows), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        owner = owner[order]
        cuts = np.flatnonzero(np.diff(flat[order])) + 1
        met: dict[int, list[np.ndarray]] = {}
        for own in np.split(owner, cuts):
            if len(own) > 1 and component[own].min() != component[own].max():
                for x in own[side[own] == 0]:
                    met.setdefault(int(x), []).append(own)
        root = np.arange(component.max() + 1)
        mark, out = np.zeros(len(words), bool), []
        for x, lists in met.items():
            y = np.unique(np.concatenate(lists))
            y = y[(y != x) & (root[component[y]] != root[component[x]]) & ~((side[y] == 0) & (y < x))]
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[_compare(np.full(len(y), x), y, sig, least, step)]
            if not len(y):
                continue
            mark[local[edge[x] : edge[x + 1]]] = True
            for lo in range(0, len(y), 512):
                own = y[lo : lo + 512]
                ends = np.cumsum(size[own])
                place = np.arange(ends[-1]) + np.repeat(edge[own] - (ends - size[own]), size[own])
                both = np.add.reduceat(mark[local[place]].astype(np.int64), ends - size[own])
                for at in own[100 * both >= percent * (size[x] + size[own] - both)]:
                    a, b = root[component[x]], root[component[at]]
                    if a != b:
                        out.append((node[x], node[at]))
                        root[root == a] = b
            mark[local[edge[x] : edge[x + 1]]] = False
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def _rest(mixed: DataFrame, facts: DataFrame, sets: DataFrame, bands: int, rows: int, threshold: float, miss: float) -> DataFrame:
    """Links between components that share a bucket.

    All buckets of one main component are a family.  Nothing leaves a family but links: the nodes outside the
    main component meet all nodes of the family in tiles of at most ``2 * _TILE`` nodes, each tile one task's group,
    however large the family is.
    """
    own = mixed.groupBy("main", "node").agg(F.any_value("component").alias("component"), F.collect_list("key").alias("keys"))
    own = store.materialize(own.join(facts.select("node", "n"), "node").withColumnRenamed("main", "family"), "families")
    # weight of a node: a tile holds at most about _TILE nodes and _TILE_SHINGLES shingles of either side
    weight = F.greatest(F.lit(1.0), F.col("n") * (_TILE / _TILE_SHINGLES))
    main, dice = F.col("component") == F.col("family"), F.xxhash64("node")
    sizes = own.groupBy("family").agg(F.sum(F.when(main, weight).otherwise(0)).alias("inside"), F.sum(F.when(main, 0).otherwise(weight)).alias("outside"))
    own = attach(own, sizes, "family")
    tiles = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / _TILE).cast("int"))
    own = own.select(
        "family", "node", "component", "keys", main.alias("main"), tiles("outside").alias("rows"), tiles("inside").alias("columns"),
        F.pmod(dice, F.when(main, tiles("inside")).otherwise(tiles("outside"))).cast("int").alias("tile"),
    )
    every = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    tile = F.col("tile")
    # tile (i, j): outer nodes i against inner nodes j, or (j < 0) against the outer nodes -1 - j
    inner = F.transform(every(F.col("rows")), lambda i: place(i, tile, 1))
    outer = F.concat(
        F.transform(every(F.col("columns")), lambda j: place(tile, j, 0)),
        F.transform(F.filter(every(F.col("rows")), lambda i: i >= tile), lambda i: place(tile, -1 - i, 0)),
        F.transform(F.filter(every(F.col("rows")), lambda i: i < tile), lambda i: place(i, -1 - tile, 1)),
    )
    own = own.select("family", "node", "component", "keys", F.explode(F.when(F.col("main"), inner).otherwise(outer)).alias("at"))
    own = own.select("family", "at.*", "node", "component", "keys").join(facts.select("node", "sig"), "node").join(sets, "node")
    run = _family_links(least_matches(rows * 6, bands // 6, threshold, miss), rows * 6, bands * rows, round(threshold * 100))
    return own.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


_TILE, _TILE_SHINGLES = 1024, 1 << 20


def _rows_and_groups(
    docs: DataFrame, shingle: int, threshold: float, bands: int, rows: int, miss: float, id_col: str, text_col: str, carry: bool
) -> tuple[DataFrame, DataFrame]:
    """Rows joined to the component of their set: everything of the rows but their text, and ``best`` (the row that stays)."""
    if bands % 6 or bands * rows > 1024:
        raise ValueError("bands is a multiple of 6, and bands * rows at most 1024")
    table = store.materialize(features(docs, shingle, bands, rows, id_col, text_col, carry), "features")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tag")
    # copies of one text meet by text and salt first; later the answer goes back to those salts
    parts = table.where("n > 0").groupBy("fp1", "fp2", "n", salt("tag").alias("salt")).agg(F.min(order).alias("first"))
    nodes = parts.groupBy("fp1", "fp2", "n").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    nodes = store.materialize(nodes, "nodes").withColumn("node", F.col("first.tag"))
    sketch = table.select(F.col("tag").alias("node"), "keys", "sig").join(nodes.select("node", "n"), "node")
    sketch = store.materialize(sketch, "sketches")
    slots = sketch.select(F.explode("keys").alias("key"), "node")
    member = _members(slots)
    facts = sketch.drop("keys")
    store.tidy(docs.sparkSession)
    tested = store.materialize(_first_pairs(member), "pairs")
    likely = store.materialize(_likely(tested, facts, bands, rows, threshold, miss), "likely")
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = store.materialize(_sets(docs, nodes, wanted, shingle, id_col, text_col), "full")
    links = store.materialize(_confirmed(likely, sets, threshold), "confirmed")
    store.tidy(docs.sparkSession)
    names = components(links)
    store.tidy(docs.sparkSession)
    mixed = store.materialize(_mixed(member, names), "mixed")
    if not mixed.isEmpty():
        sets = store.materialize(_sets(docs, nodes, mixed.select("node").distinct(), shingle, id_col, text_col), "full")
        links = links.union(store.materialize(_rest(mixed, facts, sets, bands, rows, threshold, miss), "rest"))
        names = components(links)
        store.tidy(docs.sparkSession)
    of = nodes.join(names, "node", "left").select("node", "fp1", "fp2", "n", "first", "salts", F.coalesce("component", "node").alias("component"))
    best = of.groupBy("component").agg(F.min("first").alias("best"))
    of = attach(of, best, "component")
    of = of.select(F.col("fp1").alias("k1"), F.col("fp2").alias("k2"), F.col("n").alias("k3"), F.explode("salts").alias("k4"), "best")
    of = store.materialize(of, "groups")
    match = (F.col("fp1") == F.col("k1")) & (F.col("fp2") == F.col("k2")) & (F.col("n") == F.col("k3")) & (salt("tag") == F.col("k4"))
    return table, table.drop("row", "keys", "sig").join(of, match, "left")


def near_groups(
    docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, bands: int = 36, rows: int = 5, miss: float = 1e-9,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links reach; one row of every component is kept.
    """
    _, out = _rows_and_groups(docs, shingle, threshold, bands, rows, miss, id_col, text_col, False)
    alone = F.col("best").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (alone | (F.col("tag") == F.col("best.tag"))).alias("kept"),
    )


def keep_one(
    docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, bands: int = 36, rows: int = 5, miss: float = 1e-9,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of every component of ``docs``, with all its columns."""
    table, out = _rows_and_groups(docs, shingle, threshold, bands, rows, miss, id_col, text_col, True)
    dropped = out.where(F.col("best").isNotNull() & (F.col("tag") != F.col("best.tag"))).select("tag")
    return store.without(table, dropped, "tag").select("row.*")
