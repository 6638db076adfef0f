"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become token ids and one end id; longer ones are cut from the back into whole pieces, so only
a document's first piece may be shorter.  Whole pieces fill a sequence each.  The others are dealt
at random into shards of a few thousand, and on each shard several islands evolve a population of packings:
crossover injects the well-filled bins of one parent into the other and dissolves the bins that hold a document twice;
displaced documents are best-fitted, largest first, and then exchanged with others where that fills
a bin better.  Fewer and fuller bins win.  Between epochs every island sends
its elite to the next one.  The bins that the best packing of a shard leaves open are emptied into
a pool, which is dealt and packed again until it fits one shard, so what is left unfilled does not
grow with the number of shards.

Defined cases: a null or empty text is the end id alone; every row is a document, also when ids repeat or are null;
an empty table gives an empty result; a text of any length is encoded whole, also one run of blanks; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm import kernels as K
from routeloom.llm import store
from routeloom.llm.bpe import SPLIT, BytePairCodec, codec

_ENCODERS: dict[str, object] = {}
#: The fast library's pattern matcher gives up on runs of blanks of about a million; texts with a run this long go through our own codec.
_BLANKS = regex.compile(r"\s{10000}")


def encoder(path: str):
    """Function from a text to the ids of a byte-level BPE ``tokenizer.json`` (uint32 array).

    Where the ids of the file are merge ranks, the tiktoken library gives the same ids about three times as fast as this
    package's codec (the tests hold both against the tokenizers library); any other file or text goes through the codec.
    """
    if path not in _ENCODERS:
        own = BytePairCodec(path)  # far larger than the fast one: it goes when that is made, and comes back for the texts that need it
        ranks = {t: i for i, t in enumerate(own.token_bytes) if t and i not in set(own.added.values())}
        merged = [r for _, r in sorted((i, own.halves[i][2]) for i in own.halves)]
        if merged == sorted(merged) and all(len(t) > 1 or i < 256 for t, i in ranks.items()):
            fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=own.added)
            special = set(own.added)
            del own
            gc.collect()  # it refers to itself

            def encode(text: str) -> np.ndarray:
                if len(text) >= 10000 and _BLANKS.search(text):
                    return codec(path).encode(text).astype(np.uint32)
                return fast.encode_to_numpy(text, allowed_special=special)

            _ENCODERS[path] = encode
        else:
            _ENCODERS[path] = lambda text: codec(path).encode(text).astype(np.uint32)
    return _ENCODERS[path]


def cut_pieces(
    docs: DataFrame, vocab: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every document."""
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                row, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(lo, 512).to_pylist()):
                    own = np.concatenate((encode(text), end)).astype("<u4") if text else end
                    first = (len(own) - 1) % capacity + 1
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(own[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names,
                )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(K.lean(run), f"doc_id {kind}, piece int, start long, length long, ids binary")


class Packer:
    """Population of packings of one shard; a packing is the bin number of every item."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.rng = np.random.default_rng(seed)
        self.least = self.bound()
        self.by_size = np.argsort(-self.sizes, kind="stable")

    def bound(self) -> int:
        """No packing has fewer bins: items that cannot share a bin, and what the others need beyond the room beside them."""
        c = self.capacity
        count = np.bincount(self.sizes, minlength=c + 1)
        total = count * np.arange(len(count))
        n_to, sum_to = np.cumsum(count), np.cumsum(total)
        small = np.arange(0, c // 2 + 1)  # items below this size are left out
        huge = n_to[-1] - n_to[c - small]
        large = n_to[c - small] - n_to[c // 2]
        room = large * c - (sum_to[c - small] - sum_to[c // 2])
        middle = sum_to[c // 2] - np.where(small > 0, sum_to[small - 1], 0)
        return max(1, int((huge + large + np.maximum(0, -((room - middle) // c))).max()))

    def best_fit(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Put ``items`` (in this order) into the fullest bin that takes them; ``bins`` has -1 for them."""
        placed = bins >= 0
        n = int(bins.max()) + 1 if placed.any() else 0
        room = self.capacity - np.bincount(bins[placed], self.sizes[placed], n).astype(np.int64)
        at: dict[int, list[int]] = {}
        mask = 0
        for b in np.flatnonzero(room > 0).tolist():
            r = int(room[b])
            at.setdefault(r, []).append(b)
            mask |= 1 << r
        out = bins
        for i, s in zip(items.tolist(), self.sizes[items].tolist(), strict=True):
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = at[r].pop()
                if not at[r]:
                    mask ^= 1 << r
            else:
                b, r, n = n, self.capacity, n + 1
            out[i] = b
            r -= s
            if r:
                if at.get(r):
                    at[r].append(b)
                else:
                    at[r] = [b]
                    mask |= 1 << r
        return out

    def fullest(self, items: list[int]) -> list[int]:
        """Items of the largest total that a bin takes, the largest items that give it (reachable totals are bits of one number)."""
        sizes = self.sizes
        items = sorted(items, key=lambda i: -sizes[i])
        goal, limit = 1 << self.capacity, (1 << (self.capacity + 1)) - 1
        reach, before = 1, []
        for i in items:
            before.append(reach)
            reach |= (reach << int(sizes[i])) & limit
            if reach & goal:
                break
        at, out = reach.bit_length() - 1, []
        for k in range(len(before) - 1, -1, -1):
            if not before[k] >> at & 1:
                out.append(items[k])
                at -= int(sizes[items[k]])
        return out

    def replace(self, bins: np.ndarray, free: np.ndarray, choices: int = 24) -> np.ndarray:
        """Exchange items of open bins for displaced ones where that fills the bin better; the items that stay out, largest first."""
        free = self.rng.permutation(free).tolist()
        fill = np.bincount(bins[bins >= 0], self.sizes[bins >= 0])
        open_bins = np.flatnonzero((fill > 0) & (fill < self.capacity))
        members: dict[int, list[int]] = {int(b): [] for b in open_bins}
        inside = np.flatnonzero(np.isin(bins, open_bins))
        for i, b in zip(inside.tolist(), bins[inside].tolist(), strict=True):
            members[b].append(i)
        for b in self.rng.permutation(open_bins).tolist():
            if not free:
                break
            offered, free = free[-choices:], free[:-choices]
            own = members[b]
            chosen = self.fullest(own + offered)
            if self.sizes[chosen].sum() > fill[b]:
                taken = set(chosen)
                bins[own], bins[chosen] = -1, b
                free = [i for i in own + offered if i not in taken] + free
            else:
                free = offered + free
        return np.array(sorted(free, key=lambda i: (-self.sizes[i], i)), np.int64)

    def settle(self, bins: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Places for displaced items: best fit, largest first; then the emptiest bins are dissolved, and their items
        exchanged with items of other open bins, best-fitted, or put in new bins filled one by one, whichever ends best."""
        used = bins >= 0
        _, bins[used] = np.unique(bins[used], return_inverse=True)
        bins = self.best_fit(bins, free[np.argsort(-self.sizes[free], kind="stable")])
        f = self.fill(bins)
        slack = int((self.capacity - f).sum())
        order = np.argsort(f, kind="stable")
        few = order[: max(2, int(np.searchsorted(np.cumsum(f[order]), 2 * slack)))][:256]
        other = np.where(np.isin(bins, few), -1, bins)
        left = np.flatnonzero(other < 0)
        used = other >= 0
        _, other[used] = np.unique(other[used], return_inverse=True)
        left = self.replace(other, left)
        n = int(other.max()) + 1 if used.any() else 0
        filled = other.copy()
        other = self.best_fit(other, left)
        rest = left[other[left] >= n].tolist()
        filled[left] = np.where(other[left] < n, other[left], -1)
        while rest:
            chosen = self.fullest([rest[0], *self.rng.permutation(rest[1:])[:48].tolist()])
            filled[chosen] = n
            taken, n = set(chosen), n + 1
            rest = [i for i in rest if i not in taken]
        return max(bins, other, filled, key=self.fitness)

    def fill(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.sizes)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Few bins first, then many full ones (and so a few with much room)."""
        f = self.fill(bins) / self.capacity
        n = int((f > 0).sum())
        return -n, float((f * f).sum() / max(1, n))

    def start(self, n: int) -> list[np.ndarray]:
        """Best fits, largest first and then in random orders in which larger items tend to come first, each looser than the one before."""
        out = []
        while len(out) < n and not self.done(out):
            loose = 0.05 * len(out)
            noisy = self.sizes * self.rng.uniform(1 - loose, 1 + loose, len(self.sizes))
            out.append(self.best_fit(np.full(len(self.sizes), -1, np.int64), np.argsort(-noisy, kind="stable")))
        return out

    def done(self, population: list[np.ndarray]) -> bool:
        return any(-self.fitness(b)[0] <= self.least for b in population)

    def cross(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of ``giver`` go into ``taker``, whose bins that hold one of their items are
        dissolved; what that displaces is settled."""
        f = self.fill(giver)
        good = np.flatnonzero(f >= np.quantile(f[f > 0], 0.5))
        chosen = np.zeros(len(f), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 4), replace=False)] = True
        given = chosen[giver]
        broken = np.zeros(int(taker.max()) + 1, bool)
        broken[taker[given]] = True
        child = np.where(broken[taker], -1, taker)
        displaced = np.flatnonzero((child < 0) & ~given)
        child[given] = giver[given] + len(broken)
        return self.settle(child, displaced)

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """Dissolve the emptiest bins and some others, and settle their items."""
        f = self.fill(bins)
        real = np.flatnonzero(f > 0)
        gone = np.zeros(len(f), bool)
        few = max(1, len(real) // 20)
        gone[real[np.argsort(f[real], kind="stable")[:few]]] = True
        gone[self.rng.choice(real, few, replace=False)] = True
        child = np.where(gone[bins], -1, bins)
        return self.settle(child, np.flatnonzero(child < 0))

    def evolve(self, population: list[np.ndarray], generations: int, size: int, patience: int = 12) -> list[np.ndarray]:
        """Best first.  Parents win tournaments of two; the search ends at the bound, or when the best stays the same for ``patience`` children."""
        ranked = sorted(((self.fitness(b), k, b) for k, b in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
        still, number = 0, len(ranked)
        for _ in range(generations):
            if -ranked[0][0][0] <= self.least or len(self.sizes) < 2 or still >= patience:
                break
            a, b = (int(self.rng.integers(0, len(ranked), 2).min()) for _ in range(2))
            child = self.cross(ranked[a][2], ranked[b][2])
            if self.rng.random() < 0.5:
                child = self.mutate(child)
            fit, best = self.fitness(child), ranked[0][0]
            if all(fit != r[0] for r in ranked):  # equal fitness is nearly always the same packing
                number += 1
                ranked = sorted([*ranked, (fit, number, child)], key=lambda x: (x[0], -x[1]), reverse=True)[:size]
            still = 0 if ranked[0][0] > best else still + 1
        return [b for _, _, b in ranked]


def _pack_shards(items: DataFrame, n_shards: int, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """tag, shard, bin, offset, fill for (tag, length) rows."""

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("tag")
        tags, sizes = table["tag"].to_numpy().astype(np.int64), table["length"].to_numpy().astype(np.int32)
        n = islands
        return pa.table({
            "shard": pa.array([table["shard"][0].as_py()] * n, pa.int32()), "island": pa.array(range(n), pa.int32()),
            "tags": pa.array([tags.tobytes()] * n, pa.binary()), "sizes": pa.array([sizes.tobytes()] * n, pa.binary()),
            "packings": pa.array([[]] * n, pa.list_(pa.binary())),
        })

    schema = "shard int, island int, tags binary, sizes binary, packings array<binary>"

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    seed = (r["shard"] * islands + r["island"]) * 1000 + number
                    p = Packer(np.frombuffer(r["sizes"], np.int32), capacity, seed)
                    known = [np.frombuffer(x, np.int32).astype(np.int64) for x in r["packings"]]
                    best = p.evolve(known or p.start(population), generations, population)
                    r["packings"] = [b.astype(np.int32).tobytes() for b in best]
                    yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

        return run

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("tag"), F.lit(n_shards)).cast("int"))
    pop = dealt.groupBy("shard").applyInArrow(gather, schema).mapInArrow(K.lean(epoch(0)), schema)
    for e in range(1, epochs):
        pop = store.materialize(pop, "islands")
        elite = pop.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("packings", 1, 1).alias("elite"))
        pop = pop.join(elite, ["shard", "island"]).select(
            "shard", "island", "tags", "sizes", F.concat("packings", "elite").alias("packings")
        ).mapInArrow(K.lean(epoch(e)), schema)

    def choose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("island").to_pylist()
        p = Packer(np.frombuffer(rows[0]["sizes"], np.int32), capacity, 0)
        best = max((np.frombuffer(r["packings"][0], np.int32).astype(np.int64) for r in rows), key=p.fitness)
        order = np.argsort(best, kind="stable")
        sizes, bins = p.sizes[order], best[order]
        begin = np.cumsum(sizes) - sizes
        first = np.append(True, bins[1:] != bins[:-1])
        offset = begin - np.maximum.accumulate(np.where(first, begin, 0))
        tags = np.frombuffer(rows[0]["tags"], np.int64)[order]
        fill = p.fill(best)[bins].astype(np.int64)
        return pa.table({"tag": tags, "shard": pa.array(np.full(len(tags), rows[0]["shard"]), pa.int32()), "bin": pa.array(bins, pa.int32()), "offset": offset, "fill": fill})

    return pop.groupBy("shard").applyInArrow(choose, "tag long, shard int, bin int, offset long, fill long")


def pack(
    pieces: DataFrame, *, capacity: int = 2048, shard: int = 4096, islands: int = 2, epochs: int = 2, population: int = 8,
    generations: int = 24, open_below: float = 0.97, rounds: int = 4,
) -> DataFrame:
    """``pieces`` (with a column ``length``) and for each row its sequence_id and offset."""
    tagged = store.materialize(pieces.withColumn("tag", F.monotonically_increasing_id()), "pieces")
    whole = tagged.where(F.col("length") >= capacity).select(
        "tag", (-F.col("tag") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    items, placed = tagged.where(F.col("length") < capacity).select("tag", "length"), whole
    for number in range(rounds):
        n = items.count()
        if not n:
            break
        n_shards = -(-n // shard)
        got = store.materialize(_pack_shards(items, n_shards, capacity, islands, epochs, population, generations), "packed")
        last = n_shards == 1 or number == rounds - 1
        closed = got if last else got.where(F.col("fill") >= open_below * capacity)
        name = (F.lit(number).cast("long") * (1 << 58)) + F.col("shard").cast("long") * (1 << 24) + F.col("bin")
        placed = placed.unionByName(closed.select("tag", name.alias("sequence_id"), "offset"))
        if last:
            break
        open_tags = got.where(F.col("fill") < open_below * capacity).select("tag")
        items = store.materialize(items.join(open_tags, "tag", "left_semi"), "pool")
    return tagged.join(placed, "tag").drop("tag")
