"""Language identification with interpolated Kneser-Ney character models.

One model per language over the characters of its texts (lower-cased letters, every run of
other characters one blank), orders 1 to ``order``.  A model's n-grams are kept in
arrays sorted by 64-bit hash.  The arrays of all languages share their keys: a row has every
language's log probability of the n-gram, back-off already applied, so a character is looked up once.
An n-gram that no language has seen is scored by its suffix and the back-off weights of its context.

The language with the least cross-entropy a character wins.  A text is rejected when
that cross-entropy lies above the language's calibrated bound (from sampled rows that were not counted; plus
12 bits over the square root of the number of letters, since short texts vary more), or when it has no letter.

Bound: about ``sample`` texts a language are learned from, whole, chosen by a hash of the id over all rows.  Their n-grams are
counted in Spark, so a task holds the distinct n-grams of one language and never its texts.  Every language
is learned.  Languages are joined in parts of at most 16 languages and 4 million n-grams of the highest order, whose arrays are collected and
broadcast; the driver sums their sizes first, and where all parts together go beyond ``at_once`` bytes the rows
are judged part by part, with the best language so far written between parts.

Defined cases: null or letterless texts are ``und`` with score 0 and rejected; rows with null language are not
learned from; ties go to the first language in order of name; without any row to learn from everything
is ``und``; rows are judged one by one, so repeats agree; a very long text is scored whole, a window of characters at a
time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm import kernels as K
from routeloom.llm import store
from routeloom.llm.blocks import pack, unpack

_ODD = [K.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BLANK = 32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, each text as blank, words with single blanks, blank; and offsets."""
    raw = [("\x00" + t.lower() + "\x00" if t else "\x00").encode("utf-32-le") for t in texts]
    c = np.frombuffer(b"".join(raw), np.uint32)
    text_at = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw])))
    letter = _letters()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character behind a letter stays as a blank
    keep[text_at[:-1]] = True  # and the one that starts the text
    offs = np.concatenate(([0], np.cumsum(keep)))[text_at]
    return np.where(letter, c, np.uint32(_BLANK))[keep], offs


def grams(c: np.ndarray, order: int) -> list[np.ndarray]:
    """grams[k][i]: hash of the k characters that end at i (nonsense for the first k - 1)."""
    wide = c.astype(K.U)
    out, total = [np.zeros(len(c), K.U)], np.zeros(len(c), K.U)
    for k in range(1, order + 1):
        total = total.copy()
        total[k - 1 :] += (wide[: len(c) - k + 1] + K.U(k << 24)) * _ODD[k - 1]
        out.append(K.mix(total))
    return out


def inside(offs: np.ndarray, n: int) -> np.ndarray:
    """How many characters of its own text each character ends, itself included."""
    return np.arange(1, n + 1) - np.repeat(offs[:-1], np.diff(offs))


class Sorted:
    """Keys in ascending order with a table from their leading bits to their place."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, K.U(0xFFFFFFFFFFFFFFFF))
        bits = max(1, min(20, int(len(keys)).bit_length() + 1))
        self.shift = K.U(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=K.U) << self.shift).astype(np.int32)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is missing."""
        at = self.start[(q >> self.shift).astype(np.int32)]
        have = self.keys[at]
        while True:
            low = np.flatnonzero(have < q)
            if not len(low):
                break
            at[low] += 1
            have[low] = self.keys[at[low]]
            if len(low) < len(q) // 8:  # few are left: finish them by themselves
                at[low] = np.searchsorted(self.keys, q[low])
                have[low] = self.keys[at[low]]
                break
        at[(have != q) | (at == len(self.keys) - 1)] = -1
        return at


def gram_counts(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the highest order (a row of code points each) and how often each occurs."""
    c, offs = characters(texts)
    at = np.flatnonzero(inside(offs, len(c)) >= order)
    codes = np.stack([c[at - order + 1 + k] for k in range(order)], axis=1) if len(at) else np.zeros((0, order), np.uint32)
    first, which = K.classes(grams(c, order)[order][at], *codes.T)
    return codes[first], np.bincount(which, minlength=len(first))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, as :func:`grams` has it for characters that end there; 0 for no characters."""
    if not codes.shape[1]:
        return np.zeros(len(codes), K.U)
    total = np.zeros(len(codes), K.U)
    for k in range(1, codes.shape[1] + 1):
        total += (codes[:, -k].astype(K.U) + K.U(k << 24)) * _ODD[k - 1]
    return K.mix(total)


def learn(codes: np.ndarray, counts: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
    """Interpolated Kneser-Ney for one language from its n-grams of the highest order.

    For each order: keys, discounted probability, and of each context its key and back-off weight;
    the orders below the highest count distinct left neighbours.
    """
    model: dict[int, dict[str, np.ndarray]] = {}
    keys, first = np.unique(_hash(codes), return_index=True)
    codes, counts = codes[first], counts[first]
    for k in range(codes.shape[1], 0, -1):
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, suffix = _hash(codes[:, :-1]), _hash(codes[:, 1:])
        ctx, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, counts)
        weight = discount * np.bincount(which) / total
        model[k] = {"keys": keys, "p": np.maximum(counts - discount, 0) / total[which], "context": context, "suffix": suffix, "ctx": ctx, "weight": weight}
        if k > 1:  # a shorter gram counts once for every distinct gram that it ends
            keys, first, counts = np.unique(suffix, return_index=True, return_counts=True)
            codes = codes[first, 1:]
    return model


class Model:
    """The joint arrays of all languages."""

    def __init__(self, languages: list[str], models: list[dict[int, dict[str, np.ndarray]]], order: int, alphabet: int):
        self.languages, self.order = languages, order
        n = len(languages)
        self.uniform = np.full(n, np.log2(1 / alphabet), np.float32)
        self.tables: list[tuple[Sorted, np.ndarray]] = []
        self.backs: list[tuple[Sorted, np.ndarray]] = []
        below: tuple[Sorted, np.ndarray] | None = None
        for k in range(1, order + 1):
            keys, first = np.unique(np.concatenate([m[k]["keys"] for m in models]), return_index=True)
            suffix = np.concatenate([m[k]["suffix"] for m in models])[first]
            context = np.concatenate([m[k]["context"] for m in models])[first]
            ctx = np.unique(np.concatenate([m[k]["ctx"] for m in models]))
            back = np.zeros((len(ctx), n))
            direct = np.zeros((len(keys), n))
            for j, m in enumerate(models):
                weight = np.ones(len(ctx))
                weight[np.searchsorted(ctx, m[k]["ctx"])] = m[k]["weight"]
                back[:, j] = weight
                direct[np.searchsorted(keys, m[k]["keys"]), j] = m[k]["p"]
            lower = np.full((len(keys), n), 1 / alphabet) if below is None else 2.0 ** self._lower(below, suffix)
            value = direct + back[np.searchsorted(ctx, context)] * lower
            below = (Sorted(keys), np.log2(value).astype(np.float32))
            self.tables.append(below)
            self.backs.append((Sorted(ctx), np.log2(back).astype(np.float32)))

    @staticmethod
    def _lower(below: tuple[Sorted, np.ndarray], suffix: np.ndarray) -> np.ndarray:
        return below[1][below[0].find(suffix)].astype(np.float64)

    def score(self, h: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """Log2 probability of every character under every language."""
        out = np.zeros((len(own), len(self.languages)), np.float32)
        left = np.arange(len(own))
        for k in range(self.order, 0, -1):
            able = own[left] >= k
            rest, left = left[~able], left[able]
            at = self.tables[k - 1][0].find(h[k][left])
            hit = at >= 0
            out[left[hit]] += self.tables[k - 1][1][at[hit]]
            miss = left[~hit]
            if len(miss):
                context = h[k - 1][miss - 1] if k > 1 else np.zeros(len(miss), K.U)
                place = self.backs[k - 1][0].find(context)
                known = place >= 0
                out[miss[known]] += self.backs[k - 1][1][place[known]]
            left = np.concatenate((rest, miss))
        out[left] += self.uniform
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text under each language, and the number of letters."""
        c, offs = characters(texts)
        own, order = inside(offs, len(c)), self.order
        sums = np.zeros((len(texts), len(self.languages)))
        step = max(1 << 12, (1 << 23) // len(self.languages))
        for a in range(0, len(c), step):
            b, lo = min(len(c), a + step), max(0, a - order)
            scores = self.score(grams(c[lo:b], order), own[lo:b])[a - lo :]
            scores[own[a:b] == 1] = 0  # the blank that starts a text is given
            doc = np.searchsorted(offs, a, "right") - 1
            starts = np.concatenate(([0], offs[(offs > a) & (offs < b)] - a))
            sums[doc : doc + len(starts)] += np.add.reduceat(scores, starts, axis=0, dtype=np.float64)
        letters = np.add.reduceat((c != _BLANK).astype(np.int64), offs[:-1])
        return -sums / np.maximum(np.diff(offs) - 1, 1)[:, None], letters

    def arrays(self) -> list[np.ndarray]:
        return [x for s, v in (*self.tables, *self.backs) for x in (s.keys[:-1], v)]

    @classmethod
    def of(cls, languages: list[str], arrays: list[np.ndarray], order: int, alphabet: int) -> Model:
        """The model with these :meth:`arrays`."""
        model = cls.__new__(cls)
        model.languages, model.order = languages, order
        model.uniform = np.full(len(languages), np.log2(1 / alphabet), np.float32)
        pairs = [(Sorted(k), v.reshape(len(k), len(languages))) for k, v in zip(arrays[::2], arrays[1::2], strict=True)]
        model.tables, model.backs = pairs[:order], pairs[order:]
        return model


@dataclass
class Fitted:
    """Models in parts: a frame with a row of packed arrays a part, and what the driver knows of each part."""

    parts: DataFrame
    order: int
    alphabet: int
    sizes: list[tuple[int, list[str], int]]  # part, languages, bytes
    at_once: int
    bounds: dict[str, float] = field(default_factory=dict)

    def loads(self) -> Iterator[list[Model]]:
        """The models, as many parts at a time as ``at_once`` bytes hold (one at least)."""
        load: list[int] = []
        for k, (part, _, size) in enumerate(self.sizes):
            load.append(part)
            if k + 1 == len(self.sizes) or sum(x[2] for x in self.sizes if x[0] in load) + self.sizes[k + 1][2] > self.at_once:
                yield self._models(load)
                load = []

    def _models(self, load: list[int]) -> list[Model]:
        rows = {r["part"]: r for r in self.parts.where(F.col("part").isin(load)).collect()}
        out = []
        for part in load:
            r = rows[part]
            arrays = [unpack(x, np.float32 if i % 2 else K.U) for i, x in enumerate(r["blob"])]
            out.append(Model.of(r["languages"], arrays, self.order, self.alphabet))
        return out


def training_rows(docs: DataFrame, split: Column) -> DataFrame:
    return docs.where(split & F.col("lang").isNotNull() & F.col("text").isNotNull())


_NAMES = ("keys", "p", "context", "suffix", "ctx", "weight")


def fit(
    docs: DataFrame, split: Column, *, order: int = 4, sample: int = 1500, slack: float = 1.25, part_languages: int = 16,
    part_grams: int = 4_000_000, at_once: int = 512 << 20,
) -> Fitted | None:
    """Learn from rows of ``docs`` (doc_id, text, lang) for which ``split`` holds."""
    rows = training_rows(docs, split).select("doc_id", "lang", "text")
    sizes = store.materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    few = sizes.count() <= 100_000
    chosen = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(dice < sample / F.col("rows"))
    # every fifth text is spared for the bounds, unless a language has hardly any
    third = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    chosen = store.materialize(chosen.select("lang", "text", (third | (F.col("rows") < 50)).alias("spare"), (~third | (F.col("rows") < 50)).alias("counted")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in K.slabs(batch.column(1), 1 << 20):
                texts, langs = batch.column(1).slice(lo, hi - lo).to_pylist(), batch.column(0).slice(lo, hi - lo).to_pylist()
                own: dict[str, list[str]] = {}
                for lang, text in zip(langs, texts, strict=True):
                    own.setdefault(lang, []).append(text)
                for lang, mine in own.items():
                    codes, counts = gram_counts(mine, order)
                    n, raw = len(codes), np.ascontiguousarray(codes, "<u4").tobytes()
                    edges = np.arange(0, 4 * order * (n + 1), 4 * order, dtype=np.int32)
                    gram = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), gram, pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    counted = chosen.where("counted").select("lang", "text").mapInArrow(K.lean(count), "lang string, gram binary, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def train(table: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(table["gram"].to_pylist()), "<u4").reshape(-1, order)
        model = learn(codes, table["n"].to_numpy())
        blob = [pack(model[k][x]) for k in range(1, order + 1) for x in _NAMES]
        row = {"lang": table["lang"].slice(0, 1), "alphabet": [len(np.unique(codes))], "grams": [len(codes)]}
        return pa.table({**row, "blob": pa.array([blob], pa.list_(pa.binary()))})

    learned = store.materialize(counted.groupBy("lang").applyInArrow(train, "lang string, alphabet long, grams long, blob array<binary>"), "models")
    part_of, part, held, total = {}, 0, 0, 0
    known = sorted(learned.select("lang", "alphabet", "grams").collect(), key=lambda r: r["lang"])
    if not known:
        return None
    for r in known:
        if held == part_languages or held and total + r["grams"] > part_grams:
            part, held, total = part + 1, 0, 0
        part_of[r["lang"]], held, total = part, held + 1, total + r["grams"]
    alphabet = max(r["alphabet"] for r in known) + 1

    def join(table: pa.Table) -> pa.Table:
        got = sorted(table.select(["lang", "blob", "part"]).to_pylist(), key=lambda r: r["lang"])
        kinds = [K.U, np.float64, K.U, K.U, K.U, np.float64]
        models = []
        for r in got:
            arrays = [unpack(x, kinds[i % 6]) for i, x in enumerate(r["blob"])]
            models.append({k: dict(zip(_NAMES, arrays[6 * k - 6 : 6 * k], strict=True)) for k in range(1, order + 1)})
        languages = [r["lang"] for r in got]
        arrays = Model(languages, models, order, alphabet).arrays()
        return pa.table({
            "part": pa.array([got[0]["part"]], pa.int32()), "languages": pa.array([languages], pa.list_(pa.string())),
            "size": pa.array([sum(x.nbytes for x in arrays)], pa.int64()), "blob": pa.array([[pack(x) for x in arrays]], pa.list_(pa.binary())),
        })

    parts = docs.sparkSession.createDataFrame(list(part_of.items()), "lang string, part int")
    joined = learned.join(F.broadcast(parts), "lang").groupBy("part").applyInArrow(join, "part int, languages array<string>, size long, blob array<binary>")
    joined = store.materialize(joined, "parts")
    facts = sorted((r["part"], r["languages"], r["size"]) for r in joined.select("part", "languages", "size").collect())
    fitted = Fitted(joined, order, alphabet, facts, at_once)
    fitted.bounds = dict.fromkeys(part_of, float("inf")) | _bounds(chosen.where("spare").select("lang", "text"), fitted, slack)
    return fitted


def _bounds(spare: DataFrame, fitted: Fitted, slack: float) -> dict[str, float]:
    """Largest cross-entropy of spared texts under their own language, times ``slack``."""
    out = {}
    for models in fitted.loads():
        shared = spare.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place = {lang: (m, j) for m in shared.value for j, lang in enumerate(m.languages)}
            for batch in batches:
                for lo, hi, _, _ in K.slabs(batch.column(1), 1 << 19):
                    langs = batch.column(0).slice(lo, hi - lo).to_pylist()
                    texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                    for model in shared.value:
                        at = [i for i, lang in enumerate(langs) if lang in place and place[lang][0] is model]
                        if at:
                            e, letters = model.entropies([texts[i] for i in at])
                            own = [(langs[i], float(e[k, place[langs[i]][1]])) for k, i in enumerate(at) if letters[k]]
                            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.float64())], ["lang", "e"])

        found = spare.mapInArrow(K.lean(run), "lang string, e double").groupBy("lang").agg(F.max("e").alias("e")).collect()
        out |= {r["lang"]: slack * r["e"] for r in found}
        shared.unpersist()
    return out


class Best:
    """The best language so far of each text, and the sum of all languages' weights against it."""

    def __init__(self, n: int):
        self.name = np.full(n, "und", object)
        self.least, self.bound, self.total = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)

    def take(self, model: Model, bounds: dict[str, float], texts: list[str | None]) -> np.ndarray:
        """Take in a part's languages; returns the number of letters."""
        e, letters = model.entropies(texts)
        best = e.argmin(1)
        mine = e[np.arange(len(e)), best]
        power = np.minimum(letters, 64)
        least = np.minimum(self.least, mine)
        old = np.where(np.isinf(self.least), 0.0, self.total * np.exp2(-power * np.minimum(np.where(np.isinf(self.least), 0, self.least) - least, 1e6)))
        self.total = old + np.exp2(-power[:, None] * (e - least[:, None])).sum(1)
        better = mine < self.least
        names = np.array(model.languages, object)[best]
        self.name = np.where(better, names, self.name)
        self.bound = np.where(better, np.array([bounds[x] for x in model.languages])[best], self.bound)
        self.least = least
        return letters


def identify(docs: DataFrame, fitted: Fitted | None, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of each row (and the whole row, with ``carry``)."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    state = {"name": "string", "least": "double", "bound": "double", "total": "double", "letters": "long"}
    inside = docs.columns.index(text_col) if carry and text_col in docs.columns else None  # a row that has the text goes once
    text = [F.col(text_col).alias("__text")] if inside is None else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *row, *text, *[F.lit(None).cast(t).alias(f"__{c}") for c, t in state.items()])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    loads = list(range(len(fitted.sizes))) if fitted is not None else []
    for k, models in enumerate(fitted.loads() if loads else []):
        if k:
            rows = store.materialize(rows, "judged")
        shared = docs.sparkSession.sparkContext.broadcast((models, fitted.bounds))
        rows = rows.mapInArrow(K.lean(_judge(shared, len(state), inside)), kept)
    known = F.col("__letters") > 0
    limit = F.col("__bound") + 12 / F.sqrt(F.greatest("__letters", F.lit(1)))
    return rows.select(
        "doc_id", *(["row"] if carry else []), F.when(known, F.col("__name")).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / F.col("__total")).otherwise(0.0).alias("score"), F.when(known, F.col("__least")).alias("cross_entropy"),
        F.coalesce(~known | (F.col("__least") > limit), F.lit(True)).alias("rejected"),
    )


def _judge(shared, n_state: int, inside: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, bounds = shared.value
        for batch in batches:
            first = batch.num_columns - n_state
            texts = batch.column(first - 1) if inside is None else batch.column(first - 1).field(inside)
            for lo, hi, _, _ in K.slabs(texts, 1 << 18):
                own = texts.slice(lo, hi - lo).to_pylist()
                best, letters = Best(len(own)), np.zeros(len(own), np.int64)
                before = [batch.column(first + i).slice(lo, hi - lo) for i in range(n_state)]
                if before[4].null_count == 0:  # a pass before this one
                    best.name = np.array(before[0].to_pylist(), object)
                    best.least, best.bound, best.total = (before[i].to_numpy(zero_copy_only=False).copy() for i in (1, 2, 3))
                for model in models:
                    letters = best.take(model, bounds, own)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(first)]
                columns += [pa.array(best.name.tolist(), pa.string()), pa.array(best.least), pa.array(best.bound), pa.array(best.total), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run
