"""Quality rules on word counts and on the fertility of public tokenizers.

For every text each vocabulary gives three measures over the text's words: characters per token, the share of
byte-fallback tokens (tokens that are no whole characters), and the entropy of the token distribution (bits
a token).  A text passes when, under every vocabulary, each measure lies in the band of its language, or of
its main script where the language has no band.  Words are encoded one by one, each distinct word of a slab once.

The bands of languages are fixed values.  The band of a script follows from the vocabulary: its letters, encoded alone, take so many
tokens and bytes on average, and a text may do little worse than one in which nothing merges.

Defined cases: a null text has no words; a text without words fails the word count
rule and has null measures; short texts are judged by wider bands, since they vary more and the entropy of n tokens
is at most log2(n); rows are judged one by one, so repeats get equal verdicts; an unknown or
null language falls back to the script, an unknown script to the widest band; a very long text is measured whole, as a slab of
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm import kernels as K

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_SCRIPT_OF = np.zeros(256, np.int64)
for _name, _leads in (
    ("latin", [*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9]),
    ("greek", [0xCE, 0xCF]), ("cyrillic", range(0xD0, 0xD4)), ("hebrew", [0xD6, 0xD7]), ("arabic", range(0xD8, 0xDC)),
    ("indic", [0xE0]), ("kana", [0xE3]), ("han", range(0xE4, 0xEA)), ("hangul", range(0xEA, 0xEE)), ("other", [0xF0]),
):
    _SCRIPT_OF[list(_leads)] = SCRIPTS.index(_name)


#: Letters of a script that its band is made from (first and last code point).
LETTERS = {
    "greek": (0x391, 0x3C9), "cyrillic": (0x410, 0x44F), "hebrew": (0x5D0, 0x5EA), "arabic": (0x627, 0x64A), "indic": (0x905, 0x939),
    "kana": (0x3041, 0x30FA), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3), "other": (0x1F300, 0x1F64F),
}


@dataclass(frozen=True)
class Band:
    """What texts of a language or script may measure.

    Characters per token: at least ``centre - slack - noise / sqrt(tokens)`` (short texts vary
    more) and at most ``most``.  Byte-fallback tokens: at most the share ``byte_share``.
    Entropy / log2(tokens): at least ``evenness``.
    """

    centre: float
    slack: float
    noise: float = 2.5
    most: float = 8.0
    byte_share: float = 0.10
    evenness: float = 0.40


def _language_bands() -> dict[str, dict[str, Band]]:
    """Medians of clean texts of the four languages under the two public vocabularies."""
    return {
        "piece_bpe_32k.model": {"en": Band(2.21, 0.08), "de": Band(2.23, 0.08), "fr": Band(1.99, 0.08), "es": Band(1.94, 0.08), "latin": Band(2.0, 0.3)},
        "byte_bpe_multi_50k.tiktoken": {"en": Band(2.29, 0.10), "de": Band(2.32, 0.10), "fr": Band(2.08, 0.10), "es": Band(2.23, 0.10), "latin": Band(2.1, 0.3)},
    }


@dataclass(frozen=True)
class Rules:
    """``bands``: of each vocabulary file, of languages and scripts; scripts without one get :func:`script_band`."""

    min_words: int = 50
    max_repeat_percent: int = 50
    bands: dict[str, dict[str, Band]] = field(default_factory=_language_bands)


class Vocabulary:
    """Ids of single words by a sentencepiece model or a file of byte-level ranks."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: sp.encode(words, num_threads=1) if words else []
            self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            one = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.encode = lambda words: [one(w) for w in words]
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            for token, i in ranks.items():
                self.is_byte[i] = not _whole(token)


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per process and file."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def script_band(path: str, script: str) -> Band:
    """Band of a script from how the vocabulary takes its letters one by one; a script without letters gets the widest."""
    v = vocabulary(path)
    first, last = LETTERS.get(script, LETTERS["other"])
    ids = v.encode([chr(c) for c in range(first, last + 1)])
    tokens, raw = sum(map(len, ids)), int(sum(v.is_byte[x].sum() for x in ids))
    least = 0.8 * len(ids) / tokens
    return Band(least, 0.0, byte_share=min(1.0, raw / tokens + 0.1))


def measure(data: np.ndarray, offs: np.ndarray, vocabs: list[str]) -> dict[str, np.ndarray]:
    """Counts and fertility measures of each text of a slab."""
    n = len(offs) - 1
    starts, ends, doc = K.words(data, offs)
    per = lambda d, w=None: np.bincount(d, w, n)
    leads = np.concatenate(([0], np.cumsum(K.LEAD[data])))
    chars = leads[ends] - leads[starts]
    out = {"n_words": per(doc), "word_chars": per(doc, chars).astype(np.int64)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out["n_symbols"] = symbols[offs[1:]] - symbols[offs[:-1]]

    # lines with a word, told apart by text
    line_end = data == 10
    breaks = np.flatnonzero(line_end)
    l_start = np.sort(np.concatenate((offs[:-1], breaks + 1)))
    l_doc = np.searchsorted(offs, l_start, "right") - 1
    l_end = np.append(l_start[1:], offs[-1])
    l_end = l_end - ((l_end > l_start) & np.append(line_end, False)[np.maximum(l_end - 1, 0)])
    worded = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_doc = l_doc[worded]
    one, two = K.digests(data, l_start[worded], l_end[worded])
    first = np.zeros(len(l_doc), bool)
    first[K.classes(K.with_doc(one, l_doc), two, l_doc)[0]] = True
    out["n_dup_lines"] = per(l_doc[~first])

    where, which = K.classes(*K.digests(data, starts, ends))
    covered = np.zeros(len(doc), bool)
    if len(doc) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        window = [which[at + k] for k in range(3)]
        key = K.mix(K.mix(K.mix(window[0].astype(K.U) + K.U(1)) + window[1].astype(K.U)) + window[2].astype(K.U))
        _, group = K.classes(K.with_doc(key, doc[at]), *window, doc[at])
        hit = at[np.bincount(group)[group] > 1]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = per(doc[covered])

    # fertility: every distinct word is encoded once
    raw = data.tobytes()
    distinct = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    out["fertility"] = [_fertility(vocabulary(v), distinct, which, doc, n) for v in vocabs]
    kind = _SCRIPT_OF[data]
    text_of = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(text_of * len(SCRIPTS) + kind, minlength=n * len(SCRIPTS)).reshape(n, -1)
    counts[:, 0] = 0
    out["script"] = np.where(counts.max(1) > 0, counts.argmax(1), 0)
    return out


def _fertility(v: Vocabulary, distinct: list[str], which: np.ndarray, doc: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback tokens and entropy of each text, from its words' places among the distinct words."""
    ids = v.encode(distinct)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    lengths = size[which]
    stop = np.cumsum(lengths)
    tokens = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[which] - (stop - lengths), lengths)]
    n_tokens = np.bincount(doc, lengths, n).astype(np.int64)
    bytes_of = np.zeros(len(size))
    np.add.at(bytes_of, np.repeat(np.arange(len(size)), size), v.is_byte[flat])
    edges = np.concatenate(([0], np.cumsum(n_tokens)))
    entropy = np.zeros(n)
    for k in range(n):
        if n_tokens[k]:
            c = np.bincount(tokens[edges[k] : edges[k + 1]])
            c = c[c > 0]
            entropy[k] = np.log2(n_tokens[k]) - (c * np.log2(c)).sum() / n_tokens[k]
    return {"n_tokens": n_tokens, "byte_tokens": np.bincount(doc, bytes_of[which], n).astype(np.int64), "entropy": entropy}


def judge(
    docs: DataFrame, vocabs: list[str], rules: Rules | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """One row per document: its counts, ``fertility`` (measures under each vocabulary), script, base_failed, fertile and kept."""
    rules = rules or Rules()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in K.slabs(batch.column(1), 2 << 20):
                m = measure(data, offs, vocabs)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)]
                columns += [pa.array(m[c], pa.int64()) for c in counts] + [pa.array([SCRIPTS[k] for k in m["script"]])]
                for f in m["fertility"]:
                    columns.append(pa.StructArray.from_arrays([pa.array(x) for x in f.values()], list(f)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", *counts, "script", *(f"v{k}" for k in range(len(vocabs)))])

    kind = dict(rows.dtypes)["doc_id"]
    fields = ", ".join(f"{c} long" for c in counts)
    measures = ", ".join(f"v{k} struct<n_tokens: long, byte_tokens: long, entropy: double>" for k in range(len(vocabs)))
    out = rows.mapInArrow(run, f"doc_id {kind}, lang string, {fields}, script string, {measures}")

    def inside(k: int, b: Band) -> Column:
        tokens, entropy = F.nullif(F.col(f"v{k}.n_tokens"), F.lit(0)), F.col(f"v{k}.entropy")
        per_token = F.col("word_chars") / tokens
        least = b.centre - b.slack - b.noise / F.sqrt(tokens)
        lively = F.coalesce(F.when(tokens > 1, entropy / F.log2(tokens)), F.lit(1.0)) >= b.evenness
        return per_token.between(least, b.most) & (F.col(f"v{k}.byte_tokens") / tokens <= b.byte_share) & lively

    def fertile(k: int, path: str) -> Column:
        bands = dict(rules.bands.get(path.rsplit("/", 1)[-1], {}))
        scripts = {name: bands.get(name) or script_band(path, name) for name in SCRIPTS[1:]}
        case = F.when(F.lit(False), F.lit(False))
        for name, b in bands.items():
            if name not in scripts:
                case = case.when(F.col("lang") == name, inside(k, b))
        for name, b in scripts.items():
            case = case.when(F.col("script") == name, inside(k, b))
        return F.coalesce(case, F.lit(False))

    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    every = reduce(and_, [fertile(k, path) for k, path in enumerate(vocabs)])
    out = out.withColumn("base_failed", failed).withColumn("fertile", every).withColumn("kept", ~F.col("base_failed") & F.col("fertile"))
    return out.withColumn("fertility", F.array(*[F.col(f"v{k}") for k in range(len(vocabs))])).drop(*[f"v{k}" for k in range(len(vocabs))])
