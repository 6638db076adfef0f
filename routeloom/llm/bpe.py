"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For a piece of text (the pieces are those of the vocabulary's split pattern) the
BPE result of every prefix is unique, and so is the last token of it.  The encoder walks
the piece once with an automaton over all tokens; at each byte it has the tokens
that end there and keeps the one that fits behind the unique last token of the
prefix it follows.  Two tokens fit when no merge would cross the seam
between them before both are complete.  Following the kept tokens backwards gives the exact
ids.

Defined cases: null and empty texts have no ids and decode to the empty text;
added tokens in a text (``<|endoftext|>``) get their own id, as the tokenizer file
says; texts are whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMO = 1 << 19
_SHORT = 64
_NO_PARENT = 1 << 30


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 as itself, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """Remembers at most ``_MEMO`` results of short keys; then it starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= _MEMO:
            self.clear()
        value = self.make(key)
        if len(key) <= _SHORT:
            self[key] = value
        return value


class BytePairCodec:
    """Encoder and decoder of one ``tokenizer.json`` with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE tokenizer")
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * size
        for t, i in [*vocab.items(), *((k.encode(), v) for k, v in self.added.items())]:
            self.token_bytes[i] = t
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: (left, right, rank of the merge)
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[vocab[a], vocab[b]] = r
            self.halves.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self._spines()
        self.automaton = ahocorasick.Automaton()
        self.fits = _Memo(self._fit)
        for t, i in vocab.items():
            if self._whole(i):
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.memo = _Memo(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes())
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _spines(self) -> None:
        """Right and left spine of a token: (part, rank at which it is merged into the next larger part)."""
        self.right, self.left = {}, {}
        for token in range(len(self.token_bytes)):
            for side, spines in ((1, self.right), (0, self.left)):
                spine, part, until = [], token, _NO_PARENT
                while True:
                    spine.append((part, until))
                    if part not in self.halves:
                        break
                    until, part = self.halves[part][2], self.halves[part][side]
                spines[token] = spine

    def _fit(self, pair: tuple[int, int]) -> bool:
        """No merge crosses the seam while both of its sides are still open (ties go to the left pair)."""
        for x, x_until in self.right[pair[0]]:
            for y, y_until in self.left[pair[1]]:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """Whether merging the token's bytes gives that token: its halves fit until their own merge."""
        if token not in self.halves:
            return len(self.token_bytes[token]) == 1
        a, b, rank = self.halves[token]
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and (x, y) != (a, b) and r < x_until and r <= y_until and r <= rank:
                    return False
        return self._whole(a) and self._whole(b)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: last token of every prefix, then back along them."""
        n, fits = len(piece), self.fits
        last: list[int] = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length
                if not start or last[start] >= 0 and fits[last[start], token]:
                    last[end], size[end] = token, length
        ids = []
        while n:
            if last[n] < 0:
                raise ValueError("a byte has no token in this vocabulary")
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        memo, split = self.memo, self.split
        if self.cut is None or not self.cut.search(text):
            return b"".join([memo[p] for p in split.findall(text)])
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(np.int32(self.added[part]).tobytes())
            else:
                out += [memo[p] for p in split.findall(part)]
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[place].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec per process and vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that these ids stand for), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                own = [c.encode_bytes(t) for t in texts.slice(lo, 256).to_pylist()]
                offsets = np.zeros(len(own) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in own], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), np.int32)))
                decoded = pa.array([c.decode(np.frombuffer(x, np.int32)) for x in own], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), ids, decoded], ["doc_id", "ids", "decoded"])

    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string"
    )
