"""Texts as blocks, and an exchange of block dictionaries by key range.

A block is a row with a few MB of whole texts (zstd), their ids and offsets.  The
blocks are written once, bucketed by block number, so that what later comes back to
a block is joined to it without moving the texts again.

Blocks and key ranges grow with the square root of the corpus, so the rows of an exchange (one for each block and range)
grow in proportion to it: 2 MB up to about 0.6 GB of text, 64 MB from about 600 GB on, where an exchange has
10,000 x 10,000 rows.  A task opens one block at a time and needs 10 to 15 times its bytes.

The exchange answers a question about keys of the whole corpus ("how often, in which
documents") with vectors instead of rows: each block sends its *distinct* keys to
the key's range as one sorted vector per range; the range answers with a vector in the same
order.  A key that fills a third of the corpus is still one entry per block, so no range gets more
than its share.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from routeloom.llm import kernels as K
from routeloom.llm import store

#: Least and most bytes of a block, and the size of a table (as Spark estimates it) from which on blocks grow.
BLOCK_BYTES, BLOCK_MOST, GROW_FROM = 2 << 20, 32, 200_000_000
BLOCK_SCHEMA = "block long, kind int, n_docs int, n_bytes long, ids binary, null_ids binary, extra binary, offs binary, data binary"


def pack(raw: bytes | np.ndarray) -> bytes:
    raw = raw if isinstance(raw, bytes) else np.ascontiguousarray(raw).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(packed: bytes, kind=np.uint8) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], n, codec="zstd", asbytes=True) if n else b"", kind)


class Block:
    """One row of the blocks table, opened."""

    def __init__(self, row: dict):
        self.number, self.kind = row["block"], row["kind"]
        self.ids = unpack(row["ids"], np.int64)
        self.null_ids = unpack(row["null_ids"], np.bool_)
        self.packed_extra = row["extra"]
        self.offs = unpack(row["offs"], np.int64)
        self.data = unpack(row["data"])

    def extra(self) -> pa.Array:
        """What went with the rows (JSON); null where nothing did."""
        n, text = len(self.ids), unpack(self.packed_extra).tobytes().decode()
        return pa.array(text.split("\n") if text else [None] * n, pa.string())

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null_ids)

    def chunks(self, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, bytes, offsets) of runs of the block's texts of about ``limit`` bytes."""
        lo, n = 0, len(self.ids)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offs, self.offs[lo] + limit, "right")) - 1)
            a, b = self.offs[lo], self.offs[hi]
            yield lo, hi, self.data[a:b], self.offs[lo : hi + 1] - a
            lo = hi


def _to_blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, full = TaskContext.get().partitionId() << 32, {}, {}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal number
            rows, number = held.pop(kind), number + 1
            ids = pa.chunked_array([h[0] for h in rows])
            extra = "\n".join(x or "" for h in rows for x in h[3].to_pylist()) if rows[0][3].null_count == 0 else ""
            offs, at = [np.zeros(1, np.int64)], 0
            for _, _, o, _ in rows:
                offs.append(o[1:] + at)
                at += o[-1]
            data = b"".join([h[1].tobytes() for h in rows])
            row = [
                number, kind, len(ids), at, pack(ids.fill_null(0).to_numpy().astype(np.int64)),
                pack(ids.is_null().to_numpy().astype(np.bool_)), pack(extra.encode()), pack(np.concatenate(offs)), pack(data),
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], BLOCK_NAMES)

        for batch in batches:
            kinds = batch.column(3).to_numpy()
            for kind in np.unique(kinds).tolist():
                own = batch.filter(pa.array(kinds == kind))
                for lo, hi, data, offs in K.slabs(own.column(1), 1 << 18):
                    if kind in held and full[kind] + offs[-1] > size:
                        yield flush(kind)
                    full[kind] = full[kind] + offs[-1] if kind in held else offs[-1]
                    held.setdefault(kind, []).append((own.column(0).slice(lo, hi - lo), data, offs, own.column(2).slice(lo, hi - lo)))
        for kind in list(held):
            yield flush(kind)

    return run


BLOCK_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]


def block_bytes(docs: DataFrame) -> int:
    """Bytes of a block for a table of this size (as the optimizer estimates it; results do not depend on it)."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(BLOCK_BYTES * min(BLOCK_MOST, max(1.0, (float(size) / GROW_FROM) ** 0.5)))


def make_blocks(
    docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None, kind: Column | None = None,
    times: int = 1,
) -> DataFrame:
    """Write the texts of ``docs`` as a table of blocks bucketed by block number; null texts are empty.

    ``extra`` (JSON, never null) goes with the rows; all rows of a block are of one ``kind`` (int, 0).  Ids have to be integers.
    Blocks are ``times`` the usual size, up to the same greatest one.
    """
    extra = F.lit(None).cast("string") if extra is None else extra
    kind = F.lit(0) if kind is None else kind
    of = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    if of not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids have to be integers, not {of}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), extra.alias("extra"), kind.cast("int").alias("kind"))
    n = store.shuffle_partitions(docs.sparkSession)
    size = min(times * block_bytes(docs.select(F.col(text_col))), BLOCK_BYTES * BLOCK_MOST)
    return store.materialize_bucketed(rows.mapInArrow(K.lean(_to_blocks(size)), BLOCK_SCHEMA), name, n, "block")


def ranges(blocks: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Number of key ranges: enough that one gets the keys of about ``bytes_each`` bytes of text, or of a block if that is more."""
    total, block = blocks.agg(F.sum("n_bytes"), F.percentile_approx("n_bytes", 0.5)).first()
    total, block = total or 0, min(block or 0, BLOCK_BYTES * BLOCK_MOST)
    return int(min(1 << 22, max(store.shuffle_partitions(blocks.sparkSession), -(-total // max(bytes_each, block)))))


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Range numbers of 64-bit keys, ascending with the key."""
    return ((keys >> K.U(40)) * K.U(n) >> K.U(24)).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps, high bytes first, so that their zeros meet."""
    steps = np.diff(keys, prepend=K.U(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_keys(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(unpack(packed).reshape(8, -1).T)
    return np.cumsum(steps.view(K.U).ravel(), dtype=K.U)


def cut(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: the ranges they meet, and first and last place of each."""
    at = range_of(keys, n)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first, np.append(first[1:], len(keys))


def by_block(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        yield from batch.to_pylist()


def back_to_blocks(
    blocks: DataFrame, answers: DataFrame, apply: Callable[[Block, list[dict]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Call ``apply(block, its answers)``; the blocks' rows stay where they are."""
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(by_block(right))
        out = [b for row in by_block(left) for b in apply(Block(row), rows)]
        K.give_back()
        return pa.Table.from_batches(out) if out else shape.empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def crc_of(ids: np.ndarray, null_ids: np.ndarray) -> np.ndarray:
    """crc32 of each id's decimal text; 0 for a null id."""
    return np.array([0 if z else zlib.crc32(b"%d" % i) for i, z in zip(ids.tolist(), null_ids.tolist(), strict=True)], np.int64)
