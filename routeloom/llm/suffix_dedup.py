"""Repeated passages by a depth-limited radix sort of suffixes.

Only the first ``window`` bytes of a suffix matter, and two suffixes can agree on them only if
their windows hold the same *anchor*: the leftmost of the window's 32-byte strings with
the least hash.  So suffixes are dealt by anchor, the first and widest radix digit.

1. Every block sends its distinct anchors to their key range; a range answers which ones occur in
   two documents or more.
2. Neighbouring windows with one anchor form a *strip* of text.  Blocks send the distinct strips of shared anchors,
   with the smallest and largest document that has each.
3. A range cuts its strips into windows and sorts them most significant digit (8 bytes) first, keeping after
   each pass only suffixes that still have an equal; after the last digit the groups are
   exactly the repeated windows.  Each gets its smallest document.
4. Blocks get back the windows that a smaller document has, and cut them from every later document.

Defined cases: ids are integers (others raise an error); a null text is empty; a very long text is a row of a block of its own; a text shorter than the window keeps all bytes; rows with
one id count as one document (none takes bytes from the other); a null id is smaller than none and takes part
as the largest document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm import blocks as B
from routeloom.llm import kernels as K
from routeloom.llm import store

_ANCHOR = 32
_PLACE = K.U((1 << 20) - 1)
_LAST_ID = np.iinfo(np.int64).max
_ODD = [K.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def anchors(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each strip of a slab of less than 2**20 bytes."""
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U)
    if n < window:
        return none
    h = K.TABLE[data]
    step = 1
    for odd in _ODD:
        h = h[:-step] * odd + h[step:]
        h ^= h >> K.U(31)
        step *= 2
    h *= _ODD[0]
    h ^= h >> K.U(29)
    # least hash with the leftmost place that has it, over the window's 32-byte strings
    m = h & ~_PLACE
    m |= np.arange(len(m), dtype=K.U)
    span, width = 1, window - _ANCHOR + 1
    while span < width:
        step = min(span, width - span)
        m = np.minimum(m[:-step], m[step:])
        span += step
    place = (m & _PLACE).astype(np.int64)
    valid = np.zeros(len(m) + 1, bool)
    edges = np.zeros(n + 1, np.int32)
    a, b = offs[:-1], offs[1:] - window + 1
    real = b > a
    np.add.at(edges, a[real], 1)
    np.add.at(edges, b[real], -1)
    valid[:-1] = np.cumsum(edges[: len(m)]) > 0
    new = valid[:-1].copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-2]
    first = np.flatnonzero(new)
    ends = valid[:-1].copy()
    ends[:-1] &= (place[1:] != place[:-1]) | ~valid[1:-1]
    last = np.flatnonzero(ends)
    return first, last, K.mix(h[place[first]])  # anchors have small hashes; as keys they are spread evenly again


def strips(block: B.Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor hash and text number of all strips of a block."""
    out = []
    for lo, _, data, offs in block.chunks():
        # a text beyond the slab size is cut into overlapping slabs; strips at a seam may be split, windows are not lost
        for at in range(0, max(1, len(data)), 1 << 19):
            piece = data[at : at + (1 << 19) + window - 1]
            own = np.clip(offs - at, 0, len(piece))
            first, last, h = anchors(piece, own, window)
            out.append((first + at + block.offs[lo], last + at + block.offs[lo], h))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64)
    first, last, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return first, last, h, np.searchsorted(block.offs, first, "right") - 1


def _ids(block: B.Block) -> np.ndarray:
    return np.where(block.null_ids, _LAST_ID, block.ids)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash (stable), first place of each distinct hash in it, and which distinct hash each row has."""
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def _send_anchors(n: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = B.Block(row)
                _, _, h, doc = strips(block, window)
                if not len(h):
                    continue
                order, first, _ = _distinct(h)
                ids = _ids(block)[doc[order]]
                several = np.maximum.reduceat(ids, first) != np.minimum.reduceat(ids, first)
                keys = h[order[first]]
                at, a, b = B.cut(keys, n)
                low = keys.astype(np.uint32)
                rows = [(low[x:y].tobytes(), np.packbits(several[x:y]).tobytes()) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(np.full(len(at), block.number)), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))],
                    ["part", "block", "keys", "several"],
                )

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each block's vector of anchors: one bit each, set if two documents or more have it."""
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table["several"].to_pylist(), keys, strict=True)]
    every = np.concatenate(keys)
    _, which, counts = np.unique(every, return_inverse=True, return_counts=True)
    counts = np.maximum(counts, np.bincount(which, np.concatenate(several)) * 2)
    bits = counts[which] > 1
    ends = np.cumsum([len(k) for k in keys])
    out = [np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])]
    return pa.table({"block": table["block"], "part": table["part"], "bits": pa.array(out, pa.binary())})


def _chosen(block: B.Block, answers: list[dict], n: int, window: int):
    """Strips whose anchor is shared, in order of the anchors."""
    first, last, h, doc = strips(block, window)
    if not len(h) or not answers:
        return None
    order, start, which = _distinct(h)
    keys = h[order[start]]
    _, a, b = B.cut(keys, n)
    rows = sorted(answers, key=lambda r: r["part"])
    bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=y - x) for r, x, y in zip(rows, a, b, strict=True)])
    mine = np.flatnonzero(bits[which])
    return (first[mine], last[mine], h[mine], doc[mine]) if len(mine) else None


def _classes(block: B.Block, first, last, h, window: int):
    """Strips with equal anchor and bytes form a class: order by class, and where each class starts in it."""
    size = last - first + window
    width = 2 * window - _ANCHOR
    padded = np.concatenate((block.data, np.zeros(width, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[first].copy()
    rows[np.arange(width) >= size[:, None]] = 0
    word = np.concatenate((rows, np.zeros((len(rows), -width % 8), np.uint8)), axis=1).view(K.U)
    key = size.astype(K.U)
    for k in range(word.shape[1]):
        key = K.mix(key * _ODD[0] + word[:, k])
    order = np.lexsort((key, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]) | (word[order][1:] != word[order][:-1]).any(axis=1)
    return order, np.flatnonzero(new), rows, size


def _send_strips(n: int, window: int):
    names = ["part", "block", "n", "size", "low", "more", "body"]

    def apply(block: B.Block, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        found = _chosen(block, answers, n, window)
        if found is None:
            return
        first, last, h, doc = found
        order, start, rows, size = _classes(block, first, last, h, window)
        ids = _ids(block)[doc[order]]
        low, high = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
        lead = order[start]
        rows, size = rows[lead], size[lead]
        at, a, b = B.cut(h[lead], n)
        width = np.arange(rows.shape[1])
        out = []
        for p, x, y in zip(at.tolist(), a.tolist(), b.tolist(), strict=True):
            body = rows[x:y][width < size[x:y, None]]
            more = high[x:y] - low[x:y]
            out.append((p, block.number, y - x, B.pack(size[x:y].astype(np.uint8)), B.pack(low[x:y]), B.pack(more), B.pack(body)))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return apply, "part int, block long, n int, size binary, low binary, more binary, body binary"


def equal_windows(n: int, n_digits: int, digit: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix sort of ``n`` suffixes; ``digit(rows, k)`` is their k-th digit.

    Returns the rows that have an equal, in groups, and the first place of every group.
    """
    rows, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(n_digits):
        d = digit(rows, k)
        order = np.argsort(d, kind="stable")
        if k:
            order = order[np.argsort(group[order], kind="stable")]
        rows, d, group = rows[order], d[order], group[order]
        new = np.ones(len(rows), bool)
        new[1:] = (d[1:] != d[:-1]) | (group[1:] != group[:-1])
        alone = new & np.append(new[1:], True)
        rows, group = rows[~alone], (np.cumsum(new) - 1)[~alone]
    new = np.ones(len(rows), bool)
    new[1:] = group[1:] != group[:-1]
    return rows, np.flatnonzero(new)


def _sort_range(window: int):
    width = 2 * window - _ANCHOR

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size = np.concatenate([B.unpack(r["size"]) for r in rows]).astype(np.int64)
        low = np.concatenate([B.unpack(r["low"], np.int64) for r in rows])
        high = low + np.concatenate([B.unpack(r["more"], np.int64) for r in rows])
        body = np.concatenate([B.unpack(r["body"]) for r in rows])
        start = np.cumsum(size) - size
        # equal strips of different blocks are one: only their smallest document counts
        padded = np.concatenate((body, np.zeros(width, np.uint8)))
        whole = np.lib.stride_tricks.sliding_window_view(padded, width)[start].copy()
        whole[np.arange(width) >= size[:, None]] = 0
        whole = np.concatenate((whole, np.zeros((len(whole), -width % 8), np.uint8)), axis=1).view(K.U)
        key = size.astype(K.U)
        for k in range(whole.shape[1]):
            key = K.mix(key * _ODD[0] + whole[:, k])
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (size[order][1:] != size[order][:-1]) | (whole[order][1:] != whole[order][:-1]).any(axis=1)
        lead = np.flatnonzero(new)
        strip_of = np.empty(len(order), np.int64)
        strip_of[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(low[order], lead)
        lead = order[lead]
        del whole, key
        # windows of the distinct strips
        n_windows = size[lead] - window + 1
        w_end = np.cumsum(n_windows)
        strip = np.repeat(np.arange(len(lead)), n_windows)
        offset = np.arange(len(strip)) - np.repeat(w_end - n_windows, n_windows)
        place = start[lead][strip] + offset
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        steps = [*range(0, window - 7, 8)] + ([window - 8] if window % 8 else [])
        found = least[strip]
        members, groups = equal_windows(
            len(place), len(steps), lambda at, k: view[place[at] + steps[k]].copy().view(">u8").ravel().astype(K.U)
        )
        if len(members):
            best = np.minimum.reduceat(least[strip[members]], groups)
            found[members] = np.repeat(best, np.diff(np.append(groups, len(members))))
        # runs of windows of a strip with one smallest document; only what some document of it loses
        cut = np.ones(len(strip), bool)
        cut[1:] = (strip[1:] != strip[:-1]) | (found[1:] != found[:-1])
        run_at = np.flatnonzero(cut)
        run_n = np.diff(np.append(run_at, len(strip)))
        run_first = np.searchsorted(strip[run_at], np.arange(len(lead)))
        run_count = np.bincount(strip[run_at], minlength=len(lead))
        n_each = [r["n"] for r in rows]
        out, at = [], 0
        for r, count in zip(rows, n_each, strict=True):
            mine = strip_of[at : at + count]
            runs_of = run_count[mine]
            local = np.repeat(np.arange(count), runs_of)
            ends = np.cumsum(runs_of)
            which = np.repeat(run_first[mine] - (ends - runs_of), runs_of) + np.arange(ends[-1] if count else 0)
            source = found[run_at[which]]
            keep = source < high[at : at + count][local]
            which, local = which[keep], local[keep]
            if len(which):
                at_run = run_at[which]
                cuts = (local.astype(np.int32), offset[at_run].astype(np.uint8), run_n[which].astype(np.uint8), found[at_run])
                out.append((r["block"], r["part"], *map(B.pack, cuts)))
            at += count
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "part", *_CUT])

    return run


#: Of each run of windows to cut: class in the block's range, first window in the strip, windows, smallest document.
_CUT = ("cls", "skip", "count", "source")


def _cut_block(n: int, window: int, whole_characters: bool):
    def apply(block: B.Block, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        delta = np.zeros(len(block.data) + 1, np.int32)
        ids = _ids(block)
        cuts = [r for r in rows if r["cls"] is not None]
        if cuts:
            first, last, h, doc = _chosen(block, [r for r in rows if r["bits"] is not None], n, window)
            order, begin, _, _ = _classes(block, first, last, h, window)
            members = np.diff(np.append(begin, len(order)))
            class_at = {p: a for p, a, _ in zip(*(x.tolist() for x in B.cut(h[order[begin]], n)), strict=True)}
            first, doc = first[order], ids[doc[order]]
            for r in cuts:
                cls = B.unpack(r["cls"], np.int32).astype(np.int64) + class_at[r["part"]]
                skip, count, source = B.unpack(r["skip"]), B.unpack(r["count"]), B.unpack(r["source"], np.int64)
                m = members[cls]
                ends = np.cumsum(m)
                which = np.repeat(begin[cls] - (ends - m), m) + np.arange(ends[-1])
                loses = doc[which] > np.repeat(source, m)
                a = first[which] + np.repeat(skip, m)
                b = a + np.repeat(count.astype(np.int64), m) + window - 1
                np.add.at(delta, a[loses], 1)
                np.add.at(delta, b[loses], -1)
        gone = np.cumsum(delta[:-1]) > 0
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        inner = block.offs[1:-1]
        if len(gone):  # a run ends with its text
            seam = inner[(inner > 0) & (inner < len(gone))]
            seam = np.unique(seam[gone[seam - 1] & gone[seam]])
        else:
            seam = np.zeros(0, np.int64)
        starts = np.sort(np.concatenate((np.flatnonzero(edge > 0), seam)))
        stops = np.sort(np.concatenate((np.flatnonzero(edge < 0), seam)))
        if whole_characters:
            lead = np.append(K.LEAD[block.data], True)
            for _ in range(3):
                starts = starts + ((starts < stops) & ~lead[starts])
                stops = stops - ((stops > starts) & ~lead[stops])
            real = stops > starts
            starts, stops = starts[real], stops[real]
            gone = np.zeros(len(block.data) + 1, np.int8)
            gone[starts] += 1
            gone[stops] -= 1
            gone = np.cumsum(gone[:-1]) > 0
        doc_of = np.searchsorted(block.offs, starts, "right") - 1
        kept = block.data[~gone]
        kept_offs = np.concatenate(([0], np.cumsum(~gone)))[block.offs].astype(np.int32)
        per = np.bincount(doc_of, minlength=len(block.ids))
        span_offs = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
        base = block.offs[doc_of]
        spans = pa.ListArray.from_arrays(
            pa.array(span_offs),
            pa.StructArray.from_arrays([pa.array(starts - base), pa.array(stops - base)], ["start", "stop"]),
        )
        texts = pa.Array.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(kept_offs.tobytes()), pa.py_buffer(kept.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [block.doc_ids(), block.extra(), pa.array(np.diff(block.offs)), spans, texts], ["doc_id", "extra", "n_bytes", "spans", "kept"]
        )

    return apply, "doc_id long, extra string, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def remove_repeats(
    docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None,
    whole_characters: bool = False,
) -> DataFrame:
    """One row per document: doc_id, extra (JSON that goes with the row), n_bytes, spans (removed, maximal) and kept (the other bytes).

    With ``whole_characters`` a span starts and stops between characters: one that a repeat cuts in two stays whole.
    """
    if not _ANCHOR < window <= 64:
        raise ValueError("window is 33 to 64 bytes")
    table = B.make_blocks(docs, "texts", id_col, text_col, extra)
    n = B.ranges(table, 8 << 20)
    sent = table.mapInArrow(K.lean(_send_anchors(n, window)), "part int, block long, keys binary, several binary")
    shared = store.materialize(sent.groupBy("part").applyInArrow(_shared, "block long, part int, bits binary"), "shared")
    del sent
    store.tidy(docs.sparkSession)
    apply, schema = _send_strips(n, window)
    sent = B.back_to_blocks(table, shared, apply, schema)
    found = sent.groupBy("part").applyInArrow(_sort_range(window), "block long, part int, " + ", ".join(f"{c} binary" for c in _CUT))
    found = store.materialize(found, "cuts")
    del sent
    store.tidy(docs.sparkSession)
    apply, schema = _cut_block(n, window, whole_characters)
    return B.back_to_blocks(table, found.unionByName(shared, allowMissingColumns=True), apply, schema)
