"""Words, hashes and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

All functions work on chunks of whole texts of about half a megabyte, so memory does not depend on how
many rows an Arrow batch has; a text that is longer makes a chunk of its own.  Null texts count as
empty.  Words are runs of bytes other than ASCII white space (0x20, 0x09 to 0x0D).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hunkwise.session import cut

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: True for bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80
CHUNK = 1 << 19
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int = 0) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


BYTE = seeds(256, 77)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
R = 0xD6E8FEB86659FD93
R_INV = pow(R, -1, 1 << 64)
STEP = seeds(64, 5)
_POWERS: dict[int, np.ndarray] = {}
#: glibc's, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 16), base, U)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if len(p) <= 4 * CHUNK:
            _POWERS[base] = p
    return p[:n]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the len+1 offsets of its texts in them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays([c.cast(pa.large_binary()) for c in arr.chunks]) if arr.num_chunks else pa.array([], pa.large_binary())
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    at = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def chunks(arr: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    buf, at = buffers(arr)
    n, i = len(at) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1), i + 20_000)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    release()


def release() -> None:
    """Gives memory that is free back to the system.

    The allocators of numpy and Arrow keep it otherwise, and so does a worker that waits for its next task.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def prefix(buf: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Running sums by which ``span_hash`` hashes any stretch of bytes."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(table[buf] * powers(R, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte stretches: equal bytes give equal hashes wherever they stand."""
    back = powers(R_INV, len(sums))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U) * STEP[0])


class Words:
    """Words of a chunk: byte ``start`` and ``end``, ``doc`` (row in the chunk), hash ``h``; ``first`` has rows' word offsets."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, table: np.ndarray = BYTE, hashed: bool = True):
        n, docs = len(buf), len(at) - 1
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~SPACE[buf]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        inner = word[1:]  # whether the byte at a place is of a word; the end is not
        before = word[:-1]
        self.start = np.flatnonzero(inner & (~before | cut))
        self.end = np.flatnonzero(before & (~inner | cut))
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.count)
        self.buf, self.at = buf, at
        if hashed:
            self.sums = prefix(buf, table)
            self.h = span_hash(self.sums, self.start, self.end)

    def left(self) -> np.ndarray:
        """How many words the text has from each word on."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all windows of k words; with ``short`` a text of fewer words has one window of all."""
        n, left = len(self.start), self.left()
        acc = np.zeros(n, U)
        for j in range(min(k, n)):
            acc[: n - j] += self.h[j:] * STEP[j] * (left[: n - j] > j)
        keep = left >= k
        if short:
            keep[self.first[:-1][self.count > 0]] = True
        i = np.flatnonzero(keep)
        return i, mix(acc[i])


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows' offsets, hashes) of the 5-word shingles, repeated ones included; a shorter text is one shingle."""
    i, h = w.windows(SHINGLE, short=True)
    return np.searchsorted(w.doc[i], np.arange(len(w.at))), h


def lines(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number from 0) of the lines of a chunk's texts, without the line ends."""
    end = np.flatnonzero(buf == 10)
    docs = len(at) - 1
    start = np.concatenate([at[:-1], end + 1])
    row = np.concatenate([np.arange(docs), np.searchsorted(at, end, "right") - 1])
    order = np.argsort(start + row, kind="stable")  # an empty text's line stands before the next text's first
    start, row = start[order], row[order]
    first = np.searchsorted(row, np.arange(docs))
    # A line ends at the break before the next one's start, or with its text.
    last = np.append(row[1:] != row[:-1], True) if docs else np.zeros(0, bool)
    stop = np.append(start[1:] - 1, len(buf))[: len(start)]
    stop = np.where(last, at[row + 1], stop)
    return start, stop, row, np.arange(len(row)) - first[row]


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte place the number of code points before it in the chunk."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(LEAD[buf], out=out[1:])
    return out


def block_sums(parts: DataFrame, merge=np.add, dtype=np.int64) -> dict[int, np.ndarray]:
    """Arrays that tasks made in blocks (block, data), merged by block as they stream by and then on the driver.

    For sketches of fixed size only: what arrives at the driver is as large as the sketch.
    """
    numpy_type = np.dtype(dtype).str

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(data, numpy_type)
                sums[k] = merge(sums[k], x) if k in sums else x
        if sums:
            yield block_rows(list(sums), list(sums.values()))

    out: dict[int, np.ndarray] = {}
    for r in parts.repartition("block").mapInArrow(summed, BLOCK_SCHEMA).collect():
        x = np.frombuffer(r["data"], numpy_type)
        out[r["block"]] = merge(out[r["block"]], x) if r["block"] in out else x
    return out


BLOCK_SCHEMA = "block long, data binary"


def block_rows(keys, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(keys, np.int64)), pa.array([np.ascontiguousarray(x).tobytes() for x in arrays], pa.binary())], ["block", "data"])


MAP_BLOCK = 1 << 13


#: Bounds of a bit map's size; beyond the upper one more of the other rows pass it, and joins drop them.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bit_map(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A bit map of a column of 64-bit hashes, of ``bits`` bits or, within the bounds, 64 to 128 a row."""
    if bits is None:
        bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (64 * df.count()).bit_length()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(U) % U(bits)
            np.bitwise_or.at(own, (h >> U(3)).astype(np.int64), (1 << (h & U(7)).astype(np.uint8)).astype(np.uint8))
        own = own.reshape(-1, MAP_BLOCK)
        full = np.flatnonzero(own.any(1))
        if len(full):
            yield block_rows(full, own[full])

    out = np.zeros((bits // 8 // MAP_BLOCK, MAP_BLOCK), np.uint8)
    for k, x in block_sums(df.select(column).mapInArrow(partial, BLOCK_SCHEMA), np.bitwise_or, np.uint8).items():
        out[k] = x
    return out.reshape(-1)


#: Keys that are sorted at once, and that a task gathers before it deals them out.
PART, GATHER = 1 << 20, 1 << 19


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], n: int) -> DataFrame:
    """(hash): the 64-bit hashes that several owners have, of about n in all.

    hashes: of a batch, arrays of hashes and of their owners, or hashes and None where each stands for
    an owner of its own.  Hashes are dealt by range in packed blocks, each of which holds a hash of a
    task's rows with two owners at most; so a part has as many as its range has different ones for each
    task, and no frequent one grows.
    """
    parts = max(1, -(-n // PART))

    def few(own: list[np.ndarray]) -> np.ndarray:
        """Sorted (hash, owner), each once, of a hash two owners at most."""
        x = np.concatenate(own)
        if x.shape[1] == 1:
            x = np.sort(x, 0)
        else:
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            x = x[np.append(True, (x[1:] != x[:-1]).any(1))] if len(x) else x
        again = x[1:, 0] == x[:-1, 0]
        return x[~np.append(False, again & np.append(False, again[:-1]))] if len(x) else x

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0

        def packed() -> pa.RecordBatch:
            x = few(own)
            part = ((x[:, 0] >> U(32)) * U(parts)) >> U(32)
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(x) else np.zeros(0, np.int64)
            return block_rows(2 * part[heads].astype(np.int64) + x.shape[1] - 1, np.split(x, heads[1:]) if len(x) else [])

        for b in batches:
            for h, owner in hashes(b):
                own.append(h.view(U)[:, None] if owner is None else np.stack([h.view(U), owner.view(U)], 1))
                size += len(h)
                if size >= GATHER:
                    yield packed()
                    own, size = [], 0
        if own:
            yield packed()

    def twice(own: list[bytes], width: int) -> pa.RecordBatch:
        x = few([np.frombuffer(d, U).reshape(-1, width) for d in own])[:, 0].copy().view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(x[1:][x[1:] == x[:-1]]))], ["hash"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != at and own:
                    yield twice(own, at % 2 + 1)
                    own = []
                at = k
                own.append(data)
        if own:
            yield twice(own, at % 2 + 1)

    dealt = df.mapInArrow(deal, BLOCK_SCHEMA).repartition("block").sortWithinPartitions("block")
    return cut(dealt.mapInArrow(merge, "hash long"), "repeated")


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether hashes (int64) may be among those of the map; those that are, are."""
    h = hashes.view(U) % U(len(bits) * 8)
    return (bits[(h >> U(3)).astype(np.int64)] >> (h & U(7)).astype(np.uint8)) & 1 > 0
