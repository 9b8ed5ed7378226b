"""Words and rolling hashes of many texts at once, on the bytes of Arrow strings.

Texts are taken in blocks of whole rows of about ``BLOCK`` bytes, so memory
follows the block and not the task; a longer text is a block of its own.
Hashes are 64 bits wide.  A word's is a polynomial of its bytes, finished by a
mixer, so equal words get equal hashes in every task and process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (the public-domain splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(key) * U(0x2545F491)) * _ODD)


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words: all but blanks and line breaks; and letters, digits and all beyond ASCII.
NO_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = byte_class(
    lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@cache
def _tables(fold: bool) -> np.ndarray:
    table = seeds(256, 77)
    return table[LOWER] if fold else table


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 2**bits of each."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for b in (int(_BASE), inverse):
        p = np.full(1 << bits, U(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


@dataclass
class Block:
    """Rows ``first`` up to ``first + len(ends)``; text i is data[starts[i]:ends[i]]."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK, rows: int = 1 << 20) -> Iterator[Block]:
    """Blocks of a string or binary column, of at most ``rows`` rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(kind)
    column = pc.fill_null(column, b"")
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + n + 1]
    offsets = offsets.astype(np.int64)
    data = (
        np.frombuffer(buffers[2], dtype=np.uint8)
        if buffers[2] is not None and buffers[2].size
        else np.zeros(0, np.uint8)
    )
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to), at + rows)
        low, high = offsets[at], offsets[to]
        yield Block(at, data[low:high], offsets[at:to] - low, offsets[at + 1 : to + 1] - low)
        at = to


@dataclass
class Words:
    """Word j is data[starts[j]:ends[j]]; text i has words first[i] up to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _edges(inside: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none crossing a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = block.starts[(block.starts > 0) & (block.starts < n)]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool
) -> np.ndarray:
    """Hash of each span of ``data``."""
    return sums_hash(hash_sums(data, fold), starts, ends)


def hash_sums(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums from which ``sums_hash`` takes the hash of any span."""
    _, inverse = _powers(max(20, int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_tables(fold)[data] * inverse[: len(data)], dtype=U, out=sums[1:])
    return sums


def sums_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, _ = _powers(max(20, int(len(sums) - 1).bit_length()))
    h = (sums[ends] - sums[starts]) * power[starts]
    return mix(h ^ ((ends - starts).astype(U) * _ODD))


def words(block: Block, kept: np.ndarray = NO_SPACE, fold: bool = True) -> Words:
    """Words of each text (runs of ``kept`` bytes); ``fold`` lower-cases A-Z."""
    starts, ends = _edges(kept[block.data], block)
    first = np.searchsorted(starts, np.append(block.starts, len(block.data)))
    return Words(starts, ends, first, span_hashes(block.data, starts, ends, fold))


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text and their bounds.

    A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    w, first = found.hashes, found.first
    counts = np.diff(first)
    n = len(w)
    factor = seeds(width, 5) | U(1)
    whole = np.zeros(n, U)
    for k in range(width):
        if n > k:
            whole[: n - k] += w[k:] * factor[k]
    whole = mix(whole)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = first[i], first[i + 1]
        short = (w[a:b] * factor[: b - a]).sum(dtype=U, keepdims=True)
        whole[a : a + 1] = mix(short ^ seeds(int(b - a), 17)[-1])
    made = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    take = np.repeat(first[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    return whole[take], bounds


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (two-pass block scan)."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by ``keys``, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in columns)
        new[0] = last is None or head != last
        last = tuple(c[-1] for c in columns)
        at = np.append(np.flatnonzero(new), batch.num_rows)
        if at[0] > 0:
            held.append(batch.slice(0, at[0]))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)
