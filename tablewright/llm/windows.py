"""Fixed-length windows over texts, cut into runs that share an anchor.

A window's anchor is the smallest hash among its short grams, the rightmost if it occurs twice, so equal windows have
equal anchors at equal places. Neighbouring windows with one anchor form a run. A run is kept as two 64-bit numbers,
its anchor and the hash of its content: about one row for twenty words or two hundred bytes, instead of one per window.
Equal windows can only be found in runs of the same anchor.

Hashes are polynomials over random values modulo 2^64, so that prefix sums give the hash of any stretch at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time, unless one text is longer.
BLOCK_BYTES = 1 << 19
U = np.uint64


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUE_OF_BYTE = scrambled(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK_BYTES * 2, 1 << int(n).bit_length()))


class Prefix:
    """Prefix sums of a sequence of 64-bit values; ``of(a, b)`` hashes the stretches from a up to b."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, a, b) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (from 0) of slices of a text column; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the number of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = _IS_BLANK[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[0] = after[-1] = True
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return scrambled(Prefix(VALUE_OF_BYTE[data]).of(starts, ends) + (ends - starts).astype(np.uint64))


def grams(prefix: Prefix, size: int) -> np.ndarray:
    n = len(prefix.sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return scrambled(prefix.of(at, at + size))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    rest = width - done
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


def runs(prefix: Prefix, bounds: np.ndarray, window: int, gram: int):
    """Anchor, content hash, text number, first window and number of windows of each run."""
    g, width = grams(prefix, gram), window - gram + 1
    least = sliding_least(g, width)
    if not len(least):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    n = len(least)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = owner[:n] == owner[window - 1:]
    fresh = np.empty(n, bool)
    fresh[0] = True
    # another anchor, another text, or the same anchor once more on the right
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:n] != owner[:n - 1]) | ~ok[:-1] | (g[width:] == least[1:])
    edge = np.flatnonzero(fresh)
    length = np.diff(np.append(edge, n))
    real = ok[edge]
    edge, length = edge[real], length[real]
    # a run that reaches a text's end stops at its last whole window
    last = bounds[owner[edge] + 1] - window - edge + 1
    length = np.minimum(length, last)
    content = scrambled(prefix.of(edge, edge + length - 1 + window) + length.astype(np.uint64))
    return least[edge].view(np.int64), content.view(np.int64), owner[edge], edge - bounds[owner[edge]], length


def collapsed(anchor, content, owner, start, length, ids: np.ndarray) -> pa.RecordBatch:
    """One row per anchor, content and document, with all its starts."""
    doc = ids[owner]
    by = np.lexsort((start, doc, content, anchor))
    a, c, d, s, n = anchor[by], content[by], doc[by], start[by], length[by]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    starts = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), pa.array(s, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[at]), pa.array(c[at]), pa.array(d[at], pa.int64()), starts, pa.array(n[at], pa.int32())], ["anchor", "content", "doc_id", "starts", "n"]
    )


RUN_SCHEMA = "anchor long, content long, doc_id long, starts array<int>, n int"


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` units lie in any of the stretches; what reaches beyond the end is cut there."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.minimum(starts, size), 1)
    np.add.at(change, np.minimum(starts + lengths, size), -1)
    return np.cumsum(change[:-1]) > 0


def stretch_index(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches laid end to end: the stretch of each element, and its place in it."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
