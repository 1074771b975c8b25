"""Pairs of number sets with enough in common, counted by products of blocks of their bit rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import ordered
from tablewright.session import stored

OWN = 384  # the most frequent numbers have a column each
LEAST_HASHED, MOST_HASHED = 128, 2048  # all others share so many
BLOCK_BYTES = 64 << 20
LEAST_ROWS = 1024  # below that a block is not made smaller to keep more tasks busy
TILE_X, TILE_Y = 512, 3072  # a multiple of 6: three rows are packed in one float, and hits are looked for eight bytes at a time
CHECKED = 1 << 21  # numbers compared at once
SLACK = 1e-9

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need not find this library


def similar_pairs(sets: DataFrame, a: str, b: str, threshold: float, ascending: bool = False) -> DataFrame:
    """``a b similarity`` of the pairs of sets whose common share is at least ``threshold``.

    ``sets`` has distinct texts ``txt``, flags ``l`` and ``r`` of the sides a text is on, and ``gs``, its distinct numbers.
    Rows are dealt into blocks by their text, and each pair of blocks is one group, so that memory is bound by the size of
    a block and work by nothing but the pairs. In a group the numbers two rows have in common are bounded by a matrix
    product: one column for each frequent number, and the others hashed into a few, counted on one side and marked on the
    other. Pairs that cannot reach the threshold by that bound end there, the others are counted on their numbers. Both
    sides are dealt as one, so a pair of texts is looked at once, also where both are on both sides.
    """
    spark = sets.sparkSession
    # filtered when stored: a filter on the numbers would be moved in front of whatever makes the texts distinct
    sets = stored(sets, "sets").filter(F.size("gs") > 0)
    counts = sets.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "g").limit(OWN).collect()
    kinds = sets.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gs")).alias("m"), F.sum(F.octet_length("txt")).alias("chars")).collect()
    rows = {(k["l"], k["r"]): k["n"] for k in kinds}
    every, numbers = max(sum(rows.values()), 1), max(sum(k["m"] for k in kinds), 1)
    rest = (numbers - sum(t["n"] for t in top)) / every
    # rows of that many other numbers have rest² / hashed columns in common by chance: a twenty-fifth of their size
    hashed = 1 << max(math.ceil(math.log2(max(25 * rest * rest * every / numbers, 1))), 0)
    hashed = min(max(hashed, LEAST_HASHED), MOST_HASHED)

    most = max(int(BLOCK_BYTES / (4 * (OWN + hashed) + 8 * rest + sum(k["chars"] for k in kinds) / every)), 1)
    tasks = ordered.default_chunks(sets)
    blocks = [
        max(-(-n // most), min(-(-n // LEAST_ROWS), math.ceil(math.sqrt(tasks))))
        for n in (rows.get((True, False), 0), rows.get((True, True), 0), rows.get((False, True), 0))
    ]
    starts = [0, blocks[0], blocks[0] + blocks[1]]
    total = sum(blocks)
    dealt = lambda i: F.lit(starts[i]) + F.pmod(F.xxhash64("txt"), F.lit(max(blocks[i], 1)))
    block = F.when(~F.col("r"), dealt(0)).when(F.col("l"), dealt(1)).otherwise(dealt(2))

    own = np.sort(np.array([t["g"] for t in top], dtype=np.int64))
    packed = sets.mapInArrow(lambda batches: pack(batches, own), "txt string, l boolean, r boolean, size int, own binary, others binary")
    packed = packed.withColumn("block", block)
    # blocks of the left side alone come first, then those on both sides, then those of the right side alone
    other = F.broadcast(spark.range(total).select(F.col("id").alias("other")))
    meet = (F.col("l") & (F.col("other") >= starts[1])) | (F.col("r") & (F.col("other") < starts[2]))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    copies = packed.join(other, meet).select(
        (F.floor(high * (high + 1) / 2) + low).cast("long").alias("pair"), (F.col("block") == F.col("other")).alias("same"), (F.col("block") < F.col("other")).alias("low"),
        "txt", "l", "r", "size", "own", "others",
    )
    parts = min(max(total * (total + 1) // 2, 1), ordered.MAX_CHUNKS)
    groups = copies.repartitionById(parts, F.pmod("pair", F.lit(parts)).cast("int")).sortWithinPartitions("pair")
    schema = f"`{a}` string, `{b}` string, similarity double"
    return groups.mapInArrow(lambda batches: grouped(batches, hashed, threshold, ascending, (a, b)), schema)


def pack(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bits of the numbers in ``own``, which is sorted, and all other numbers as bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lists = batch.column("gs")
        size, values = pc.list_value_length(lists).to_numpy().astype(np.int32), lists.flatten().to_numpy()
        row = np.repeat(np.arange(n), size)
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        known = own[at] == values
        bits = np.zeros((n, OWN), np.uint8)
        bits[row[known], at[known]] = 1
        others = np.bincount(row[~known], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("txt"), batch.column("l"), batch.column("r"), pa.array(size),
                _binary(np.full(n, OWN // 8), np.packbits(bits, axis=1, bitorder="little")), _binary(8 * others, values[~known]),
            ],
            ["txt", "l", "r", "size", "own", "others"],
        )


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of bytes, and where those of each row begin."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data.view(dtype), (ends - ends[0]) // np.dtype(dtype).itemsize


def grouped(batches: Iterator[pa.RecordBatch], hashed: int, threshold: float, ascending: bool, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Matches of each run of rows with one ``pair``, which stand together."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        pair = batch.column("pair").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if held and pair[start] != now:
                yield from matches(held, hashed, threshold, ascending, names)
                held = []
            now = pair[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield from matches(held, hashed, threshold, ascending, names)


class Block:
    """Rows of one block, smallest first."""

    def __init__(self, rows: pa.Table, hashed: int):
        rows = rows.take(pa.array(np.argsort(rows["size"].to_numpy(), kind="stable"))).combine_chunks()
        column = lambda name: rows[name].combine_chunks()
        self.n, self.hashed = rows.num_rows, hashed
        self.txt, self.size = column("txt"), column("size").to_numpy().astype(np.int64)
        self.l, self.r = (column(c).to_numpy(zero_copy_only=False) for c in "lr")
        self.own = _bytes(column("own"), np.uint8)[0].reshape(self.n, OWN // 8)
        self.words = np.ascontiguousarray(self.own).view(np.uint64)
        self.others, self.starts = _bytes(column("others"), np.int64)
        self.row = np.repeat(np.arange(self.n), np.diff(self.starts))
        mixed = self.others.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.column = OWN + (mixed >> np.uint64(65 - hashed.bit_length())).astype(np.int64)

    def counts(self, start: int, end: int) -> np.ndarray:
        """Own numbers as 0 and 1, others as how many share a column."""
        out = np.zeros((end - start, OWN + self.hashed), np.float32)
        out[:, :OWN] = np.unpackbits(self.own[start:end], axis=1, bitorder="little")
        part = slice(self.starts[start], self.starts[end])
        np.add.at(out, (self.row[part] - start, self.column[part]), 1)
        return out


def matches(held: list[pa.RecordBatch], hashed: int, threshold: float, ascending: bool, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Similar pairs between two blocks, or within one."""
    rows = pa.Table.from_batches(held)
    held.clear()
    same = rows["same"][0].as_py()
    if same:
        x = y = Block(rows, hashed)
    else:
        x, y = Block(rows.filter(rows["low"]), hashed), Block(rows.filter(pc.invert(rows["low"])), hashed)
    if not (x.n and y.n):
        return
    del rows
    share = threshold / (1.0 + threshold)
    txt = x.txt if same else pa.concat_arrays([x.txt, y.txt])
    after = 0 if same else x.n  # of rows of y in that list
    left, right = (x.l, x.r) if same else (np.concatenate([x.l, y.l]), np.concatenate([x.r, y.r]))
    if ascending:
        rank = np.empty(len(txt), np.int64)
        rank[pc.sort_indices(txt.cast(pa.large_binary())).to_numpy()] = np.arange(len(txt))
    ids = np.unique(np.concatenate([x.others, y.others]))
    number = np.searchsorted(ids, x.others)
    keys = np.sort(y.row * len(ids) + np.searchsorted(ids, y.others))
    lengths = np.diff(x.starts)

    def checked(i: np.ndarray, j: np.ndarray, first: int, last: int) -> pa.RecordBatch | None:
        """Those of the pairs of rows that are similar; rows of y are in the tile from ``first`` to ``last``."""
        shared = np.bitwise_count(x.words[i] & y.words[j]).sum(axis=1, dtype=np.int64)
        n = lengths[i]
        some = keys[y.starts[first]:y.starts[last]]
        if len(some) and n.sum():
            of = np.repeat(np.arange(len(i)), n)
            at = np.repeat(x.starts[i] - (np.cumsum(n) - n), n) + np.arange(len(of))
            wanted = j[of] * len(ids) + number[at]
            hit = some[np.minimum(np.searchsorted(some, wanted), len(some) - 1)] == wanted
            shared += np.bincount(of[hit], minlength=len(i))
        similarity = shared / (x.size[i] + y.size[j] - shared)
        keep = (shared > 0) & (similarity >= threshold)
        p, q, similarity = i[keep], j[keep] + after, similarity[keep]
        if ascending:
            p, q = np.where(rank[p] < rank[q], p, q), np.where(rank[p] < rank[q], q, p)
            keep = left[p] & right[q] & (p != q)
            p, q, similarity = p[keep], q[keep], similarity[keep]
        else:
            there, back = left[p] & right[q], left[q] & right[p] & (p != q)
            p, q, similarity = np.concatenate([p[there], q[back]]), np.concatenate([q[there], p[back]]), np.concatenate([similarity[there], similarity[back]])
        if len(p):
            return pa.RecordBatch.from_arrays([txt.take(pa.array(p)), txt.take(pa.array(q)), pa.array(similarity)], [*names, "similarity"])
        return None

    # needed are at least ceil(share * m) and floor(share * n): what rows need less than others of their tile is added
    # to what they have, by two more columns, so that one number is the limit of a tile
    needx, needy = np.maximum(np.ceil(share * x.size - SLACK), 1).astype(np.int64), np.maximum(np.floor(share * y.size - SLACK), 0).astype(np.int64)
    sparex = needx[np.minimum(np.arange(x.n) // TILE_X * TILE_X + TILE_X, x.n) - 1] - needx
    counts = np.concatenate([x.counts(0, x.n), sparex[:, None].astype(np.float32), np.ones((x.n, 1), np.float32)], axis=1)
    ready: list[pa.RecordBatch] = []
    for first in range(0, y.n, TILE_Y):
        last = min(first + TILE_Y, y.n)
        sparey = needy[last - 1] - needy[first:last]
        marks = (y.counts(first, last) > 0).astype(np.float32)
        marks = np.concatenate([marks, np.ones((last - first, 1), np.float32), sparey[:, None].astype(np.float32)], axis=1)
        marks = np.concatenate([marks, np.zeros((-len(marks) % 6, marks.shape[1]), np.float32)])
        # a count below 256 is exact in eight bits, and three of them in the 24 bits of a float
        three = np.ascontiguousarray((marks[0::3] + 256 * marks[1::3] + 65536 * marks[2::3]).T)
        one = None
        for start in range(0, last if same else x.n, TILE_X):
            end = min(start + TILE_X, x.n)
            if x.size[end - 1] < share * (x.size[end - 1] + y.size[first]) - SLACK or y.size[last - 1] < share * (x.size[start] + y.size[last - 1]) - SLACK:
                continue  # even the sizes differ too much
            least = needx[end - 1] + needy[last - 1]
            if x.size[end - 1] + sparex[start] + sparey[0] < 256 and least < 256:
                bound = (counts[start:end] @ three).astype(np.int32).view(np.uint8)
                hit = bound >= np.uint8(least)
                place = np.flatnonzero(hit.view(np.uint64))
                which, byte = np.nonzero(hit.reshape(-1, 8)[place])
                place = place[which] * 8 + byte
                i, j = np.divmod(place, bound.shape[1])
                j = j // 4 * 3 + j % 4
            else:
                one = np.ascontiguousarray(marks.T) if one is None else one
                bound = counts[start:end] @ one
                place = np.flatnonzero(bound >= least)
                i, j = np.divmod(place, bound.shape[1])
            bound, i, j = bound.ravel()[place] - sparey[j], i + start, j + first
            keep = bound - sparex[i] >= share * (x.size[i] + y.size[j]) - SLACK
            if same:
                keep &= i <= j
            i, j = i[keep], j[keep]
            step = max(CHECKED // (1 + int(lengths[start:end].max()) + OWN // 64), 1)
            for k in range(0, len(i), step):
                found = checked(i[k:k + step], j[k:k + step], first, last)
                if found is not None:
                    ready.append(found)
                    if sum(f.num_rows for f in ready) >= 10_000:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready = []
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
