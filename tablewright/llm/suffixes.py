"""Suffix-array dedup over bytes with hash-compared suffixes.

Texts are cut into runs of 400-byte windows that share an anchor (``windows``); equal strings have equal anchors, so
the suffixes that start in runs of one anchor form a bucket, and only buckets with two runs are sorted. A run whose
whole content occurs twice is settled: all its suffixes are duplicates. One run of each distinct content is opened.

Suffixes of a bucket are sorted by bottom-up mergesort, all buckets of a block of rows at once. Two suffixes are
compared through prefix polynomial hashes: binary search finds their longest common extension, the byte after it
decides. Sorted neighbours whose common extension reaches 400 bytes are duplicates, after their bytes are compared.

Hot buckets, of more than ``PIECE`` contents, are dealt anew by longer anchors: the suffixes of a run fall into ranges of
their distance to the anchor, and all suffixes of a range share some bytes before the anchor and some after it. These
bytes are the new anchor, so equal suffixes still meet, while a common passage in different surroundings falls apart
into single runs and a few short ones. What is still hot is split by content into pieces that are sorted on their own;
what is single in its piece then meets the other pieces by the hash of its 400 bytes, which Spark sums before its
shuffle.

Defined results: a null or empty text has no bytes; a text below 400 bytes loses nothing; strings repeated in one
document, overlapping or not, are removed at both places; repeated rows are texts of their own, so all their long
strings go, but different texts under one doc_id are not told apart; a null doc_id is kept whole; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import windows as w
from tablewright.llm.common import per_batch, record, ship, stored

LENGTH = 400
GRAM = 16
#: Contents of a bucket sorted in one piece.
PIECE = 1024
#: Limits of the distances to the anchor that hot buckets are dealt by.
RANGES = (0, 8, 32, 128, 257, 353, 377, 385)
#: Bytes of opened runs sorted at a time, which takes many times that memory. A piece is never cut; 1,024 contents hold 0.8 MB at most.
SORT_BYTES = 1 << 19


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def build():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, data, offsets in w.text_blocks(batch.column("text")):
                found = w.runs(w.Prefix(w.VALUE_OF_BYTE[data]), offsets, length, GRAM)
                yield w.collapsed(*found, ids[row:row + len(offsets) - 1])

        return step

    return per_batch(docs.filter("doc_id is not null").select(docs["doc_id"].cast("long"), "text"), build, w.RUN_SCHEMA)


OPENED = "doc_id long, anchor long, content long, place int, hot boolean, single boolean, start int, n int, raw binary"


def _place(raw: bytes, anchor: int, length: int) -> int:
    """Where the anchor lies in a run: the rightmost gram with that hash in the first window."""
    g = w.grams(w.Prefix(w.VALUE_OF_BYTE[np.frombuffer(raw, np.uint8, length)]), GRAM).view(np.int64)
    hits = np.flatnonzero(g == anchor)
    return int(hits[-1]) if len(hits) else -1


def _digest(raw: bytes, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=salt.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _dealt_anew(raw: bytes, anchor: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """New anchor, content, the anchor's place, first suffix and number of suffixes for each range a run touches."""
    place, n = _place(raw, anchor, length), len(raw) - length + 1
    ranges = [r * (length - GRAM + 1) // RANGES[-1] for r in RANGES]
    for low, high in zip(ranges, ranges[1:]) if place >= 0 else ():
        first, last = max(0, place - high + 1), min(n - 1, place - low)
        if first <= last:
            core = raw[place - low:place + length - high + 1]
            yield _digest(core, anchor + low), _digest(raw[first:last + length], 0), place - first, first, last - first + 1


def _opened(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs with their bytes; runs of hot buckets dealt anew."""

    def build():
        def step(batch: pa.RecordBatch):
            texts, lists = batch.column("text").cast(pa.binary()), batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = pa.RecordBatch.from_struct_array(lists.flatten())
            ids = batch.column("doc_id").to_numpy()
            fields = [flat.column(c).to_pylist() for c in ("anchor", "hot", "single", "start", "n")]
            rows: list[tuple] = []
            last, seen, size = -1, b"", 0
            for o, anchor, hot, single, start, n in zip(owner.tolist(), *fields):
                if o != last:
                    last, seen = o, texts[o].as_py() or b""
                raw = seen[start:start + n - 1 + length]
                if len(raw) != n - 1 + length:
                    continue  # a repeated doc_id brought another text
                if hot:
                    rows += [(ids[o], a, c, p, True, single, start + f, k, raw[f:f + k - 1 + length]) for a, c, p, f, k in _dealt_anew(raw, anchor, length)]
                else:
                    rows.append((ids[o], anchor, 0, -1, False, single, start, n, raw))
                size += len(raw)
                if size > SORT_BYTES:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
            names = "doc_id anchor content place hot single start n raw".split()
            return record(**{c: pa.array(v, k) for c, v, k in zip(names, zip(*rows), kinds)})

        return step

    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot", "single", "start", "n")).alias("wanted"))
    rows = docs.select(docs["doc_id"].cast("long"), "text").join(by_doc, "doc_id")
    return per_batch(rows, build, OPENED)


class Suffixes:
    """Suffixes at positions of a byte array, compared up to ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = w.Prefix(w.VALUE_OF_BYTE[data])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension, by binary search over prefix hashes."""
        sums, down = self.prefix.sums, self.prefix.down
        sx, sy, dx, dy = sums[x], sums[y], down[x], down[y]
        low = np.zeros(len(x), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            to = np.minimum(low + step, self.length)
            same = (sums[x + to] - sx) * dx == (sums[y + to] - sy) * dy
            low = np.where(same, to, low)
            step >>= 1
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y."""
        full = self.equal(x, y)
        out, rest = or_equal.copy(), np.flatnonzero(~full)
        x, y = x[rest], y[rest]
        at = self.common(x, y)
        out[rest] = self.data[x + at] < self.data[y + at]
        return out

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, n = self.prefix, self.length
        return p.of(x, x + n) == p.of(y, y + n)

    def sorted(self, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``at``; element i belongs to the bucket that starts at ``begin[i]`` and holds
        ``size[i]`` elements. Runs of 1, 2, 4, ... elements are merged: an element of a left run moves up by the number
        of elements of the right run before it, by binary search; those of the right run fill the other places."""
        order = np.arange(len(at))
        inside = np.arange(len(at)) - begin
        width, most = 1, int(size.max()) if len(size) else 0
        while width < most:
            left = np.flatnonzero((inside // width % 2 == 0) & (size > width))
            first = np.minimum((inside[left] // width + 1) * width, size[left])
            low, high = first.copy(), np.minimum(first + width, size[left])
            busy = np.flatnonzero(low < high)
            while len(busy):
                mid = (low[busy] + high[busy]) >> 1
                e = left[busy]
                before = self.less(at[order[begin[e] + mid]], at[order[e]], np.zeros(len(e), bool))
                low[busy] = np.where(before, mid + 1, low[busy])
                high[busy] = np.where(before, high[busy], mid)
                busy = busy[low[busy] < high[busy]]
            moved = np.ones(len(at), bool)
            moved[left] = False
            free = np.ones(len(at), bool)
            place = left + low - first
            free[place] = False
            fresh = np.empty_like(order)
            fresh[place] = order[left]
            fresh[np.flatnonzero(free)] = order[np.flatnonzero(moved)]
            order = fresh
            width *= 2
        return order


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int, home: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether the strings at x and y are equal byte by byte. Pairs between the same two stretches at the same shift
    are compared once, over the whole range they span."""
    if not len(x):
        return np.zeros(0, bool)
    by = np.lexsort((x, y - x, there, home))
    x, y, h, t = x[by], y[by], home[by], there[by]
    first = np.ones(len(x), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (np.diff(y - x) != 0) | (np.diff(x) > length)
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    span = np.append(x[at[1:] - 1], x[-1]) - x[at] + length
    which, place = w.stretch_index(span)
    bad = np.append(0, np.cumsum(data[x[at][which] + place] != data[y[at][which] + place]))
    begin = (np.cumsum(span) - span)[group] + x - x[at][group]
    out = np.empty(len(x), bool)
    out[by] = bad[begin + length] == bad[begin]
    return out


def sort_block(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For opened runs, whole pieces of buckets: the run and place of each suffix, whether an equal one is in its
    piece, and the hash of its first ``length`` bytes."""
    raw = rows.column("raw").combine_chunks().cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    anchor, piece = rows.column("anchor").to_numpy(), rows.column("piece").to_numpy()
    n = rows.column("n").to_numpy().astype(np.int64)
    s = Suffixes(data, length)
    # the anchor's place in a run: the rightmost gram with that hash in its first window
    found = rows.column("place").to_numpy().astype(np.int64)
    plain = np.flatnonzero(found < 0)
    if len(plain):
        g = w.grams(s.prefix, GRAM).view(np.int64)
        which, place = w.stretch_index(np.full(len(plain), length - GRAM + 1))
        hit = np.flatnonzero(g[bounds[plain][which] + place] == anchor[plain][which])
        found[plain[which[hit]]] = place[hit]  # the last one stays
    run, off = w.stretch_index(n)
    at = bounds[run] + off
    bucket = np.ones(len(n), bool)
    bucket[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    key = (np.cumsum(bucket) - 1)[run] * (1 << 20) + found[run] - off + (1 << 19)
    by = np.argsort(key, kind="stable")
    key, at, run, off = key[by], at[by], run[by], off[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(first, len(key)))
    order = s.sorted(at, np.repeat(first, sizes), np.repeat(sizes, sizes))
    at, run, off, key = at[order], run[order], off[order], key[order]
    near = np.flatnonzero(key[1:] == key[:-1])
    near = near[s.equal(at[near], at[near + 1])]
    near = near[_same_bytes(data, at[near], at[near + 1], length, run[near], run[near + 1])]
    twice = np.zeros(len(at), bool)
    twice[near] = twice[near + 1] = True
    return run, off, twice, w.scrambled(s.prefix.of(at, at + length)).view(np.int64)


def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring rows of sorted runs, whole pieces together: ``SORT_BYTES`` of runs at most, or one piece."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size < SORT_BYTES:
            continue
        rows = pa.Table.from_batches(held)
        ends = _piece_ends(rows)
        if len(ends) == 1:
            continue
        yield from _whole_pieces(rows, ends[:-1])
        rest = rows.slice(int(ends[-2])).combine_chunks()
        held, size = rest.to_batches(), rest.nbytes
    if held:
        rows = pa.Table.from_batches(held)
        yield from _whole_pieces(rows, _piece_ends(rows))


def _piece_ends(rows: pa.Table) -> np.ndarray:
    a, p = rows.column("anchor").to_numpy(), rows.column("piece").to_numpy()
    return np.append(np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1])) + 1, len(a))


def _whole_pieces(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.Table]:
    upto = np.cumsum(pc.binary_length(rows.column("raw")).to_numpy().astype(np.int64))[ends - 1]
    start = done = before = 0
    while done < len(ends):
        done = max(done + 1, int(np.searchsorted(upto, before + SORT_BYTES, "right")))
        yield rows.slice(start, int(ends[done - 1]) - start)
        start, before = int(ends[done - 1]), int(upto[done - 1])


def _sorted_pieces(opened: DataFrame, length: int) -> DataFrame:
    """``doc_id start n`` of duplicate stretches; with a hash, a suffix that still has to meet the other pieces."""

    def result(rows: pa.Table) -> pa.RecordBatch:
        run, off, twice, hashed = sort_block(rows, length)
        single = rows.column("single").to_numpy(zero_copy_only=False)
        pieces, doc = rows.column("pieces").to_numpy(), rows.column("doc_id").to_numpy()
        start, anchor = rows.column("start").to_numpy(), rows.column("anchor").to_numpy()
        # duplicates of runs that occur once, as stretches
        d = np.flatnonzero(twice & single[run])
        d = d[np.lexsort((off[d], run[d]))]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (run[d][1:] != run[d][:-1]) | (np.diff(off[d]) != 1)
        head = d[fresh]
        count = np.diff(np.append(np.flatnonzero(fresh), len(d)))
        # what meets other pieces: the suffixes of hot buckets
        m = np.flatnonzero(pieces[run] > 1)
        none = np.zeros(len(head), np.int64)
        return record(
            doc_id=np.append(doc[run[head]], doc[run[m]]), start=pa.array(np.append(start[run[head]] + off[head], start[run[m]] + off[m]), pa.int32()),
            n=pa.array(np.append(count, np.ones(len(m), np.int64)), pa.int32()), anchor=np.append(none, anchor[run[m]]), hash=np.append(none, hashed[m]),
            open=np.append(np.zeros(len(head), bool), np.ones(len(m), bool)), done=np.append(np.ones(len(head), bool), twice[m] | ~single[run[m]]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sort_blocks(batches):
            out = result(rows)
            if out.num_rows:
                yield out

    ship(opened.sparkSession)
    dealt = opened.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece")
    return dealt.mapInArrow(run, "doc_id long, start int, n int, anchor long, hash long, open boolean, done boolean")


def duplicate_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """``doc_id spans``: byte ranges ``(start, n)`` of strings that start twice; they may overlap."""
    runs = stored(_runs(docs, length), "suffix-runs")
    shared = runs.groupBy("anchor").agg(F.sum(F.size("starts")).alias("k")).filter("k > 1").select("anchor")
    runs = stored(runs.join(shared, "anchor"), "suffix-shared")
    contents = runs.groupBy("anchor", "content").agg(
        F.sum(F.size("starts")).alias("k"), F.min(F.struct("doc_id", F.get("starts", F.lit(0)).alias("start"), "n")).alias("one")
    )
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    settled = runs.join(contents.filter("k > 1").select("anchor", "content"), ["anchor", "content"])
    settled = settled.select("doc_id", F.explode("starts").alias("start"), "n")
    hot = F.col("contents") > piece
    wanted = contents.join(several, "anchor").select("one.*", "anchor", hot.alias("hot"), (F.col("k") == 1).alias("single"))
    opened = stored(_opened(docs, wanted, length), "suffix-opened")

    # hot buckets, under their new anchors
    anew = opened.filter("hot")
    alike = anew.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "start")).alias("one"))
    shared = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.sum("k").alias("rows")).filter("rows > 1")
    pieces = F.ceil(F.col("contents") / piece).cast("int")
    anew = anew.join(shared, "anchor").join(alike, ["anchor", "content"])
    settled_anew = anew.filter("k > 1 and single").select("doc_id", "start", "n")
    anew = anew.filter((F.col("contents") > 1) & (F.struct("doc_id", "start") == F.col("one"))).select(
        "doc_id", "anchor", F.pmod(F.xxhash64("content"), pieces).cast("int").alias("piece"), pieces.alias("pieces"), "place",
        (F.col("single") & (F.col("k") == 1)).alias("single"), "start", "n", "raw",
    )
    plain = opened.filter("not hot").select("doc_id", "anchor", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "place", "single", "start", "n", "raw")
    found = stored(_sorted_pieces(plain.unionByName(anew), length), "suffix-sorted")

    # what was split by content: each piece may hold an equal suffix
    open_ = found.filter("open")
    meet = open_.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("anchor", "hash")
    met = open_.filter("not done").join(meet, ["anchor", "hash"]).select("doc_id", "start", "n")
    spans = settled.unionByName(settled_anew).unionByName(found.filter("not open").select("doc_id", "start", "n")).unionByName(met)
    spans = spans.withColumn("n", F.col("n") + length - 1)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def op7(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    spans = duplicate_spans(docs, length, piece).withColumnRenamed("doc_id", "__doc")

    def build():
        def step(batch: pa.RecordBatch):
            spans, kept, n_bytes, n_removed, n_spans = batch.column("spans").to_pylist(), [], [], [], []
            for row, data, offsets in w.text_blocks(batch.column("text")):
                for i in range(len(offsets) - 1):
                    own, part = spans[row + i], data[offsets[i]:offsets[i + 1]]
                    gone = w.covered(np.array([s["start"] for s in own]), np.array([s["n"] for s in own]), len(part)) if own else np.zeros(len(part), bool)
                    kept.append(part[~gone].tobytes())
                    n_bytes.append(len(part))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])))
            return record(doc_id=batch.column("doc_id"), n_bytes=pa.array(n_bytes, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), n_spans=pa.array(n_spans, pa.int64()), kept=pa.array(kept, pa.binary()))

        return step

    rows = docs.join(spans, docs["doc_id"] == spans["__doc"], "left").drop("__doc")
    cut = per_batch(rows, build, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
