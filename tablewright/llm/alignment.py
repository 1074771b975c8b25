"""Two tokenizers of one corpus aligned: where their tokens end together, and which tokens of one overlap which of the other.

Galloping intersection. A text's tokens are, for each tokenizer, an increasing list of byte offsets at which they end.
The shorter list drives: each of its offsets is searched in the longer one from where the last search stopped, by steps
of 1, 2, 4, ... and then by halving the last step. Offsets found in both lists are common ends; they slice both token
lists into groups. The position found is also the rank of the driver's end among the other's ends, so the difference of
the ranks of a token's two ends is the range of tokens it overlaps. Long lists are cut into lanes that gallop side by
side in one array operation; only a lane's first offset is searched from the front.

Counts of linked id pairs over the corpus. Texts are worked on in blocks; a block's distinct pairs and their counts, not
its links, are shuffled and summed, so the rows per pair are at most the blocks. Totals return to the blocks, whose links
were kept as compressed numbers of their pairs, and each document adds up its own. A pair that every text holds is one
row of each block, as any other pair is.

Tokenizer A is a byte-level BPE file of the tokenizers library, run by ``tiktoken`` over the ranks of the same file: every
merge of the list comes after those that make its parts (checked when loading), so both give the same tokens; that
library's own encoder takes the texts with very long runs of white space. Tokenizer B is a sentencepiece model.

Defined results: a null or empty text has no tokens, and neither has one whose tokens' joined bytes differ from a space
and the text (a text with U+2581, which B reads as a space). Repeated rows, and rows with one doc_id and different texts,
are aligned one by one and counted each. A null doc_id stays null. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm.bpe import PATTERN, byte_alphabet
from tablewright.llm.common import per_batch, record, ship, stored
from tablewright.llm.windows import stretch_index

#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 1 << 20
#: Offsets that one lane searches one after the other.
LANE = 128
#: Runs of white space from this length on go through the tokenizers library.
LONG_BLANK = re.compile(r"\s{1000}")

DIGEST_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        names, of = spec["model"]["vocab"], byte_alphabet()
        special = {t["id"] for t in spec["added_tokens"]}
        if spec["normalizer"] or any(names[a + b] <= max(names[a], names[b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])):
            raise ValueError("the merges of this vocabulary are not in the order of its ids")
        ranks = {bytes(of[c] for c in t): i for t, i in names.items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path_a = path_a
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max([*names.values(), *special]) + 1)
        for b, i in ranks.items():
            self.bytes_a[i] = b
        m = self.model
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i in range(m.get_piece_size()) for p in [m.id_to_piece(i)]]
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    @functools.cached_property
    def library(self) -> Tokenizer:
        t = Tokenizer.from_file(self.path_a)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True
        return t

    def encode_a(self, text: str) -> list[int]:
        if len(text) >= 1000 and LONG_BLANK.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text, empty where there is nothing to align."""
        second = self.model.encode([t or "" for t in texts], num_threads=1)
        a, b = [], []
        for t, y in zip(texts, second):
            whole = f" {t}" if t else ""
            x = self.encode_a(whole) if t else []
            data = whole.encode()
            if b"".join([self.bytes_a[i] for i in x]) != data or b"".join([self.bytes_b[i] for i in y]) != data:
                x, y = [], []
            a.append(x)
            b.append(y)
        return a, b


@functools.lru_cache(maxsize=1)
def tokens(path_a: str, path_b: str) -> Tokens:
    """One per worker process, shared by the tasks it runs."""
    return Tokens(path_a, path_b)


def gallop(drive: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each offset of ``drive`` how many of ``into`` are smaller; both increase, and ``into`` ends no earlier."""
    found = np.zeros(len(drive), np.int64)
    if not len(drive):
        return found
    first = np.arange(0, len(drive), LANE)
    at = np.searchsorted(into, drive[first])
    found[first] = at
    last = len(into) - 1
    for step in range(1, min(LANE, len(drive))):
        if first[-1] + step >= len(drive):
            first, at = first[:-1], at[:-1]
        x = drive[first + step]
        # all of into before low is smaller than x; at high it is not, once the steps stop
        low, high, wide = at, at.copy(), 1
        open_ = np.flatnonzero(into[at] < x)
        low = low.copy()
        while len(open_):
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(high[open_] + wide, last)
            wide *= 2
            open_ = open_[into[high[open_]] < x[open_]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = into[middle] < x[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        at = high
        found[first + step] = at
    return found


class Block:
    """Aligned texts. Tokens of all texts lie end to end; ``from_a[k]`` is the first A token of text k."""

    def __init__(self, t: Tokens, texts: list[str | None]):
        a, b = t.encode(texts)
        self.most = max(len(t.bytes_a), len(t.bytes_b))
        self.n_a, self.n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        self.a, self.b = (np.array([i for x in y for i in x], np.int64) for y in (a, b))
        self.from_a, self.from_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        ends_a, ends_b = np.cumsum(t.sizes_a[self.a]), np.cumsum(t.sizes_b[self.b])
        # the shorter list of each text drives; texts do not overlap in the offsets, so the lists stay in order
        swap = self.n_b < self.n_a
        short, n_short = np.where(swap, self.from_b[:-1], self.from_a[:-1]), np.where(swap, self.n_b, self.n_a)
        long_, n_long = np.where(swap, self.from_a[:-1], self.from_b[:-1]), np.where(swap, self.n_a, self.n_b)
        text, place = stretch_index(n_short)
        source = short[text] + place
        by_b = swap[text]
        drive = np.where(by_b, ends_b[np.where(by_b, source, 0)], ends_a[np.where(by_b, 0, source)]) if len(text) else np.zeros(0, np.int64)
        other, other_place = stretch_index(n_long)
        target = long_[other] + other_place
        of_a = swap[other]
        into = np.where(of_a, ends_a[np.where(of_a, target, 0)], ends_b[np.where(of_a, 0, target)]) if len(other) else np.zeros(0, np.int64)
        high = gallop(drive, into)
        common = into[high] == drive if len(drive) else np.zeros(0, bool)
        low = np.concatenate(([0], high[:-1] + common[:-1])) if len(drive) else high
        self.n_links_by = high - low + 1
        which, more = stretch_index(self.n_links_by)
        reached = target[low[which] + more] if len(which) else which
        self.link_text = text[which]
        self.link_a, self.link_b = np.where(by_b[which], reached, source[which]), np.where(by_b[which], source[which], reached)
        # last tokens of the groups
        s, l = source[common], target[high[common]] if len(drive) else source[common]
        self.last_a, self.last_b = np.where(by_b[common], l, s), np.where(by_b[common], s, l)
        self.group_text = text[common]

    def per_text(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Rows of ``of`` (text numbers, increasing) counted or summed for each text."""
        bounds = np.searchsorted(of, np.arange(len(self.n_a) + 1))
        if weights is None:
            return np.diff(bounds)
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(weights)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def written(self) -> Iterator[bytes]:
        """Groups of each text: ids of A, a bar, ids of B; groups parted by semicolons."""
        end_a, end_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        end_a[self.last_a] = end_b[self.last_b] = 1
        before_b, before_a = np.concatenate(([0], self.last_b + 1)), self.last_a + 1
        at_a = np.arange(len(self.a)) + before_b[np.cumsum(end_a) - end_a]
        at_b = np.arange(len(self.b)) + before_a[np.cumsum(end_b) - end_b] if len(self.b) else end_b
        width = len(str(self.most)) + 1
        cells = np.empty(len(self.a) + len(self.b), f"S{width}")
        cells[at_a] = _cells(self.most, ",|", width)[end_a, self.a]
        cells[at_b] = _cells(self.most, ",;", width)[end_b, self.b]
        bounds = self.from_a + self.from_b
        for k in range(len(self.n_a)):
            yield cells[bounds[k]:bounds[k + 1]].tobytes().translate(None, b"\0")[:-1]


@functools.lru_cache(maxsize=2)
def _cells(most: int, marks: str, width: int) -> np.ndarray:
    return np.array([[f"{i}{m}" for i in range(most + 1)] for m in marks], f"S{width}")


def text_groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of a batch in stretches of about BLOCK_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.cumsum(sizes), 0
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BLOCK_BYTES, "right")))
        yield row, stop
        row = stop


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row ``doc_id``, ids of both tokenizers, token counts up to the end of each group, and links as token places
    (from 0) in the two lists."""

    def build():
        t = tokens(path_a, path_b)

        def step(batch: pa.RecordBatch):
            for row, stop in text_groups(batch):
                part = batch.slice(row, stop - row)
                x = Block(t, part.column("text").to_pylist())
                groups, links = (np.concatenate(([0], np.cumsum(x.per_text(y)))) for y in (x.group_text, x.link_text))
                lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
                yield record(
                    doc_id=part.column("doc_id"), a=lists(x.from_a, x.a), b=lists(x.from_b, x.b),
                    group_a=lists(groups, x.last_a + 1 - x.from_a[x.group_text]), group_b=lists(groups, x.last_b + 1 - x.from_b[x.group_text]),
                    link_a=lists(links, x.link_a - x.from_a[x.link_text]), link_b=lists(links, x.link_b - x.from_b[x.link_text]),
                )

        return step

    schema = "doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>, link_a array<int>, link_b array<int>"
    return per_batch(docs.select(docs["doc_id"].cast("long"), "text"), build, schema)


def packed(numbers: np.ndarray) -> bytes:
    """Small numbers by byte planes, compressed."""
    return pa.Codec("zstd", 1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data, n * 4, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


BLOCK_SCHEMA = "block long, pairs array<long>, counts array<int>, links binary, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, sha array<string>"


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block: distinct id pairs by falling count, each link as a number of its pair, and the documents."""

    def build():
        t = tokens(path_a, path_b)
        task, made = TaskContext.get().partitionId(), iter(range(1 << 62))

        def step(batch: pa.RecordBatch):
            for row, stop in text_groups(batch):
                part = batch.slice(row, stop - row)
                x = Block(t, part.column("text").to_pylist())
                pairs, which, counts = np.unique(x.a[x.link_a] << 32 | x.b[x.link_b], return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                sha = [hashlib.sha256(s).hexdigest() if n else "" for s, n in zip(x.written(), x.n_a)]
                yield record(
                    block=pa.array([task << 32 | next(made)], pa.int64()), pairs=pa.array([pairs[order]], pa.list_(pa.int64())), counts=pa.array([counts[order]], pa.list_(pa.int32())),
                    links=pa.array([packed(number[which])], pa.binary()), doc_id=pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                    **{k: pa.array([v], pa.list_(pa.int32())) for k, v in (("n_a", x.n_a), ("n_b", x.n_b), ("n_groups", x.per_text(x.group_text)), ("n_links", x.per_text(x.link_text)))}, sha=pa.array([sha], pa.list_(pa.string())),
                )

        return step

    return per_batch(docs.select(docs["doc_id"].cast("long"), "text"), build, BLOCK_SCHEMA)


def pair_totals(done: DataFrame) -> DataFrame:
    """``of place n best`` for each distinct pair of each block ``of``: the pair's count over the corpus, and whether no
    other pair of its B id has a larger one."""
    own = done.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("c"))
    totals = own.groupBy("pair").agg(F.sum("c").alias("n"))
    # at most as many rows per B id as A has ids
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    totals = totals.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))
    return own.drop("c").join(totals, "pair").select(F.col("block").alias("of"), "place", "n", "best")


def statistics(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """RESULT_SCHEMA for each row of ``docs``."""
    done = stored(blocks(docs, path_a, path_b), "aligned")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        size = right.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = right.column("place").to_numpy()
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        for x in left.to_batches():
            for k in range(x.num_rows):
                row = {c: x.column(c)[k].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")}
                per = row["n_links"].to_numpy()
                links = unpacked(x.column("links")[k].as_py(), int(per.sum()))
                bounds = np.concatenate(([0], np.cumsum(per)))
                add = lambda v: np.diff(np.concatenate(([0], np.cumsum(v[links])))[bounds])
                out.append(record(**{c: row[c].cast(pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, n_best=pa.array(add(best), pa.int64()), count_sum=pa.array(add(n), pa.int64()), groups_sha256=row["sha"]))
        return pa.Table.from_batches(out, _result_schema())

    ship(docs.sparkSession)
    left = done.drop("pairs", "counts").groupBy("block")
    return left.cogroup(pair_totals(done).groupBy("of")).applyInArrow(joined, RESULT_SCHEMA)


def _result_schema() -> pa.Schema:
    return pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def op11(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return statistics(docs, path_a, path_b)
