"""Benchmark items found in documents with one Aho-Corasick automaton.

Texts are normalised: A-Z in lower case, words taken, one space between them. A window is ``WINDOW`` consecutive words of
an item; an item of fewer words is one window. Item words are cut into chunks of half a window: every window holds a
whole chunk, so the automaton needs the chunks only and has at most as many nodes as the items have characters, where
all windows would take ten times as many. A document is scanned once; from a chunk that occurs in it the match is
extended word by word to both sides along the item. A stretch of ``WINDOW`` words or more is made of windows
throughout, so all its words are hit; a shorter one holds none. Word numbers are mapped back to byte offsets of the
original text.

The items go to the workers whole if their texts are within ``AUTOMATON_CHARS`` together, which is measured first. Larger
benchmarks are dealt into shards of about that size by hash; the documents are scanned once for each, what each finds is
stored, and the findings of a document are put together. A chunk that many items hold is compared with each of them.

Defined results: a null or empty text has no words; items without words are never found; an item whose id is null hits
words but is not listed; items with one id count as one. Repeated rows and rows with one doc_id and different texts are
scanned one by one. An empty benchmark hits nothing, an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import per_batch, record, stored

WINDOW = 10
#: Characters of item texts in one automaton, at about 60 bytes a character in each Python worker.
AUTOMATON_CHARS = 4_000_000

#: Letters A-Z become a-z, other ASCII characters but digits and a-z become blanks; bytes of wider characters stay.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: ``found``: stretches of hit words that one item or several give, with byte offsets in the text, and the items' ids.
SCHEMA = "doc_id long, n_words long, found array<struct<first:int,last:int,start:int,stop:int,item_id:long>>"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(TO_WORDS)


class Matcher:
    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window, self.half = window, window // 2
        self.items = [(i, w) for i, t in items if (w := normalised(t).decode().split())]
        places = defaultdict(list)
        for k, (_, words) in enumerate(self.items):
            step = self.half if len(words) >= window else len(words)
            for at in range(0, len(words) - step + 1, step):
                places[" ".join(words[at:at + step])].append((k, at, step))
        self.automaton = ahocorasick.Automaton()
        for chunk, where in places.items():
            self.automaton.add_word(f" {chunk} ", where)
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def find(self, words: list[str]) -> list[tuple[int, int, int | None]]:
        """First word, last word (exclusive) and item of each longest stretch that is made of windows."""
        if self.empty or not words:
            return []
        text = f" {' '.join(words)} "
        hits = list(self.automaton.iter(text))
        if not hits:
            return []
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
        after = np.searchsorted(blanks, [end for end, _ in hits])  # words before the closing blank
        out, reached = [], {}
        for (_, where), end in zip(hits, after.tolist()):
            for k, at, size in where:
                first = end - size
                # the same alignment with the item has been followed up to here already
                if reached.get((k, first - at), 0) >= end:
                    continue
                item, own = self.items[k]
                last, j, i = end, at + size, at
                while last < len(words) and j < len(own) and words[last] == own[j]:
                    last, j = last + 1, j + 1
                while first and i and words[first - 1] == own[i - 1]:
                    first, i = first - 1, i - 1
                reached[k, first - i] = last
                if last - first >= min(self.window, len(own)):
                    out.append((first, last, item))
        return out


@functools.lru_cache(maxsize=1)
def matcher(key: str, window: int, items) -> Matcher:
    """One per worker process and set of items."""
    return Matcher(items.value, window)


class _Shared:
    """A broadcast that compares by its key, for the cache."""

    def __init__(self, held, key: str):
        self.held, self.key = held, key

    @property
    def value(self):
        return self.held.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def scan(docs: DataFrame, items: list[tuple[int | None, str | None]], window: int, all_rows: bool = True) -> DataFrame:
    """``docs`` has ``doc_id`` and ``text``; one row for each of them, or for those with a hit."""
    key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(items), key)

    def build():
        m = matcher(key, window, shared)

        def step(batch: pa.RecordBatch):
            ids, counts, found = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                plain = normalised(text)
                words = plain.decode().split(" ")
                words = [w for w in words if w]
                hits = m.find(words)
                if hits or all_rows:
                    ids.append(doc)
                    counts.append(len(words))
                    found.append(placed(plain, hits) if hits else [])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("item_id", pa.int64())]))
            return record(doc_id=pa.array(ids, pa.int64()), n_words=pa.array(counts, pa.int64()), found=pa.array(found, kind))

        return step

    return per_batch(docs.select("doc_id", "text"), build, SCHEMA)


def placed(plain: bytes, hits: list[tuple[int, int, int | None]]) -> list[dict]:
    """With the byte offsets of the stretches; the normalised bytes before words are joined are as many as the text's."""
    blank = np.frombuffer(plain, np.uint8) == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, stops = edges[0::2], edges[1::2]
    return [{"first": a, "last": b, "start": int(starts[a]), "stop": int(stops[b - 1]), "item_id": item} for a, b, item in hits]


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """SCHEMA for each row of ``docs``; ``benchmark`` has ``item_id`` and ``text``."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"])
    benchmark = benchmark.select(benchmark["item_id"].cast("long"), benchmark["text"])
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= limit:
        return scan(docs, [tuple(r) for r in benchmark.collect()], window)
    n = math.ceil(2 * chars / limit)  # about half full each
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "scanned")
    by_row = rows.select(F.col("row").alias("doc_id"), "text")
    found = None
    for k in range(n):
        items = [tuple(r) for r in benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]
        part = stored(scan(by_row, items, window, all_rows=False), "found")
        found = part if found is None else found.union(part)
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    counted = scan(by_row, [], window).drop("found")
    return (
        rows.select("row", F.col("doc_id").alias("id")).join(counted, F.col("row") == counted["doc_id"]).drop("doc_id")
        .join(found, F.col("row") == found["doc_id"], "left")
        .select(F.col("id").alias("doc_id"), "n_words", F.coalesce("found", F.array().cast("array<struct<first:int,last:int,start:int,stop:int,item_id:long>>")).alias("found"))
    )


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    def build():
        def step(batch: pa.RecordBatch):
            hit, n_items, sha = [], [], []
            for found in batch.column("found").to_pylist():
                covered = 0
                reached = 0
                for first, last in sorted((f["first"], f["last"]) for f in found):
                    covered += max(0, last - max(first, reached))
                    reached = max(reached, last)
                ids = sorted({str(f["item_id"]) for f in found if f["item_id"] is not None})
                hit.append(covered)
                n_items.append(len(ids))
                sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            return record(doc_id=batch.column("doc_id"), n_words=batch.column("n_words"), n_hit=pa.array(hit, pa.int64()), n_items=pa.array(n_items, pa.int64()), items_sha256=pa.array(sha, pa.string()), contaminated=pa.array([h > 0 for h in hit], pa.bool_()))

        return step

    return per_batch(contaminated_passages(docs, benchmark), build, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
