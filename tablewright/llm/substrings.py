"""Substring dedup: runs of 50-word windows joined by hash with their smallest owner.

The reference is every document of smaller id. It is indexed in blocks: runs of 50-word windows that share an anchor
(``windows``), each owned by the smallest document that holds it. A document's blocks are joined with that index by
anchor and content; a block that has a smaller owner is a duplicate span of 50 words or more. Where an anchor has
several contents, parts of a block may be duplicates although the whole is not: those windows are looked up one by one
among the windows of the distinct blocks of that anchor. The spans of a document are united when words are cut.

This takes the place of greedy relative Lempel-Ziv factoring: no factor is grown from the front of a document. The union
of the spans is what factors checked at their ends would give.

A passage shared by a third of all documents is one row per document and block until it is summed before the shuffle
to one row per block; joins are on (anchor, content) and split by Spark where skewed. Only blocks of anchors that two
documents share leave the first stage, and only distinct blocks are opened.

Defined results: a null or empty text has no words and nothing removed; a document below 50 words has no window; in
repeated rows with one doc_id no copy removes from the other, as neither id is smaller; a null doc_id is kept whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm import windows as w
from tablewright.llm.common import per_batch, record, stored

WINDOW = 50
GRAM = 8


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    def build():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, data, offsets in w.text_blocks(batch.column("text")):
                starts, ends, bounds = w.word_spans(data, offsets)
                found = w.runs(w.Prefix(w.word_values(data, starts, ends)), bounds, window, GRAM)
                yield w.collapsed(*found, ids[row:row + len(bounds) - 1])

        return step

    return per_batch(docs.filter("doc_id is not null").select(docs["doc_id"].cast("long"), "text"), build, w.RUN_SCHEMA)


def _opened(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """One row per window of the wanted blocks: ``anchor hash doc_id starts``."""

    def build():
        def step(batch: pa.RecordBatch):
            ids, wanted = batch.column("doc_id"), batch.column("wanted").to_pylist()
            for row, data, offsets in w.text_blocks(batch.column("text")):
                starts, ends, bounds = w.word_spans(data, offsets)
                prefix = w.Prefix(w.word_values(data, starts, ends))
                for i in range(len(bounds) - 1):
                    # rows of one doc_id with other texts may be shorter
                    blocks = [b for b in wanted[row + i] if max(b["starts"]) + b["n"] + window - 1 <= bounds[i + 1] - bounds[i]]
                    if not blocks:
                        continue
                    n = np.array([b["n"] for b in blocks])
                    which, place = w.stretch_index(n)
                    begin = bounds[i] + np.array([b["starts"][0] for b in blocks])[which] + place
                    lists = [b["starts"] for b in blocks]
                    sizes = np.array([len(x) for x in lists])[which]
                    flat = np.concatenate([np.array(x)[None, :] + np.arange(k)[:, None] for x, k in zip(lists, n)], axis=None)
                    yield record(
                        anchor=np.array([b["anchor"] for b in blocks], np.int64)[which],
                        hash=w.scrambled(prefix.of(begin, begin + window)).view(np.int64),
                        doc_id=pa.array(np.full(len(which), ids[row + i].as_py(), np.int64)),
                        starts=pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32())),
                    )

        return step

    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "starts", "n")).alias("wanted"))
    rows = docs.select(docs["doc_id"].cast("long"), "text").join(by_doc, "doc_id")
    return per_batch(rows, build, "anchor long, hash long, doc_id long, starts array<int>")


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id spans``: word ranges ``(start, n)`` that also stand in a document of smaller id; they may overlap."""
    blocks = stored(_blocks(docs, window), "rlz-blocks")
    shared = blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    blocks = stored(blocks.join(shared, "anchor"), "rlz-shared")
    index = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("owner"))
    several = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor")
    found = blocks.join(index, ["anchor", "content"])
    factors = found.filter("doc_id > owner").select("doc_id", F.explode("starts").alias("start"), (F.col("n") + window - 1).alias("n"))
    opened = stored(_opened(docs, found.filter("doc_id = owner").join(several, "anchor").select("doc_id", "anchor", "starts", "n"), window), "rlz-windows")
    first = opened.groupBy("anchor", "hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    edges = opened.join(first, ["anchor", "hash"]).filter("doc_id > lo").select("doc_id", F.explode("starts").alias("start"), F.lit(window).alias("n"))
    return factors.unionByName(edges).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def deduped(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs``, with ``__kept`` (the kept words joined by one space, null if nothing was removed),
    ``__n_words`` and ``__n_removed``."""
    names = docs.columns

    def build():
        def step(batch: pa.RecordBatch):
            spans = batch.column("__spans").to_pylist()
            kept, n_words, n_removed = [], [], []
            for row, data, offsets in w.text_blocks(batch.column("text")):
                starts, ends, bounds = w.word_spans(data, offsets)
                raw = data.tobytes()
                for i in range(len(bounds) - 1):
                    lo, hi, own = bounds[i], bounds[i + 1], spans[row + i]
                    gone = w.covered(np.array([s["start"] for s in own]), np.array([s["n"] for s in own]), hi - lo) if own else np.zeros(hi - lo, bool)
                    keep = np.flatnonzero(~gone) + lo
                    n_words.append(int(hi - lo))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]))
            out = {c: batch.column(c) for c in names}
            return record(**out, __kept=pa.array(kept, pa.binary()).cast(pa.string()), __n_words=pa.array(n_words, pa.int64()), __n_removed=pa.array(n_removed, pa.int64()))

        return step

    spans = duplicate_spans(docs, window).withColumnsRenamed({"doc_id": "__doc", "spans": "__spans"})
    rows = docs.join(spans, docs["doc_id"].cast("long") == F.col("__doc"), "left").drop("__doc")
    schema = StructType(list(docs.schema.fields)).add("__kept", "string").add("__n_words", "long").add("__n_removed", "long")
    return per_batch(rows, build, schema)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """Documents with duplicate spans cut out, columns as they came; a document with nothing cut keeps its text, one
    with nothing left goes."""
    out = deduped(docs).filter("__n_removed = 0 or __n_removed < __n_words")
    cut = F.col("__n_removed") > 0
    out = out.withColumn("text", F.when(cut, F.col("__kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    d = deduped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"))
    return d.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))
