"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent n-grams (1 to 3 characters of padded, lower-cased words), most
frequent first. A document gets a list of the same kind; the out-of-place distance to a profile sums how far each of
its n-grams is from its rank there, at most ``top``. The nearest profile wins.

N-grams are counted as 32-bit codes, by sorting Arrow batches as arrays. Training counts leave a task as one row per
language, n-gram and batch, and are summed by Spark; a profile has ``top`` rows.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, and so is every text when
nothing was learned; rows with a null language teach nothing; ties go to the language first in code-point order; an
empty table gives an empty table; repeated rows are predicted one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import per_batch, record

#: Length of a profile.
TOP = 300
FOLDS = 5
#: Characters counted at a time, unless one text is longer.
BLOCK_CHARS = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point of each letter, 32 for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of text number, n-gram code and count, ordered by text and code."""
    joined = "".join(f" {t} " for t in texts)
    chars = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    blank = chars == 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    blank = chars == 32
    parts = []
    for n in (1, 2, 3):
        m = len(chars) - n + 1
        if m <= 0:
            continue
        code = chars[:m] * _MIX[0]
        for j in range(1, n):
            code = (code ^ (code >> np.uint64(29))) * _MIX[1] + chars[j:m + j] * _MIX[2]
        code = ((code ^ (code >> np.uint64(31))) * _MIX[0]) >> np.uint64(34)  # 30 bits, and 2 for n
        ok = owner[:m] == owner[n - 1:]
        if n == 1:
            ok &= ~blank[:m]
        elif n == 2:
            ok &= ~(blank[:m] & blank[1:])
        else:
            ok &= ~blank[1:-1]
        parts.append((owner[:m][ok] << np.uint64(32)) | (code[ok] << np.uint64(2)) | np.uint64(n))
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def blocks(texts: list[str]):
    """Slices of a list of about ``BLOCK_CHARS`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(training: DataFrame, top: int = TOP) -> DataFrame:
    """``lang rank code`` from ``text lang``: ranks from 0."""

    def build():
        def step(batch: pa.RecordBatch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs = batch.column("lang").dictionary_encode()
            names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for part in blocks(texts):
                owner, code, count = gram_counts(texts[part])
                key = (which[part][owner].astype(np.int64) << 32) | code
                distinct, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, weights=count, minlength=len(distinct)).astype(np.int64)
                yield record(lang=pa.array([names[i] for i in distinct >> 32], pa.string()), code=distinct & 0xFFFFFFFF, n=total)

        return step

    counts = per_batch(training.select("text", "lang").filter("lang is not null and text is not null"), build, "lang string, code long, n long")
    totals = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    return totals.withColumn("rank", place - 1).filter(F.col("rank") < top).select("lang", "rank", "code")


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """``doc_id held_out lang_pred score`` for ``doc_id text``; score is one minus the distance as a share of the
    largest possible."""
    names = sorted(profiles)

    def build():
        codes = [np.array(profiles[n], np.int64) for n in names]
        order = [np.argsort(c) for c in codes]
        ordered = [c[o] for c, o in zip(codes, order)]

        def step(batch: pa.RecordBatch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for part in blocks(texts) if names else []:
                owner, code, count = gram_counts(texts[part])
                # most frequent first within a text; counts fit 31 bits as codes fit 32
                by = np.lexsort((code, -count, owner))
                owner, code = owner[by], code[by]
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
                rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
                short = rank < top
                owner, code, rank = owner[short], code[short], rank[short]
                n = part.stop - part.start
                size = np.bincount(owner, minlength=n)
                far = np.empty((len(names), n))
                for k in range(len(names)):
                    at = np.minimum(np.searchsorted(ordered[k], code), len(ordered[k]) - 1)
                    hit = ordered[k][at] == code
                    off = np.where(hit, np.abs(order[k][at] - rank), top)
                    far[k] = np.bincount(owner, weights=np.minimum(off, top), minlength=n)
                best = far.argmin(axis=0)
                for i in np.flatnonzero(size):
                    pred[part.start + i] = names[best[i]]
                    score[part.start + i] = 1 - far[best[i], i] / (top * size[i])
            return record(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pa.array(pred, pa.string()), score=score)

        return step

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), "text")
    return per_batch(rows, build, "doc_id long, held_out boolean, lang_pred string, score double")


def op3(docs: DataFrame) -> DataFrame:
    """Profiles come to the driver: ``TOP`` codes for each language."""
    profiles: dict[str, list[int]] = {}
    for row in learn(docs.filter(~held_out(F.col("doc_id")))).orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return predict(docs, profiles)
