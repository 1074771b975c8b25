"""Near-duplicate groups by ProbMinHash signatures, banding and verification.

A document is the weighted set of its five-word shingles, weights being counts. Two documents are linked when their
probability Jaccard similarity is 0.8 or more; without repeated shingles that is the Jaccard similarity of the sets.
Each shingle is a Poisson process with its weight as rate; its arrivals, drawn from its hash, hit components at random,
and a component keeps the shingle of its first arrival. Two documents keep the same shingle with a probability of their
similarity. Arrivals are drawn up to a time by which nearly every component was hit, then stop; a document with an
empty component left goes on to twice that time. No later arrival could change anything.

Equal word sequences are one text from here on. Bands of five components make buckets. First each member of a bucket is
compared with the bucket's smallest, in a star; the groups so far come from connected components. Only buckets that
still hold several groups are looked at again: there, groups are compared with centres on their rarest shingles, in
rounds, and what rounds no longer join is compared in pairs. So every pair of different texts in a bucket is compared,
ruled out by a bound or, if both texts are long, by a sketch that is 5.5 standard deviations off (a linked pair is lost
with a chance below 2 in 10^8), or already connected, and no group of copies is expanded
into its pairs. Links are verified on the whole texts.

Defined results: a text with fewer than five words is one shingle; a text without words, or null, is a group of its own;
a group is named by its smallest doc_id; repeated rows with one doc_id are one document and stay together; a null doc_id
has a null group; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import windows as w
from tablewright.llm.common import per_batch, record, stored

SHINGLE = 5
SIMILARITY = 0.8
COMPONENTS = 128
BAND, BANDS = 5, 25
#: Rounds of comparing with centres go on while more than one in so many pairs is linked.
FEW = 20
#: Components of the longer sketch that documents get which are compared in pairs, bits kept of each, and agreeing
#: components, as a share, below which a pair is not similar enough: 5.5 standard deviations from what 0.8 gives.
SKETCH = 2048
BITS = 2
AGREEMENT = 0.8066
#: Distinct shingles below which a text's pairs are verified whatever the sketch says.
SHORT = 64
#: Documents whose longer sketch is drawn at a time.
SKETCH_ROWS = 32


def shingles(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and count of the distinct shingles of texts given by word values."""
    n = np.diff(bounds)
    size = np.minimum(n, SHINGLE)
    owner, place = w.stretch_index(np.where(n > 0, n - size + 1, 0))
    start = bounds[:-1][owner] + place
    h = w.scrambled(w.Prefix(values).of(start, start + size[owner]) + size[owner].astype(np.uint64))
    by = np.lexsort((h, owner))
    owner, h = owner[by], h[by]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures, one row per document; documents without shingles have zeros."""
    total = np.bincount(owner, weights=weight, minlength=n_docs)
    sig = np.zeros((n_docs, m), np.uint64)
    until = np.where(total > 0, (np.log(m) + 3) * m / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        e = np.flatnonzero(todo[owner])
        time, drawn = np.zeros(len(e)), 0
        cells, times, kept = [], [], []
        while len(e):
            drawn += 1
            r = w.scrambled(h[e] + np.uint64(drawn * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[e]
            alive = time <= until[owner[e]]
            e, time, r = e[alive], time[alive], r[alive]
            cells.append(owner[e] * m + (w.scrambled(r) % np.uint64(m)).astype(np.int64))
            times.append(time)
            kept.append(h[e])
        cell, time, shingle = np.concatenate(cells), np.concatenate(times), np.concatenate(kept)
        by = np.argsort(-time, kind="stable")
        flat, hit = np.zeros(n_docs * m, np.uint64), np.zeros(n_docs * m, bool)
        flat[cell[by]] = shingle[by]  # the earliest is written last
        hit[cell] = True
        full = hit.reshape(n_docs, m).all(axis=1) & todo
        sig[full] = flat.reshape(n_docs, m)[full]
        todo &= ~full
        until = np.where(todo, until * 2, until)
    return sig


def lists(x: np.ndarray) -> pa.ListArray:
    """Rows of 64-bit numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).view(np.int64)))


def packed(sig: np.ndarray) -> np.ndarray:
    """A few bits of each component, 64 / BITS to a word. They are drawn from shingle and component number together: a short
    text has few shingles, and bits of the shingles alone would agree or differ by chance in all components at once."""
    per = 64 // BITS
    drawn = w.scrambled(sig + w.scrambled(np.arange(1, sig.shape[1] + 1, dtype=np.uint64)))
    low = (drawn & np.uint64((1 << BITS) - 1)).reshape(len(sig), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def differing(a: str, b: str) -> Column:
    """Number of components in which two packed signatures differ."""
    pairs = int.from_bytes(b"\x55" * 8, "big")

    def word(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, BITS // 2)).bitwiseAND(F.lit(pairs)))

    return F.aggregate(F.zip_with(a, b, word), F.lit(0), lambda total, x: total + x)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id h1 h2 bands``: two hashes of the word sequence and bucket keys."""

    def build():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id")
            for row, data, offsets in w.text_blocks(batch.column("text")):
                starts, ends, bounds = w.word_spans(data, offsets)
                values = w.word_values(data, starts, ends)
                k = len(bounds) - 1
                sig = prob_minhash(*shingles(values, bounds), k)
                full = np.flatnonzero(np.diff(bounds) > 0)
                sig = sig[full]
                keys = np.zeros((len(full), BANDS), np.uint64)
                for j in range(BAND):
                    keys = w.scrambled(keys + sig[:, j:BAND * BANDS:BAND] + np.arange(BANDS, dtype=np.uint64))
                whole, other = w.Prefix(values), w.Prefix(w.scrambled(values + np.uint64(77)))
                lo, hi = bounds[:-1][full], bounds[1:][full]

                yield record(
                    doc_id=ids.slice(row, k).take(pa.array(full)), h1=whole.of(lo, hi).view(np.int64), h2=w.scrambled(other.of(lo, hi) + (hi - lo).astype(np.uint64)).view(np.int64),
                    bands=lists(keys),
                )

        return step

    rows = docs.filter("doc_id is not null").select(docs["doc_id"].cast("long"), "text")
    return per_batch(rows, build, "doc_id long, h1 long, h2 long, bands array<long>")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, given as sorted distinct hashes and weights: the sum over common elements i of
    1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    ratio = np.divide(x, y, out=np.full(len(union), np.inf), where=y > 0)
    # the maximum is the x term for ratios from r_i on, the y term below
    by = np.argsort(ratio, kind="stable")
    x, y, ratio = x[by], y[by], ratio[by]
    at = np.searchsorted(ratio, ratio, "left")
    above, below = np.append(np.cumsum(x[::-1])[::-1], 0.0)[at], np.append(0.0, np.cumsum(y))[at]
    common = (x > 0) & (y > 0)
    return float(np.sum(1.0 / (above[common] / x[common] + below[common] / y[common])))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a b`` whose texts, from ``doc_id text``, are similar enough."""

    def weighted(text: bytes):
        data = np.frombuffer(text, np.uint8)
        starts, ends, bounds = w.word_spans(data, np.array([0, len(data)]))
        _, h, c = shingles(w.word_values(data, starts, ends), bounds)
        return h, c

    def build():
        def step(batch: pa.RecordBatch):
            good, last, left = [], None, None
            a, b = batch.column("a_text").cast(pa.binary()), batch.column("b_text").cast(pa.binary())
            for i, (name, x, y) in enumerate(zip(batch.column("b").to_pylist(), a, b)):
                if name != last:
                    last, left = name, weighted(y.as_py())
                right = weighted(x.as_py())
                shorter, longer = sorted((left[1].sum(), right[1].sum()))
                if shorter and probability_jaccard(left, right) >= similarity - 1e-12:
                    good.append(i)
            return batch.take(pa.array(good, pa.int64())).select(["a", "b"]) if good else None

        return step

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return per_batch(rows, build, "a long, b long")


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id label`` after joining what links ``a b`` connect: labels sink to the smallest neighbour's and then
    jump to their label's label, until nothing changes. Every round is stored."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("doc_id", "other")
    both = stored(both.join(labels, "doc_id").select(F.col("label").alias("x"), "other").join(labels.withColumnsRenamed({"doc_id": "other", "label": "y"}), "other")
                  .select("x", "y").filter("x <> y").distinct(), "minhash-links")
    if both.isEmpty():
        return labels
    # between groups, as groups: (x, root)
    roots = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")), "minhash-roots")
    while True:
        seen = both.join(roots.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        sunk = roots.join(seen, "x", "left").select("x", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        up = roots.select(F.col("x").alias("root"), F.col("root").alias("up"))
        step = stored(sunk.join(up, "root", "left").select("x", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "minhash-roots")
        roots = step.select("x", "root")
        if step.filter("root <> old").isEmpty():
            break
    moved = labels.join(roots.withColumnRenamed("x", "label"), "label", "left")
    return moved.select("doc_id", F.coalesce("root", "label").alias("label"))


def _elements(docs: DataFrame) -> DataFrame:
    """``doc_id label h p n``: distinct shingles of each document, their share of all its shingles and their number."""

    def build():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id")
            for row, data, offsets in w.text_blocks(batch.column("text")):
                starts, ends, bounds = w.word_spans(data, offsets)
                owner, h, n = shingles(w.word_values(data, starts, ends), bounds)
                total = np.bincount(owner, weights=n, minlength=len(bounds) - 1)
                at = pa.array(owner + row)
                number = np.bincount(owner, minlength=len(bounds) - 1)
                yield record(doc_id=ids.take(at), label=batch.column("label").take(at), h=h.view(np.int64), p=n / total[owner], n=number[owner])

        return step

    return per_batch(docs.select("doc_id", "label", "text"), build, "doc_id long, label long, h long, p double, n long")


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id sig``: a few bits of each component of a longer signature, packed."""

    def build():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id")
            for row, data, offsets in w.text_blocks(batch.column("text")):
                starts, ends, bounds = w.word_spans(data, offsets)
                owner, h, n = shingles(w.word_values(data, starts, ends), bounds)
                for lo in range(0, len(bounds) - 1, SKETCH_ROWS):
                    hi = min(lo + SKETCH_ROWS, len(bounds) - 1)
                    a, b = np.searchsorted(owner, (lo, hi))
                    sig = prob_minhash(owner[a:b] - lo, h[a:b], n[a:b], hi - lo, SKETCH)
                    yield record(doc_id=ids.slice(row + lo, hi - lo), sig=lists(packed(sig)))

        return step

    return per_batch(docs.select("doc_id", "text"), build, "doc_id long, sig array<long>")


#: The larger share of its shingles that one of two linked texts may lack, and twice over what both may.
NEAR = (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9


def _load(before: str) -> Column:
    return (1 + F.col(before)) / (1 - F.col(before))


def _rare(buckets: DataFrame, labels: DataFrame, whole: DataFrame) -> DataFrame:
    """``doc_id h before brief``: the rarest shingles of the documents whose buckets hold several groups, and whether
    a document has few shingles.

    Let u and v be the shares of two documents' shingles that the other lacks. Their similarity is at most
    2 / ((1 + u) / (1 - u) + (1 + v) / (1 - v)), so u and v of a linked pair keep within a bound, and the rarest shingle
    they share has no more than u and v before it (``before``). A passage that thousands of otherwise different documents
    hold comes late in that order, so they do not meet. Shingles of one group only count as not shared. No linked pair
    is lost.
    """
    named = buckets.select("key", "doc_id").join(labels, "doc_id")
    several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    members = stored(named.join(several, "key", "left_semi").select("doc_id", "label").distinct(), "minhash-mixed")
    parts = stored(_elements(whole.join(members, "doc_id")), "minhash-elements")
    common = parts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("h", "n")
    own = Window.partitionBy("doc_id")
    # rows that repeat a document make this smaller, never larger
    before = 1 - F.sum("p").over(own) + F.sum("p").over(own.orderBy("n", "h")) - F.col("p")
    rare = parts.withColumn("brief", F.col("n") < SHORT).drop("n", "label").join(common, "h").withColumn("before", F.greatest(before, F.lit(0.0)))
    return stored(rare.filter(F.col("before") <= 1 - SIMILARITY + 1e-9).groupBy("doc_id", "h").agg(F.min("before").alias("before"), F.max("brief").alias("brief")), "minhash-rare")


def _open(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``rare``, with labels, of shingles that are still in several groups."""
    now = rare.join(labels, "doc_id")
    several = now.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("h")
    return stored(now.join(several, "h", "left_semi"), "minhash-open")


def _to_centres(now: DataFrame, number: int) -> DataFrame:
    """Pairs ``a b`` of a round: for each shingle one document is the centre, by a seeded order that is the same for all
    shingles, and each other group sends one document to it. At most one pair for each group and shingle."""
    by = F.xxhash64("doc_id", F.lit(number))
    one = now.groupBy("h", "label").agg(F.min(F.struct(by.alias("o"), "doc_id", "before")).alias("d")).select("h", "label", "d.*")
    centres = one.filter(F.col("before") <= NEAR).groupBy("h").agg(F.min(F.struct("o", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("before").alias("bb"))).alias("c")).select("h", "c.b", "c.lb", "c.bb")
    met = one.join(centres, "h").filter((F.col("label") != F.col("lb")) & (_load("before") + _load("bb") <= 2 / SIMILARITY + 1e-6))
    return met.select(F.col("doc_id").alias("a"), "b").distinct()


def _all_pairs(now: DataFrame, whole: DataFrame) -> DataFrame:
    """Every pair ``a b`` of different groups that may be linked, ``a`` the smaller id. A pair of texts with ``SHORT``
    shingles or more is left out if its sketches differ by more than a linked pair's do with a chance of 2 in 10^8."""
    asked = whole.join(now.select("doc_id").distinct(), "doc_id", "left_semi")
    # a document that rows repeat is sketched once
    drawn = stored(sketches(asked).groupBy("doc_id").agg(F.min("sig").alias("sig")), "minhash-sketches")
    now = now.join(drawn, "doc_id")
    side = lambda x: [F.col(c).alias(c[0] + x) for c in ("doc_id", "label")] + [F.col(c).alias(f"{c}{x}") for c in ("before", "brief", "sig")]
    # one of the two has no more than this before the shingle
    left, right = now.filter(F.col("before") <= NEAR).select("h", *side("1")), now.select("h", *side("2"))
    met = left.join(right, "h").filter(
        (F.col("l1") != F.col("l2")) & ((F.col("before2") > NEAR) | (F.col("d1") < F.col("d2"))) & (_load("before1") + _load("before2") <= 2 / SIMILARITY + 1e-6)
        & (F.col("brief1") | F.col("brief2") | (differing("sig1", "sig2") <= int((1 - AGREEMENT) * SKETCH)))
    )
    return met.select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).distinct()


def _within_buckets(labels: DataFrame, tried: DataFrame, buckets: DataFrame, whole: DataFrame) -> DataFrame:
    """Labels after all links between texts that share a bucket.

    Documents meet on their rarest shingles. In rounds, groups are compared with one centre for each shingle and joined
    where they are linked, so a group of n near copies costs about n pairs a round and not n squared. When a round links
    few of its pairs, what is still in different groups is compared in pairs, all that the bound and the sketches leave.
    """
    rare, number = _rare(buckets, labels, whole), 0
    while True:
        now = _open(rare, labels)
        pairs = stored(_to_centres(now, number).join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        links = stored(verified(pairs, whole), "minhash-verified")
        tried = tried.union(pairs).union(pairs.select("b", "a"))
        n_pairs, n_links, number = pairs.count(), links.count(), number + 1
        if n_links:
            labels = stored(components(links, labels), "minhash-labels")
        if n_links * FEW <= n_pairs:
            break
    rest = stored(_all_pairs(_open(rare, labels), whole).join(tried, ["a", "b"], "left_anti"), "minhash-rest")
    return labels if rest.isEmpty() else stored(components(verified(rest, whole), labels), "minhash-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id class_id`` for every document; equal texts and linked texts share a class."""
    sigs = stored(signatures(docs), "minhash-signatures")
    texts = stored(sigs.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "bands")).alias("t")).select("h1", "h2", "t.*"), "minhash-texts")
    buckets = texts.select("doc_id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("hi")).filter("b < hi").select("key", "b")
    buckets = stored(buckets.join(shared, "key"), "minhash-buckets")
    stars = buckets.filter("doc_id > b").select(F.col("doc_id").alias("a"), "b").distinct()
    # only the texts that share a bucket are needed from here on; all texts go through a shuffle once
    whole = docs.filter("doc_id is not null").select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    whole = stored(whole.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), "minhash-whole")
    labels = texts.select("doc_id", F.col("doc_id").alias("label"))
    labels = stored(components(verified(stars, whole), labels), "minhash-labels")
    labels = _within_buckets(labels, stars.union(stars.select("b", "a")), buckets, whole)

    named = sigs.select("doc_id", "h1", "h2").join(texts.select("h1", "h2", F.col("doc_id").alias("t")), ["h1", "h2"])
    classes = named.join(labels.withColumnRenamed("doc_id", "t"), "t").select(F.col("doc_id").alias("__doc"), F.col("label").alias("__class")).distinct()
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    return ids.join(classes, F.col("doc_id") == F.col("__doc"), "left").select("doc_id", F.coalesce("__class", "doc_id").alias("class_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that name their group, with the columns they came with."""
    gone = near_duplicates(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
