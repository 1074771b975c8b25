"""Inputs that once failed or gave too little: one doc_id with several texts, clashing names, far vectors."""

import collections
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tablewright.llm import kmeans_tree, mixing, quality, substrings, suffixes, wavelet

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 80").cache()


def test_one_doc_id_with_several_texts(spark):
    long_, short = " ".join(f"w{i}" for i in range(400)), "only four words here"
    rows = [(1, long_), (2, long_), (2, short), (2, "x " + long_), (3, short), (3, long_ + " tail"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.op4(docs).collect())
    assert got[1, 400, 0] == 1 and got[2, 400, 400] == 1 and sum(got.values()) == 7
    assert all(0 <= removed <= n for _, n, removed in got)
    cut = suffixes.op7(docs).collect()
    assert len(cut) == 7 and all(0 <= r.n_removed <= r.n_bytes for r in cut)
    assert substrings.without_duplicates(docs).columns == ["doc_id", "text"]


def test_stages_return_the_columns_they_got(plain):
    from pyspark.sql import functions as F

    names = ["__id", "__words", "row", "kept", "size", "source_size", "target", "taken", "pieces", "taken_text", "n_words"]
    docs = plain.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    for stage in (quality.passing, mixing.mixed_texts):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
        bare = collections.Counter(tuple(r) for r in stage(plain).collect())
        assert bare == collections.Counter(tuple(r[c] for c in plain.columns) for r in rows)
        assert stage(docs.limit(0)).count() == 0
        assert collections.Counter(stage(docs.repartition(3)).collect()) == collections.Counter(rows)
    judged = quality.quality(docs)
    assert set(docs.columns) <= set(judged.columns) and len(judged.columns) == len(set(judged.columns))


def test_ids_of_large_vocabularies(plain, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert wavelet.id_type(path) == "<u2"
    small = sorted(map(tuple, wavelet.op9(plain, path).collect()))
    monkeypatch.setattr(wavelet, "id_type", lambda _: "<u4")
    assert sorted(map(tuple, wavelet.op9(plain, path).collect())) == small


def test_far_vectors_have_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 64)
    monkeypatch.setattr(kmeans_tree, "BRANCHES", 4)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(1500, 8)) * 0.01 + c for c in np.eye(8)[:2] * 5] + [np.eye(8)[[7] * 7] * 3 + rng.normal(size=(7, 8)) * 0.01])
    ids = np.arange(len(v)) * 20
    table = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>")
    got = collections.Counter(r.query_id for r in kmeans_tree.op2(table).collect())
    assert len(got) == len(v) and set(got.values()) == {20}
    tree = kmeans_tree.Tree(v, 40)
    assert any(tree.children[c] for c in tree.children[0]), "two levels"
    assert sorted(tree.visits(v[0], 1, np.zeros(len(tree.leaf_of), int), 1)) == sorted(tree.leaf_of.values())


def test_sorting_suffixes_takes_memory_for_one_block(spark):
    class Opened:
        sparkSession = spark

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(7)
    # anchor 5 holds 1,000 runs in one piece, anchor 6 two pieces; the others hold two runs whose first 500 bytes are equal
    several = {5: 1000, 6: 40}
    rows = []
    for anchor in range(4000):
        head = rng.bytes(500)
        for i in range(several.get(anchor, 2)):
            piece = 1 if anchor == 6 and i >= 20 else 0
            rows.append((len(rows), anchor, piece, 2 if anchor == 6 else 1, 100, True, 1000, 201, head + rng.bytes(100)))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    names = "doc_id anchor piece pieces place single start n raw".split()
    batches = pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names).to_batches(10_000)
    assert len(rows) * 600 > 5 << 20
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(suffixes._sorted_pieces(Opened(), 400)(iter(batches))).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    seen = collections.Counter((anchor, piece, raw[i:i + 400]) for _, anchor, piece, *_, raw in rows for i in range(100, 110))
    equal = {doc: 100 + sum(seen[anchor, piece, raw[i:i + 400]] > 1 for i in range(100, 110)) for doc, anchor, piece, *_, raw in rows}
    plain = [(r["doc_id"], r["start"], r["n"]) for r in found if not r["open"]]
    assert sorted(plain) == [(doc, 1000, n) for doc, n in equal.items()]
    left = [r for r in found if r["open"]]
    assert len(left) == 40 * 201 and sum(r["done"] for r in left) == sum(equal[r[0]] for r in rows if r[1] == 6)
    assert peak < 160 << 20, peak
