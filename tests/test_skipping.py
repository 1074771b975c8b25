"""Summaries of table blocks: same rows as a full scan, fewer files opened, entries as one fold makes them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import skipping
from tablewright.session import scratch_path
from tests.plans import files_opened

PREDICATES = [("<", 100), ("<=", 5000), ("=", 5000), ("=", 777), (">=", 19990), (">", 19999), ("=", -3), ("<", -3), (">", 1000000)]


@pytest.fixture(scope="module")
def history(spark):
    """Ids in order plus a tenth of strays, in 20 blocks; a value fills a third of the rows, some are NULL."""
    path = scratch_path(spark, "fixture")
    value = F.when(F.col("id") % 3 == 0, F.lit(5000)).when(F.col("id") % 50 != 1, F.col("id"))
    df = spark.range(20000).select(F.col("id"), value.alias("id2"))
    skipping.write_blocks(df, path, F.when(F.col("id") % 10 == 0, F.pmod(F.xxhash64("id"), F.lit(20))).otherwise(F.floor(F.col("id") / 1000)))
    return skipping.read_blocks(spark, path)


@pytest.fixture(scope="module")
def clean(spark):
    path = scratch_path(spark, "clean")
    skipping.write_blocks(spark.range(40000), path, F.floor(F.col("id") / 1000))
    return skipping.read_blocks(spark, path)


@pytest.mark.parametrize("op, value", PREDICATES)
def test_skipping_equals_full_scan(spark, history, op, value):
    index = skipping.Index.build(history, "id2", buckets=50, density=20)
    got = skipping.pruned(history, index.candidates(op, value)).filter(f"id2 {op} {value}")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in history.filter(f"id2 {op} {value}").collect())


def test_only_candidate_blocks_are_opened(clean):
    index = skipping.Index.build(clean, "id", buckets=100, density=5)
    wanted = index.candidates("between", 4000, 4100)
    assert wanted.count() <= 4
    assert files_opened(skipping.pruned(clean, wanted).filter("id between 4000 and 4100")) == [(wanted.count(), True)]
    assert files_opened(skipping.pruned(clean, skipping.minmax_candidates(skipping.minmax_summary(clean, ["id"]), "id", "=", 4001))) == [(1, True)]
    # the greatest values may lie beyond approximate edges
    assert sum(n for n, _ in files_opened(skipping.pruned(clean, index.candidates("=", 10**9)))) <= 2
    assert files_opened(clean.filter("id between 4000 and 4100"))[0][0] == 40


def test_append_and_rewrite(spark, clean):
    index = skipping.Index.build(clean, "id", buckets=100, density=5)
    assert index.next_block() == 40
    path = scratch_path(spark, "more")
    skipping.write_blocks(spark.range(100_000, 103_000), path, F.floor(F.col("id") / 1000) - 100 + index.next_block())
    more = skipping.read_blocks(spark, path)
    grown, table = index.add_blocks(more), clean.unionByName(more)
    assert {40, 41, 42} <= {r.block for r in grown.candidates(">", 50_000).collect()} <= {37, 38, 39, 40, 41, 42}
    assert skipping.pruned(table, grown.candidates(">", 39_990)).filter("id > 39990").count() == 9 + 3000
    opened = files_opened(skipping.pruned(table, grown.candidates(">", 39_990)))
    assert len(opened) == 2 and all(pruned for _, pruned in opened) and sum(n for n, _ in opened) <= 6
    touched = grown.candidates("between", 5100, 5200)
    path = scratch_path(spark, "again")
    skipping.write_blocks(skipping.pruned(table, touched).filter("id not between 5100 and 5200"), path, F.col("block") + grown.next_block())
    fresh = skipping.read_blocks(spark, path)
    after, table = grown.replace_blocks(touched, fresh), table.unionByName(fresh)
    assert skipping.pruned(table, after.candidates("between", 5000, 5300)).filter("id between 5000 and 5300").count() == 200
    assert after.summary.agg(F.sum("rows")).first()[0] == 43_000 - 101
    assert after.summary.groupBy("entry").agg(F.countDistinct("block")).count() == after.entries.count()


def one_fold(sets, buckets, density):
    entry, held, out = 0, set(), []
    for s in sets:
        held |= set(s)
        out.append(entry)
        if 100.0 * len(held) / buckets > density:
            entry, held = entry + 1, set()
    return out


def drawn(n, buckets, seed):
    rng = random.Random(seed)
    return [sorted({skipping.OUTSIDE if rng.random() < 0.02 else rng.randrange(buckets) for _ in range(rng.choice([0, 1, 1, 2, 5, 30]))}) for _ in range(n)]


@pytest.mark.parametrize("density", [0, 5, 20, 60, 100])
@pytest.mark.parametrize("run", [1, 2, 16, 100, 5000])
def test_effects_of_runs_combine_to_one_fold(density, run):
    buckets, sets = 40, drawn(700, 40, density)
    full = lambda held: 100.0 * held.bit_count() / buckets > density
    masks = [skipping.mask_of(s, buckets) for s in sets]
    effects = [skipping.Effect.of(masks[i:i + run], full) for i in range(0, len(masks), run)]
    expect = one_fold(sets, buckets, density)
    entry, held = 0, 0
    for k, e in enumerate(effects):
        assert entry == expect[k * run]
        closed, held = skipping.Effect.read(e.text(), full).apply(held)
        entry += closed
    # any grouping gives the same
    while len(effects) > 1:
        effects = [effects[i].then(effects[i + 1]) if i + 1 < len(effects) else effects[i] for i in range(0, len(effects), 2)]
    assert effects[0].apply(0) == (entry, held)
    assert len(effects[0].cuts) <= buckets + 1


@pytest.mark.parametrize("density, shard, fan", [(5, 2, 3), (20, 2, 3), (60, 16, 2), (20, 16, 256), (60, 4096, 256)])
def test_entries_cross_shards(spark, density, shard, fan):
    sets = drawn(120, 30, shard)
    numbers = [i * 3 // 2 for i in range(len(sets))]  # some numbers are gone
    blocks = spark.createDataFrame([(b, s, 10) for b, s in zip(numbers, sets)], "block int, buckets array<int>, rows long").repartition(7)
    got = {r.block: r.entry for r in skipping.group_blocks(blocks, 30, density, shard, fan).collect()}
    assert [got[b] for b in numbers] == one_fold(sets, 30, density)


def test_density_closes_entries(spark):
    blocks = spark.createDataFrame([(i, [i, i + 1], 10) for i in range(10)], "block int, buckets array<int>, rows long")
    grouped = {r.block: r.entry for r in skipping.group_blocks(blocks, 20, 20.0).collect()}
    # four blocks give five of twenty buckets: more than 20 percent closes the entry
    assert [grouped[i] for i in range(10)] == [0] * 4 + [1] * 4 + [2] * 2
    assert [r.buckets for r in skipping.entries(skipping.group_blocks(blocks, 20, 20.0)).orderBy("entry").collect()] == [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8], [8, 9, 10]]
    assert skipping.group_blocks(blocks.limit(0), 20).count() == 0


@pytest.mark.parametrize("edges", [[0.0, 10.0], [0.0, 5.0, 10.0], [float(i) for i in range(0, 3001, 10)], [1.0, 1.0, 1.0, 2.0]])
def test_bucket_search(spark, edges):
    df = spark.range(-5, 3010).select(F.when(F.col("id") != 7, F.col("id").cast("double")).alias("v"))
    for r in skipping.with_bucket(df, F.col("v"), edges, "b").collect():
        inner = sum(e <= r.v for e in edges[1:-1]) if r.v is not None else None
        assert r.b == (None if r.v is None else skipping.OUTSIDE if not edges[0] <= r.v <= edges[-1] else inner), r
    nan = spark.sql("select double('NaN') v")
    assert skipping.with_bucket(nan, F.col("v"), edges, "b").first().b == skipping.OUTSIDE
    assert skipping.with_bucket(nan, F.col("v"), [], "b").first().b == skipping.OUTSIDE


@pytest.mark.parametrize("rows", [4_000, 60_000])
@pytest.mark.parametrize("error", [0.1, 0.01])
def test_signatures_pass_absent_values_as_often_as_wanted(spark, rows, error):
    path = scratch_path(spark, "signed")
    df = spark.range(rows).select((F.col("id") * 2).alias("k"), (F.col("id") % 5).alias("few"), F.lit(None).cast("long").alias("none"))
    skipping.write_blocks(df, path, F.pmod(F.xxhash64("k"), F.lit(8)))
    table = skipping.read_blocks(spark, path)
    s = skipping.Signatures.build(table, ["k", "few", "none"], error)
    size = s.cells.filter("column = 0").agg(F.sum(F.lit(64))).first()[0] / rows
    assert size < {0.1: 12, 0.01: 24}[error]
    # odd numbers are absent
    probes = spark.range(2000).select((F.col("id") * 2 + 1).alias("v")).select("v", *skipping.Signatures._place(F.col("v"), s.words[0], s.bits))
    cells = s.cells.filter("column = 0").select("block", F.col("word").alias("w"), F.col("mask").alias("m"))
    passed = probes.join(cells, (F.col("word") == F.col("w")) & (F.col("m").bitwiseAND(F.col("mask")) == F.col("mask"))).count()
    assert passed / (2000 * 8) < 2 * error
    for v in (0, 2, 2 * (rows - 1)):
        home = table.filter(F.col("k") == v).first().block
        assert home in {r.block for r in s.candidates(k=F.lit(v).cast("long")).collect()}
    assert s.candidates(few=F.lit(77).cast("long"), k=F.lit(2).cast("long")).count() <= 1
    assert s.candidates(none=F.lit(1).cast("long")).count() == 0


def test_signature_size():
    loads = [skipping.signature_size(e)[1] for e in (0.2, 0.05, 0.01, 0.001)]
    assert loads == sorted(loads, reverse=True) and all(math.isfinite(x) and x > 0.5 for x in loads)


def test_postings_parts_follow_the_rows(spark):
    pairs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 100)).alias("term"), F.col("id").alias("doc"))
    path = scratch_path(spark, "posted")
    assert skipping.write_postings(pairs, "term", scratch_path(spark, "posted")) == 1
    parts = skipping.write_postings(pairs, "term", path, part_rows=200)
    assert parts == 54
    got = skipping.read_postings(spark, path, "term", ["hot", "w7"], parts)
    assert got.count() == pairs.filter("term in ('hot', 'w7')").count()
