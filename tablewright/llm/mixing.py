"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

The mix is measured in words. Sources get targets by weight, none above ``cap`` times its size. The total is cut into
blocks of equal length; blocks are dealt to sources, and a source's blocks to its shards, by highest quotients
(votes / (2k + 1)). A shard is a bounded part of one source, laid out in seeded order and cut into equal blocks; its
quota picks blocks in seeded strides, going round again when the quota exceeds them. A document's share is what the
picked blocks cover of it.

A hot source is many shards. Windows run over sources, over the shards of a source, and over the documents of a
shard, of about ``shard_words`` words.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, after all others; a
source without words has target 0; an empty table gives an empty table; repeated rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import n_words_of, stored, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SEED = 17
#: Odd prime above the number of blocks of a shard, so strides of it visit each block once.
STRIDE = 1_000_003


def _seeded(*parts) -> Column:
    """A number from 0 to 2^32 - 1, fixed by seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 8), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, within: list[str], order: list[Column], votes: str, seats: str) -> DataFrame:
    """Adds ``__quota``: the seats of each party among the parties of ``within``; ties go to the first in ``order``.

    Rounding votes / (total / seats) misses the seat count by at most half the number of parties. The true divisor lies
    so near that party p is off by at most share(p) * parties / 2 + 1 seats; only those quotients are ranked, about
    five per party, however many seats there are.
    """
    everyone, ranked = Window.partitionBy(*within), Window.partitionBy(*within).orderBy(*order)
    v, n = F.col(votes), F.col(seats)
    p = parties.withColumn("__v", F.sum(v).over(everyone)).withColumn("__n", F.count(F.lit(1)).over(everyone)).withColumn("__rank", F.row_number().over(ranked))
    p = p.withColumn("__near", F.when(F.col("__v") > 0, F.floor(v / F.col("__v") * n + 0.5)).otherwise(F.lit(0)))
    p = p.withColumn("__off", F.when(F.col("__v") > 0, F.ceil(v / F.col("__v") * F.col("__n") / 2)).otherwise(F.lit(0)) + 1)
    p = p.withColumn("__least", F.greatest(F.col("__near") - F.col("__off"), F.lit(0)))
    p = p.withColumn("__open", n - F.sum("__least").over(everyone))
    q = p.withColumn("__k", F.explode(F.sequence(F.col("__least"), F.col("__near") + F.col("__off"))))
    q = q.withColumn("__place", F.row_number().over(Window.partitionBy(*within).orderBy((v / (2 * F.col("__k") + 1)).desc(), "__rank", "__k")))
    won = F.count_if((F.col("__place") <= F.col("__open")) & (v > 0))
    keys = [F.col(c) for c in parties.columns]
    return q.groupBy(*keys, "__least").agg(won.alias("__won")).withColumn("__quota", F.col("__least") + F.col("__won")).drop("__least", "__won")


def targets(sizes: DataFrame) -> DataFrame:
    """``source source_size target`` from ``source size``: one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__w", weight)
    # sources fill up in the order of size to weight; each stop raises what the rest gets per weight
    filled = Window.orderBy(F.col("source_size") / F.col("__w"), F.col("source").asc_nulls_last())
    before, everyone = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.lit(SHARE) * F.sum("source_size").over(everyone)
    s = s.withColumn("__left", total - F.coalesce(F.lit(CAP) * F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("__left_w", F.sum("__w").over(everyone) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
    s = s.withColumn("__level", F.col("__left") / F.col("__left_w"))
    full = F.lit(CAP) * F.col("source_size") <= F.col("__level") * F.col("__w")
    s = s.withColumn("__full", full)
    # the level at the first source that does not fill up holds for all later ones
    first = F.max(F.when(~F.col("__full"), F.col("__left_w"))).over(everyone)
    level = F.max(F.when(~F.col("__full") & (F.col("__left_w") == first), F.col("__level"))).over(everyone)
    target = F.when(F.col("__full"), (F.lit(CAP) * F.col("source_size")).cast("double")).otherwise(level * F.col("__w"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _shard(source_size: Column, key: Column) -> Column:
    return F.pmod(_seeded(key, F.lit("shard")), F.greatest(F.ceil(source_size / SHARD_WORDS), F.lit(1)))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b["__b_" + n])
    return out


def _with(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Left-side rows with the columns of ``b`` for equal keys, null keys included."""
    for n in names:
        b = b.withColumnRenamed(n, "__b_" + n)
    return a.join(b, _same(a, b, *names)).drop(*["__b_" + n for n in names])


def mix(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``size source_size target taken pieces``; pieces are word ranges of the text,
    ``(start, end, times)``. Columns of those names are replaced."""
    docs = docs.drop("size", "source_size", "target", "taken", "pieces")
    sizes = stored(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")), "mix-sizes")
    per_source = stored(targets(sizes), "mix-targets")
    sharded = _with(sizes, per_source, "source").withColumn("__shard", _shard(F.col("source_size"), F.col("doc_id")))
    shards = sharded.groupBy("source", "source_size", "target", "__shard").agg(F.sum("size").alias("__shard_size"))
    total = F.sum("target").over(Window.partitionBy())
    blocks = sainte_lague(
        per_source.withColumn("__seats", F.floor(total / BLOCK_WORDS + 0.5)), [], [F.col("source").asc_nulls_last()], "target", "__seats"
    ).select("source", F.col("__quota").alias("__seats"))
    quotas = sainte_lague(_with(shards, blocks, "source"), ["source"], [F.col("__shard")], "__shard_size", "__seats")
    n_blocks = F.greatest(F.floor(F.col("__shard_size") / BLOCK_WORDS + 0.5), F.lit(1)).cast("long")
    quotas = stored(quotas.select(
        "source", "__shard", "__shard_size", n_blocks.alias("__m"), F.least(F.col("__quota"), CAP * n_blocks).cast("long").alias("__q")
    ), "mix-quotas")

    line = Window.partitionBy("source", "__shard").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        _with(_with(docs.withColumn("size", n_words_of(F.col("text"))), per_source, "source")
              .withColumn("__shard", _shard(F.col("source_size"), F.col("doc_id"))), quotas, "source", "__shard")
        .withColumn("__order", _seeded(F.col("doc_id"), F.lit("order")))
        .withColumn("__end", F.sum("size").over(line)).withColumn("__start", F.col("__end") - F.col("size"))
        .withColumn("__phase", F.pmod(_seeded(F.col("source"), F.col("__shard"), F.lit("phase")), F.col("__m")))
    )
    s, m, q = F.col("__shard_size"), F.col("__m"), F.col("__q")
    inside = F.sequence(
        F.greatest(F.floor(F.col("__start") * m / s).cast("long") - 1, F.lit(0).cast("long")), F.least(F.floor(F.col("__end") * m / s).cast("long") + 1, m - 1)
    )

    def piece(k: Column) -> Column:
        low = F.greatest(_div(k * s, m), F.col("__start"))
        high = F.least(_div((k + 1) * s, m), F.col("__end"))
        times = _div(q, m) + F.when(F.pmod(k * STRIDE + F.col("__phase"), m) < F.pmod(q, m), 1).otherwise(0)
        return F.struct((low - F.col("__start")).alias("start"), (high - F.col("__start")).alias("end"), times.cast("long").alias("times"))

    pieces = F.filter(F.transform(inside, piece), lambda p: (p.getField("end") > p.getField("start")) & (p.getField("times") > 0))
    out = placed.withColumn("pieces", F.when(F.col("size") > 0, pieces).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,times:bigint>>")))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + (p.getField("end") - p.getField("start")) * p.getField("times"))
    return out.withColumn("taken", taken).select(*docs.columns, "size", "source_size", "target", "taken", "pieces")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative longs."""
    return F.call_function("div", a, b)


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for the words taken once, one more for those taken
    twice. A document taken whole keeps its text; else the taken words are joined by one space."""
    m = mix(docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"))).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.lit(CAP))))
    m = m.withColumn("__own", F.expr("filter(pieces, p -> p.times >= __pass)"))
    m = m.withColumn("__n", F.aggregate("__own", F.lit(0).cast("long"), lambda a, p: a + p.getField("end") - p.getField("start"))).filter("__n > 0")
    m = m.withColumn("__words", words_of(F.col("text")))
    part = F.array_join(F.flatten(F.transform("__own", lambda p: F.slice("__words", (p.getField("start") + 1).cast("int"), (p.getField("end") - p.getField("start")).cast("int")))), " ")
    m = m.select("row", F.when(F.col("__n") == F.col("size"), F.col("text")).otherwise(part).alias("taken_text"))
    made = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("taken_text").cast(docs.schema["n_chars"].dataType)
    return m.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
