"""Data skipping: small summaries of the blocks of a Parquet table.

A table is laid out in numbered blocks, each a folder of the partition column ``block``. Summaries name blocks; a scan
joins the table with the blocks that qualify, so that dynamic partition pruning opens only those and no list of names
passes through the driver. Blocks that were rewritten get new numbers and the summary forgets the old ones, so the
summary says what is alive.

A complete histogram cuts the column's values into buckets of equal depth. A block's summary is the set of buckets its
rows fall in. Neighbouring blocks share an entry until it holds more than ``density`` percent of all buckets. A predicate
becomes a set of buckets; blocks whose entry shares none are never opened, and the rows of the others are tested again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.joins import broadcast_if_small
from tablewright.session import cut_lineage

OUTSIDE = -9999  # fixed value: bucket of a value beyond the histogram
BLOCK = "block"
#: Blocks folded by one task; any number gives the same entries.
SHARD_BLOCKS = 4096
#: Shards whose effects are combined by one task.
FAN = 256
#: Block numbers that may be broadcast: 16 bytes each.
MAX_BROADCAST_BLOCKS = 2_000_000


# -- layout --------------------------------------------------------------------


def block_count(rows: int, first_rows: int = 25) -> int:
    """Blocks for a table: their number and their size both grow with the square root of the rows."""
    return max(1, math.isqrt(rows // first_rows))


def write_blocks(frame: DataFrame, path: str, block: Column) -> None:
    """Add rows to a table of blocks; ``block`` is a number from 0 and must not be one that ``path`` has already."""
    frame.withColumn(BLOCK, block.cast("int")).repartition(BLOCK).write.mode("append").partitionBy(BLOCK).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pruned(table: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of the candidate blocks; the others are not opened.

    The numbers are made first, so that the scan's filter is the join's own broadcast; the comparison tells the
    optimizer that this side selects.
    """
    keys = cut_lineage(candidates.select(BLOCK).distinct()).filter(F.col(BLOCK) >= 0)
    return table.join(broadcast_if_small(keys, MAX_BROADCAST_BLOCKS), BLOCK, "left_semi")


# -- histogram -----------------------------------------------------------------


def as_number(c: Column, df: DataFrame) -> Column:
    """Numbers as they are, dates and timestamps as days and microseconds."""
    kind = df.select(c.alias("c")).schema["c"].dataType.typeName()
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def complete_histogram(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Sorted bucket edges: ``buckets + 1`` quantiles of the column. The list has a fixed size."""
    value = as_number(F.col(column), df)
    fractions = [i / buckets for i in range(buckets + 1)]
    edges = df.agg(F.percentile_approx(value, fractions, max(10000, 10 * buckets)).alias("q")).first().q
    return edges or []


def with_bucket(df: DataFrame, value: Column, edges: Sequence[float], into: str) -> DataFrame:
    """Adds the bucket number of a value: from 0, the last one closed, ``OUTSIDE`` beyond the ends, NULL for NULL.

    A binary search with one projection per step, all of them compiled into one stage: log2(n) comparisons a row.
    """
    if not edges:
        return df.withColumn(into, F.when(value.isNotNull(), F.lit(OUTSIDE)))
    inner = [float(e) for e in edges[1:-1]]
    steps = max(1, len(inner).bit_length())
    bounds = F.from_json(F.lit(json.dumps(inner)), "array<double>")
    at = df.withColumn("__value", value).withColumn("__at", F.lit(0))
    for k in reversed(range(steps)):
        # NULL beyond the last bound: not passed
        passed = F.get(bounds, F.col("__at") + F.lit((1 << k) - 1)) <= F.col("__value")
        at = at.withColumn("__at", F.when(passed, F.col("__at") + F.lit(1 << k)).otherwise(F.col("__at")))
    v = F.col("__value")
    found = F.when((v < F.lit(float(edges[0]))) | (v > F.lit(float(edges[-1]))), F.lit(OUTSIDE)).when(v.isNotNull(), F.col("__at"))
    return at.withColumn(into, found).drop("__value", "__at")


def predicate_buckets(edges: Sequence[float], op: str, value: float, value2: float | None = None) -> list[int]:
    """Buckets that can hold a match for ``< <= = >= > between``."""
    import bisect

    if not edges:  # no histogram: every value lies outside
        return [OUTSIDE]
    last = len(edges) - 2
    place = lambda v: min(max(bisect.bisect_right(edges, v) - 1, 0), last)
    # a run of equal edges is one value: take every bucket that touches it
    first_place = lambda v: min(max(bisect.bisect_left(edges, v) - 1, 0), last)
    lo, hi = 0, last
    outside = True  # values beyond the histogram may match any open-ended predicate
    if op == "=":
        lo, hi = first_place(value), place(value)
        outside = value < edges[0] or value > edges[-1]
    elif op in ("<", "<="):
        hi = place(value)
    elif op in (">", ">="):
        lo = first_place(value)
    elif op == "between":
        lo, hi = first_place(value), place(value2)
        outside = value < edges[0] or value2 > edges[-1]
    else:
        raise ValueError(op)
    return list(range(lo, hi + 1)) + ([OUTSIDE] if outside else [])


# -- summaries -----------------------------------------------------------------


def block_buckets(table: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Partial histogram of every block: the set of buckets its rows fall in."""
    placed = with_bucket(table.select(BLOCK, column), as_number(F.col(column), table), edges, "__b")
    return placed.groupBy(BLOCK).agg(F.sort_array(F.collect_set("__b")).alias("buckets"), F.count(F.lit(1)).alias("rows"))


def mask_of(found: Sequence[int], buckets: int) -> int:
    """A set of buckets as the bits of a number; ``OUTSIDE`` is the bit after the last bucket."""
    mask = 0
    for b in found:
        mask |= 1 << (buckets if b == OUTSIDE else int(b))
    return mask


class Effect:
    """What a run of blocks does to the entry that is open when it begins.

    The open entry ``held`` closes at the first block at which it becomes full. That can only be a block that adds a
    bucket to the run so far, so there are at most as many places as an entry has buckets. From such a place on nothing
    depends on ``held`` any more: the entries that the rest of the run closes, and what it leaves open, are known.
    Effects of neighbouring runs combine into one of the same form, in any grouping, and its size does not depend on
    the length of the run.
    """

    def __init__(self, cuts: list[tuple[int, int, int]], whole: int, full: Callable[[int], bool]):
        self.cuts, self.whole, self.full = cuts, whole, full

    @classmethod
    def of(cls, masks: Sequence[int], full: Callable[[int], bool]) -> Effect:
        n = len(masks)
        known = {n: (0, 0)}  # first block of a fresh entry -> entries closed from there on, buckets left open

        def after(at: int) -> tuple[int, int]:
            path = []
            while at not in known:
                held, end = 0, at
                while end < n and not full(held):
                    held, end = held | masks[end], end + 1
                if not full(held):
                    known[at] = (0, held)
                    break
                path.append(at)
                at = end
            for start in reversed(path):
                known[start] = (known[at][0] + 1, known[at][1])
                at = start
            return known[at]

        cuts, whole = [], 0
        for i, m in enumerate(masks):
            if m & ~whole:
                whole |= m
                closed, left = after(i + 1)
                cuts.append((whole, closed + 1, left))
                if full(whole):
                    break
        return cls(cuts, whole, full)

    def apply(self, held: int) -> tuple[int, int]:
        """Entries closed, and what is open at the end."""
        for prefix, closed, left in self.cuts:
            if self.full(held | prefix):
                return closed, left
        return 0, held | self.whole

    def then(self, other: Effect) -> Effect:
        cuts = []
        for prefix, closed, left in self.cuts:
            more, rest = other.apply(left)
            cuts.append((prefix, closed + more, rest))
        seen = self.whole
        for prefix, closed, left in other.cuts:
            if self.full(seen):
                break
            if prefix & ~seen:
                seen |= prefix
                cuts.append((seen, closed, left))
        return Effect(cuts, self.whole | other.whole, self.full)

    def text(self) -> str:
        return json.dumps([[[hex(p), c, hex(h)] for p, c, h in self.cuts], hex(self.whole)])

    @classmethod
    def read(cls, text: str, full: Callable[[int], bool]) -> Effect:
        cuts, whole = json.loads(text)
        return cls([(int(p, 16), c, int(h, 16)) for p, c, h in cuts], int(whole, 16), full)


def _starts(effects: DataFrame, full: Callable[[int], bool], fan: int) -> DataFrame:
    """``shard entry held`` as they are when each shard begins, from ``shard effect``: runs of ``fan`` shards are
    combined into one, those begin where this function says, and each run is walked from there."""
    run = effects.withColumn("run", F.floor(F.col("shard") / fan))
    if effects.select(F.floor(F.col("shard") / fan)).distinct().limit(2).count() <= 1:
        begun = run.withColumn("entry", F.lit(0).cast("long")).withColumn("held", F.lit("0x0"))
    else:

        def combine(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("shard")
            total = None
            for text in rows["effect"]:
                e = Effect.read(text, full)
                total = e if total is None else total.then(e)
            return pd.DataFrame({"shard": [rows["run"].iloc[0]], "effect": [total.text()]})

        above = cut_lineage(run.groupBy("run").applyInPandas(combine, "shard long, effect string"))
        begun = run.join(_starts(above, full, fan).withColumnRenamed("shard", "run"), "run")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        entry, held, out = int(rows["entry"].iloc[0]), int(rows["held"].iloc[0], 16), []
        for text in rows["effect"]:
            out.append((entry, hex(held)))
            closed, held = Effect.read(text, full).apply(held)
            entry += closed
        return pd.DataFrame({"shard": rows["shard"].to_numpy(), "entry": [e for e, _ in out], "held": [h for _, h in out]})

    return begun.select("run", "shard", "effect", "entry", "held").groupBy("run").applyInPandas(walk, "shard long, entry long, held string")


def group_blocks(blocks: DataFrame, buckets: int, density: float = 20.0, shard: int = SHARD_BLOCKS, fan: int = FAN) -> DataFrame:
    """Number the entries: neighbouring blocks share one until its set is denser than ``density`` percent.

    Works on one row per block (``block buckets rows``). Shards of neighbours are folded side by side; where their first
    entry begins is known from a prefix pass over the shards' effects, so entries cross shards and equal one fold.
    """
    full = lambda held: 100.0 * held.bit_count() / buckets > density
    sharded = cut_lineage(blocks.select(BLOCK, "buckets", "rows").withColumn("shard", F.floor(F.col(BLOCK) / shard)))

    def effect(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(BLOCK)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "effect": [Effect.of([mask_of(b, buckets) for b in rows["buckets"]], full).text()]})

    effects = cut_lineage(sharded.groupBy("shard").applyInPandas(effect, "shard long, effect string"))
    begun = _starts(effects, full, fan)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(BLOCK)
        entry, held, out = int(rows["entry"].iloc[0]), int(rows["held"].iloc[0], 16), []
        for found in rows["buckets"]:
            held |= mask_of(found, buckets)
            out.append(entry)
            if full(held):
                entry, held = entry + 1, 0
        return rows.assign(entry=out)[[BLOCK, "buckets", "rows", "entry"]]

    return sharded.join(begun, "shard").groupBy("shard").applyInPandas(fold, f"{BLOCK} int, buckets array<int>, rows long, entry long")


def entries(grouped: DataFrame) -> DataFrame:
    """One row per entry: union of its blocks' buckets. Blocks without a bucket (all NULL) count as well."""
    sets = grouped.select("entry", F.explode_outer("buckets").alias("b")).groupBy("entry").agg(F.sort_array(F.collect_set("b")).alias("buckets"))
    sizes = grouped.groupBy("entry").agg(F.min(BLOCK).alias("first_block"), F.max(BLOCK).alias("last_block"), F.count(F.lit(1)).alias("blocks"), F.sum("rows").alias("rows"))
    return sizes.join(sets, "entry")


@dataclass
class Index:
    """Histogram index of one column of a table of blocks."""

    column: str
    edges: list[float]
    density: float
    summary: DataFrame  # block, buckets, rows, entry; stored, so that lookups do not read the table
    entries: DataFrame  # entry, buckets; stored

    @classmethod
    def build(cls, table: DataFrame, column: str, buckets: int = 400, density: float = 20.0, edges: list[float] | None = None) -> Index:
        edges = complete_histogram(table, column, buckets) if edges is None else edges
        return cls._of(column, edges, density, cut_lineage(group_blocks(block_buckets(table, column, edges), max(len(edges) - 1, 1), density)))

    @classmethod
    def _of(cls, column: str, edges: list[float], density: float, summary: DataFrame) -> Index:
        return cls(column, edges, density, summary, cut_lineage(entries(summary)))

    @property
    def buckets(self) -> int:
        return max(len(self.edges) - 1, 1)

    def candidates(self, op: str, value: float, value2: float | None = None) -> DataFrame:
        """Blocks that can hold matches, as a DataFrame."""
        wanted = F.from_json(F.lit(json.dumps(predicate_buckets(self.edges, op, value, value2))), "array<int>")
        hit = self.entries.filter(F.arrays_overlap("buckets", wanted)).select("entry")
        return self.summary.join(hit, "entry", "left_semi").select(BLOCK)

    def next_block(self) -> int:
        """First number that no block has had."""
        return (self.summary.agg(F.max(BLOCK)).first()[0] or -1) + 1

    def _with(self, kept: DataFrame, new_blocks: DataFrame) -> Index:
        more = group_blocks(block_buckets(new_blocks, self.column, self.edges), self.buckets, self.density)
        last = kept.agg(F.coalesce(F.max("entry"), F.lit(-1)).alias("last"))
        more = more.crossJoin(F.broadcast(last)).withColumn("entry", F.col("entry") + F.col("last") + 1).drop("last")
        return Index._of(self.column, self.edges, self.density, cut_lineage(kept.unionByName(more)))

    def add_blocks(self, new_blocks: DataFrame) -> Index:
        """Index after an append: only the new blocks are read."""
        return self._with(self.summary, new_blocks)

    def replace_blocks(self, gone: DataFrame, rewritten: DataFrame) -> Index:
        """Index after blocks were rewritten, under new numbers, by a delete: only those are read."""
        return self._with(self.summary.join(gone.select(BLOCK).distinct(), BLOCK, "left_anti"), rewritten)


# -- other summaries -----------------------------------------------------------


def minmax_summary(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and greatest value and NULL presence per block and column."""
    aggs = []
    for c in columns:
        aggs += [
            F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.bool_or(F.col(c).isNull()).alias(f"{c}_has_null"),
            F.bool_and(F.col(c).isNull()).alias(f"{c}_all_null"),
        ]
    return cut_lineage(table.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("rows"), *aggs))


def minmax_candidates(summary: DataFrame, column: str, op: str, value) -> DataFrame:
    lo, hi, v = F.col(f"{column}_min"), F.col(f"{column}_max"), F.lit(value)
    test = {"<": lo < v, "<=": lo <= v, "=": (lo <= v) & (v <= hi), ">=": hi >= v, ">": hi > v, "is null": F.col(f"{column}_has_null")}[op]
    return summary.filter(test).select(BLOCK)


def inclusion_summary(table: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """Hull of the intervals (or of one axis of the boxes) in each block."""
    return cut_lineage(table.groupBy(BLOCK).agg(F.min(lower).alias("lo"), F.max(upper).alias("hi")))


def inclusion_candidates(summary: DataFrame, lower, upper) -> DataFrame:
    """Blocks that can hold an interval overlapping [lower, upper]."""
    return summary.filter((F.col("lo") <= F.lit(upper)) & (F.col("hi") >= F.lit(lower))).select(BLOCK)


def signature_size(error: float) -> tuple[int, float]:
    """Bits to set for a value and values for each 64-bit word, so that a value that is absent passes with the chance
    ``error``: the values of a word are Poisson distributed."""

    def passes(k: int, load: float) -> float:
        total, p = 0.0, math.exp(-load)
        for i in range(1, 200):
            p *= load / i
            total += p * (1 - (63 / 64) ** (k * i)) ** k
        return total

    best = (1, 0.0)
    for k in range(1, 11):
        low, high = 1e-6, 64.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if passes(k, middle) <= error else (low, middle)
        if low > best[1]:
            best = (k, low)
    return best


@dataclass
class Signatures:
    """Blocked Bloom filters: a value sets ``bits`` bits of one 64-bit word of its block's filter. Words are rows
    (``block column word mask``), merged by OR before and after the shuffle; words without a bit are not stored, so a
    small block has a small filter. A filter has as many words as the block of most distinct values needs for the error
    wanted."""

    columns: list[str]
    bits: int
    words: list[int]  # by column
    cells: DataFrame

    @classmethod
    def build(cls, table: DataFrame, columns: Sequence[str], error: float = 0.01) -> Signatures:
        bits, load = signature_size(error)
        per_block = table.groupBy(BLOCK).agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(columns)])
        most = per_block.agg(*[F.max(f"n{i}") for i in range(len(columns))]).first()
        words = [max(1, math.ceil(1.05 * (n or 0) / load)) for n in most]
        found = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("column"), *cls._place(F.col(c), n, bits))) for i, (c, n) in enumerate(zip(columns, words))])
        cells = table.select(BLOCK, F.explode(F.array_compact(found)).alias("x")).groupBy(BLOCK, "x.column", "x.word").agg(F.bit_or("x.mask").alias("mask"))
        return cls(list(columns), bits, words, cut_lineage(cells))

    @staticmethod
    def _place(value: Column, words: int, bits: int) -> list[Column]:
        h = F.xxhash64(value, F.lit(1))
        mask = F.lit(0).cast("long")
        for j in range(bits):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")))
        return [F.pmod(F.xxhash64(value, F.lit(2)), F.lit(words)).cast("long").alias("word"), mask.alias("mask")]

    def candidates(self, **equals: Column) -> DataFrame:
        """Blocks whose signatures hold the wanted values, which have the columns' types."""
        out = None
        for c, v in equals.items():
            i = self.columns.index(c)
            word, mask = self._place(v, self.words[i], self.bits)
            part = self.cells.filter((F.col("column") == i) & (F.col("word") == word) & (F.col("mask").bitwiseAND(mask) == mask)).select(BLOCK)
            out = part if out is None else out.join(part, BLOCK, "left_semi")
        return out


#: Postings of a part, about, and of one file of a frequent element.
PART_ROWS = 4_000_000


def write_postings(pairs: DataFrame, element: str, path: str, part_rows: int = PART_ROWS) -> int:
    """Inverted summary: element to key rows, in folders by element hash. Returns the number of parts, which follows
    the rows, as :func:`read_postings` needs it.

    A salt by row content splits the rows of a part over as many files as its rows fill.
    """
    pairs = cut_lineage(pairs)
    home = lambda parts: F.pmod(F.xxhash64(element), F.lit(parts)).cast("int")
    parts = max(1, math.isqrt(pairs.count() // max(1, part_rows // 4096)))
    sizes = pairs.groupBy(home(parts).alias("part")).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("__files"))
    placed = pairs.withColumn("part", home(parts)).join(broadcast_if_small(sizes), "part")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in pairs.columns]), F.col("__files"))
    placed.withColumn("__salt", salt).repartition("part", "__salt").drop("__salt", "__files").write.partitionBy("part").parquet(path)
    return parts


def read_postings(spark: SparkSession, path: str, element: str, values: Sequence[str], parts: int) -> DataFrame:
    """Postings of some elements; only their folders are opened."""
    wanted = F.array(*[F.lit(v) for v in values])
    homes = spark.range(1).select(F.explode(F.transform(wanted, lambda v: F.pmod(F.xxhash64(v), F.lit(parts)).cast("int"))).alias("p"))
    numbers = [r.p for r in homes.distinct().collect()]
    return spark.read.parquet(path).filter(F.col("part").isin(numbers) & F.col(element).isin(*values)).drop("part")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks named by two candidate sets."""
    return a.select(BLOCK).distinct().join(b.select(BLOCK).distinct(), BLOCK, "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(BLOCK).union(b.select(BLOCK)).distinct()
