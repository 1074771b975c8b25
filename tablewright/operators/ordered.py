"""Ordered analytics that stay parallel when one key owns most rows.

A plain window sorts every row of a key in one task. Here the order axis of
each key is cut into chunks at sampled quantiles, windows run per chunk, and a
small table of chunk totals supplies what earlier chunks contribute.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tablewright.functions.core import bind
from tablewright.session import stored

KEY, CHUNK, RN, BLOCK = "__key", "__chunk", "__rn", "__block"
SAMPLES_PER_CHUNK = 16
FLAT_SEARCH = 64
FANOUT = 32
MAX_CHUNKS = 8192


def parse_order(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``["-price", "id"]`` → ``[("price", True), ("id", False)]``."""
    return [(o[1:], True) if o.startswith("-") else (o, False) for o in order]


def sort_columns(order: Sequence[str]) -> list[Column]:
    """NULLs sort as the greatest value, whichever the direction."""
    return [
        F.col(n).desc_nulls_first() if desc else F.col(n).asc_nulls_last()
        for n, desc in parse_order(order)
    ]


def group_key(keys: Sequence[str]) -> Column:
    """One column that stands for all keys; NULL keys equal each other in it."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def default_chunks(df: DataFrame) -> int:
    """One chunk per shuffle partition, so that a chunk is as large as a sort partition."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(16, min(MAX_CHUNKS, int(conf)))


def _position(order: Sequence[str]) -> tuple[Column, bool]:
    """Comparable struct of the leading order columns that share a direction."""
    parsed = parse_order(order)
    desc = parsed[0][1]
    fields = []
    for name, d in parsed:
        if d != desc:
            break
        fields += [F.col(name).isNull().alias(f"n{len(fields)}"), F.col(name).alias(f"v{len(fields)}")]
    return F.struct(*fields), desc


def _search_tree(value: Column, bounds: Column, n: int, desc: bool) -> Column:
    """Number of the ``n`` sorted bounds at or before ``value``: a decision tree, compiled
    with the rest of the stage, that makes log2(n) comparisons per row."""

    def node(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        bound = F.get(bounds, F.lit(mid))
        passed = bound >= value if desc else bound <= value
        return F.when(passed, node(mid + 1, high)).otherwise(node(low, mid))

    return node(0, n)


def chunk_of(df: DataFrame, order: Sequence[str], chunks: int | None = None) -> Column:
    """Chunk number of a row along ``order``; bounds come from a sample of about
    ``SAMPLES_PER_CHUNK`` rows a chunk.

    The first order column alone decides unless one of its values fills several chunks.
    """
    chunks = chunks or default_chunks(df)
    position, desc = _position(order)
    # the count only sets the rate: each task draws on its own and sends few rows
    rate = min(1.0, chunks * SAMPLES_PER_CHUNK / max(1, df.count()))
    sample = (
        df.select(position.alias("p")).sample(rate, 17)
        .agg(F.sort_array(F.collect_list("p"), asc=not desc).alias("ps"))
        .select(F.explode("ps").alias("p")).select(F.to_json("p").alias("j"))
    )
    drawn = [row.j for row in sample.collect()]
    step = max(1, len(drawn) // chunks)
    bounds = list(dict.fromkeys(drawn[step::step]))
    if not bounds:
        return F.lit(0)
    kind = df.select(position.alias("p")).schema["p"].dataType
    lead = [json.loads(b) for b in bounds]
    leading = list(dict.fromkeys(json.dumps(b["v0"]) for b in lead if "v0" in b))
    if len(leading) == len(bounds):
        column = F.col(parse_order(order)[0][0])
        found = _find(column, leading, kind["v0"].dataType.simpleString(), desc, compiled=True)
        return F.when(column.isNull(), F.lit(0 if desc else len(bounds))).otherwise(found)
    return _find(position, bounds, kind.simpleString(), desc, compiled=False)


def _find(value: Column, bounds: list[str], kind: str, desc: bool, compiled: bool) -> Column:
    """Place of a value among sorted bounds, given as JSON texts."""

    def literal(items: list[str]) -> Column:
        return F.from_json(F.lit("[" + ",".join(items) + "]"), f"array<{kind}>")

    def counted(array: Column, v: Column) -> Column:
        return F.size(F.filter(array, (lambda b: b >= v) if desc else (lambda b: b <= v)))

    def place(v: Column) -> Column:
        passed = (lambda array, n: _search_tree(v, array, n, desc)) if compiled else (lambda array, n: counted(array, v))
        if len(bounds) <= FLAT_SEARCH:
            return passed(literal(bounds), len(bounds))
        fan = max(FANOUT, math.isqrt(len(bounds)))
        blocks = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
        outer = passed(literal([b[0] for b in blocks]), len(blocks))
        nested = F.from_json(
            F.lit("[" + ",".join("[" + ",".join(b) + "]" for b in blocks) + "]"), f"array<array<{kind}>>"
        )
        inner = bind(v, lambda w: counted(F.get(nested, F.greatest(outer - 1, F.lit(0))), w))
        return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * fan + inner)

    # the planner may put a value's whole expression in its place: a lambda's is evaluated once a row, not once a bound
    return place(value) if compiled else bind(value.cast(kind), place)


def _prepare(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None) -> DataFrame:
    return df.withColumn(KEY, group_key(keys)).withColumn(CHUNK, chunk_of(df, order, chunks))


def _merge(fn: str, column: Column) -> Column:
    return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[fn](column)


def _latest(order: Sequence[str], column: str, first: bool = False) -> Column:
    """Aggregate: the non-NULL value that comes last (or ``first``) in a one-way order."""
    position, desc = _position(order)
    known = F.col(column).isNotNull()
    return (F.min_by if desc != first else F.max_by)(F.when(known, F.col(column)), F.when(known, position))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    totals: Mapping[str, tuple[str, str]] | None = None,
    chunks: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates up to and including each row, or before it when not ``inclusive``.

    ``aggs`` maps an output name to ``(sum|count|min|max|last|next, column)``; ``last``
    is the latest non-NULL value, ``next`` the first non-NULL one from the row on, in an order
    whose columns share a direction. ``totals`` adds whole-key ``sum``/``count``/
    ``min``/``max`` values. ``order`` must not leave ties.
    """
    totals = totals or {}
    one_way = len({desc for _, desc in parse_order(order)}) == 1
    if not one_way and any(fn == "next" for fn, _ in aggs.values()):
        raise ValueError("next needs order columns of one direction")
    prepared = _prepare(df, keys, order, chunks)
    ordering = sort_columns(order)
    end = 0 if inclusive else -1
    local = Window.partitionBy(KEY, CHUNK).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)
    if not inclusive and any(fn in ("last", "next") for fn, _ in aggs.values()):
        raise ValueError("last and next are inclusive only")
    # a frame that ends with the key is aggregated anew for each row; from the back it is a running one
    backwards = Window.partitionBy(KEY, CHUNK).orderBy(*_reverse(order)).rowsBetween(Window.unboundedPreceding, 0)
    apply = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}

    partial = prepared
    chunk_aggs = []
    for name, (fn, column) in aggs.items():
        if fn == "last":
            partial = partial.withColumn(name, F.last(column, ignorenulls=True).over(local))
        elif fn == "next":
            partial = partial.withColumn(name, F.last(column, ignorenulls=True).over(backwards))
            chunk_aggs.append(_latest(order, column, first=True).alias(f"__c_{name}"))
        else:
            partial = partial.withColumn(name, apply[fn](column).over(local))
            chunk_aggs.append(apply[fn](column).alias(f"__c_{name}"))
    for name, (fn, column) in totals.items():
        chunk_aggs.append(apply[fn](column).alias(f"__t_{name}"))
    if one_way:
        chunk_aggs += [_latest(order, c).alias(f"__c_{n}") for n, (fn, c) in aggs.items() if fn == "last"]

    stats = prepared.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("__rows"), *chunk_aggs)
    lasts = [(name, column) for name, (fn, column) in aggs.items() if fn == "last" and not one_way]
    if lasts:
        # the last row of a chunk carries the running value out of it
        tail = Window.partitionBy(KEY, CHUNK).orderBy(*_reverse(order))
        ends = (
            partial.withColumn("__back", F.row_number().over(tail))
            .filter("__back = 1")
            .select(KEY, CHUNK, *[F.col(n).alias(f"__c_{n}") for n, _ in lasts])
        )
        stats = stats.join(ends, [KEY, CHUNK])

    by_chunk = Window.partitionBy(KEY).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(KEY).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(KEY)
    carry = stats.select(
        KEY,
        CHUNK,
        *[
            (
                F.last(f"__c_{name}", ignorenulls=True).over(before if fn == "last" else after)
                if fn in ("last", "next")
                else _merge(fn, F.col(f"__c_{name}")).over(before)
            ).alias(f"__b_{name}")
            for name, (fn, _) in aggs.items()
        ],
        *[_merge(fn, F.col(f"__t_{name}")).over(whole).alias(name) for name, (fn, _) in totals.items()],
    )
    out = partial.join(carry, [KEY, CHUNK])
    for name, (fn, _) in aggs.items():
        mine, earlier = F.col(name), F.col(f"__b_{name}")
        if fn == "count":
            value = mine + F.coalesce(earlier, F.lit(0))
        elif fn == "sum":
            value = F.coalesce(mine + earlier, mine, earlier)
        elif fn in ("last", "next"):
            value = F.coalesce(mine, earlier)
        else:
            value = {"min": F.least, "max": F.greatest}[fn](mine, earlier)
        out = out.withColumn(name, value)
    return out.drop(KEY, CHUNK, *[f"__b_{name}" for name in aggs])


def _reverse(order: Sequence[str]) -> list[Column]:
    return [
        F.col(n).asc_nulls_last() if desc else F.col(n).desc_nulls_first()
        for n, desc in parse_order(order)
    ]


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    into: str = "row_number",
    total: str | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Row number per key, and optionally the row count of the key."""
    prepared = _prepare(df, keys, order, chunks)
    local = Window.partitionBy(KEY, CHUNK).orderBy(*sort_columns(order))
    stats = prepared.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    picked = [F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")]
    if total:
        picked.append(F.sum("__rows").over(Window.partitionBy(KEY)).alias(total))
    carry = stats.select(KEY, CHUNK, *picked)
    return (
        prepared.withColumn(into, F.row_number().over(local))
        .join(carry, [KEY, CHUNK])
        .withColumn(into, F.col(into) + F.col("__before"))
        .drop(KEY, CHUNK, "__before")
    )


def ntile(column: Column, total: Column, n: int) -> Column:
    """Bucket of a row number when ``total`` rows go to ``n`` buckets, larger ones first."""
    small, extra = F.floor(total / n), total % n
    wide = extra * (small + 1)
    return F.when(column <= wide, F.floor((column - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((column - 1 - wide) / F.greatest(small, F.lit(1))) + 1
    )


def rank_values(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ranks of the distinct order values of each key.

    Peers are counted before the shuffle, so a value shared by most rows is one row.
    """
    columns = [n for n, _ in parse_order(order)]
    values = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("peers"))
    ranked = running(
        values, keys, order, {"__cum": ("sum", "peers"), "dense_rank": ("count", "peers")},
        totals={"__total": ("sum", "peers")},
    )
    rank = F.col("__cum") - F.col("peers") + 1
    return ranked.select(
        *keys, *columns, "peers", rank.alias("rank"), "dense_rank",
        F.when(F.col("__total") == 1, F.lit(0.0)).otherwise((rank - 1) / (F.col("__total") - 1)).alias("percent_rank"),
        (F.col("__cum") / F.col("__total")).alias("cume_dist"),
    )


def with_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist``."""
    columns = [*keys, *[n for n, _ in parse_order(order)]]
    ranks = rank_values(df, keys, order).withColumn("__v", F.struct(*columns)).drop(*columns)
    return df.withColumn("__v", F.struct(*columns)).join(ranks, "__v").drop("__v")


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    exprs: Mapping[str, Callable[[WindowSpec], Column]],
    block_rows: int = 65536,
    chunks: int | None = None,
) -> DataFrame:
    """Window expressions that look at most ``before``/``after`` rows away.

    Rows are numbered, cut into blocks, and rows near a block edge are copied to
    the neighbour that needs them. ``exprs`` get the ordered window of the block.
    """
    size = max(block_rows, before, after)
    numbered = number_rows(df, keys, order, RN, chunks=chunks).withColumn(KEY, group_key(keys))
    own = F.floor((F.col(RN) - 1) / size)
    offset = (F.col(RN) - 1) % size
    homes = F.array_compact(
        F.array(
            own,
            F.when(offset >= size - before, own + 1),
            F.when((offset < after) & (own > 0), own - 1),
        )
    )
    spread = numbered.withColumn("__own", own).withColumn(BLOCK, F.explode(homes))
    w = Window.partitionBy(KEY, BLOCK).orderBy(RN)
    for name, make in exprs.items():
        spread = spread.withColumn(name, make(w))
    return spread.filter(F.col(BLOCK) == F.col("__own")).drop(KEY, BLOCK, "__own", RN)


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    offset: Column,
    into: str,
    default: Column | None = None,
) -> DataFrame:
    """Value ``offset`` rows earlier, where the offset may differ per row."""
    numbered = number_rows(df, keys, order, RN).withColumn(KEY, group_key(keys))
    source = numbered.select(F.col(KEY), F.col(RN).alias("__at"), F.col(value).alias(into), F.lit(True).alias("__hit"))
    out = numbered.withColumn("__at", F.col(RN) - offset).join(source, [KEY, "__at"], "left")
    if default is not None:
        out = out.withColumn(into, F.when(F.col("__hit"), F.col(into)).otherwise(default))
    return out.drop(KEY, "__at", "__hit", RN)


def nth_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    n: Mapping[str, Column | int],
    frame: tuple[int | None, int | None] | str = (None, None),
    chunks: int | None = None,
) -> DataFrame:
    """Value of the ``n``-th row of each row's frame, one column for each name in ``n``.

    ``n`` counts from 1 and may be an expression that differs per row: NULL gives NULL,
    a number below 1 ends the query with an error, and one past the frame's end gives NULL.
    ``frame`` is ``(preceding, following)`` in rows, ``None`` for unbounded, negative for
    the other side; or ``"range"``, from the start of the key to the last peer of the row.
    The column order must not leave ties unless the frame is ``"range"`` and the tied
    values equal.

    Rows are numbered once. A place in the frame is then a row number of the key, fetched by
    an equality join, however large ``n`` is. A place that does not depend on the row meets one
    row of each key.
    """
    ranged = frame == "range"
    preceding, following = (None, 0) if ranged else frame
    numbered = number_rows(df, keys, order, RN, total="__total", chunks=chunks).withColumn(KEY, group_key(keys))
    first = F.lit(1).cast("long") if preceding is None else F.greatest(F.col(RN) - preceding, F.lit(1).cast("long"))
    last = F.col("__total") if following is None else F.least(F.col(RN) + following, F.col("__total"))
    out = numbered
    if ranged:
        columns = [c for c, _ in parse_order(order)]
        peers = numbered.groupBy(KEY, *[F.col(c).alias(f"__p{i}") for i, c in enumerate(columns)]).agg(F.max(RN).alias("__last"))
        same = [F.col(KEY).eqNullSafe(F.col("__k"))] + [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(columns)]
        out = out.join(peers.withColumnRenamed(KEY, "__k"), _all(same)).drop("__k", *[f"__p{i}" for i in range(len(columns))])
        last = F.col("__last")
    for name, place in n.items():
        place = F.lit(place) if isinstance(place, int) else place
        wrong = F.raise_error(F.lit("the argument of nth_value must be greater than zero"))
        at = first + F.when(place < 1, wrong.cast("long")).otherwise(place.cast("long")) - 1
        found = numbered.select(KEY, F.col(RN).alias("__at"), F.col(value).alias(name))
        out = out.withColumn("__at", F.when(at <= last, at)).join(found, [KEY, "__at"], "left").drop("__at")
    return out.drop(KEY, RN, "__total", "__last")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    kind: str = "cont",
) -> DataFrame:
    """Exact quantiles per key, one column for each name in ``probs``.

    Equal values are counted first and only cumulative counts are compared, so
    no task holds the values of a key. ``disc`` works for any ordered type. The counts
    are stored: what makes the values is read and evaluated once.
    """
    every = stored(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), "counts")
    counts = every.filter(F.col(value).isNotNull())
    ranked = running(counts, keys, [value], {"__cum": ("sum", "__n")}, totals={"__total": ("sum", "__n")})
    total, high = F.col("__total"), F.col("__cum") - 1
    low = F.col("__cum") - F.col("__n")

    def at(index: Column) -> Column:
        return F.max(F.when((low <= index) & (index <= high), F.col(value)))

    aggs, outs = [], []
    for name, p in probs.items():
        if kind == "disc":
            aggs.append(at(F.greatest(F.ceil(total * F.lit(p)) - 1, F.lit(0))).alias(name))
            outs.append(F.col(name))
        else:
            spot = (total - 1) * F.lit(p)
            aggs += [
                at(F.floor(spot)).alias(f"__lo_{name}"),
                at(F.ceil(spot)).alias(f"__hi_{name}"),
                F.max(spot - F.floor(spot)).alias(f"__f_{name}"),
            ]
            lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
            outs.append((lo + (hi - lo) * F.col(f"__f_{name}")).alias(name))
    out = ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)
    if not keys:
        return out
    # a key whose values are all NULL has NULL quantiles
    void = every.groupBy(*keys).agg(F.count(value).alias("__n")).filter("__n = 0").select(*keys)
    return out.unionByName(void, allowMissingColumns=True)


def modes(df: DataFrame, keys: Sequence[str], value: str, into: str = "mode") -> DataFrame:
    """Most frequent value per key; the smallest of equally frequent ones; NULL if all are."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    place = F.when(F.col(value).isNotNull(), F.struct(-F.col("__n"), F.col(value)))
    return counts.groupBy(*keys).agg(F.min_by(value, place).alias(into))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 1) -> DataFrame:
    """First ``k`` rows per key. Spark trims every map task to ``k`` rows a key
    before the shuffle when ``k`` is below its window-group-limit threshold."""
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(RN, F.row_number().over(w)).filter(F.col(RN) <= k).drop(RN)
