"""Joins that are not plain equality: intervals, nearest value, distance, similarity."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import jsonx, strings
from tablewright.operators import ordered, overlaps

LEVEL_LIMIT = 64


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint behind a row check; larger sides are left to the shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    hot_rows: int = 1_000_000, salts: int = 64,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over ``salts`` tasks.

    Only keys with more than ``hot_rows`` left rows are salted, and only right rows
    of those keys are copied. Supports inner, left, left_semi and left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} cannot repeat right rows")
    on = list(on)
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = broadcast_if_small(hot.select(*on, F.lit(True).alias("__hot")))
    # a hash of the row, not a random number: a retried task must draw the same salt
    content = [F.col(f.name) for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*content), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = left.join(hot, on, "left").withColumn("__salt", salt).drop("__hot")
    copied = right.join(hot, on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return spread.join(copied, [*on, "__salt"], how).drop("__salt")


def _level(length: Column) -> Column:
    """Smallest power of two that covers a length."""
    return F.greatest(
        F.least(F.ceil(F.log2(F.greatest(length.cast("double"), F.lit(1e-18)))), F.lit(LEVEL_LIMIT)), F.lit(-LEVEL_LIMIT)
    ).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level.cast("double")))


def point_in_interval_join(
    points: DataFrame, intervals: DataFrame, point: str, lower: str, upper: str,
    keys: Sequence[str] = (), strict_lower: bool = False,
) -> DataFrame:
    """Pairs with ``lower <= point < upper`` (``lower <`` when strict) on a numeric axis.

    An interval lives in the one or two cells of a grid as coarse as itself, so
    candidates stay proportional to matches whatever the mix of lengths. Equal
    points of a key are matched once and multiplied out only where they match.
    """
    keys = list(keys)
    spans = intervals.select(*keys, F.col(lower).alias("__lo"), F.col(upper).alias("__hi")).distinct()
    spans = spans.filter("__lo < __hi").withColumn("__level", _level(F.col("__hi") - F.col("__lo")))
    levels = [r[0] for r in spans.select("__level").distinct().collect()]  # at most 129 values
    if not levels:
        levels = [0]
    probes = (
        points.select(*keys, F.col(point).alias("__p")).filter("__p is not null").distinct()
        .withColumn("__level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
        .withColumn("__cell", _cell(F.col("__p"), F.col("__level")))
    )
    spans = spans.withColumn(
        "__cell",
        F.explode(F.sequence(_cell(F.col("__lo"), F.col("__level")), _cell(F.col("__hi"), F.col("__level")))),
    )
    above = F.col("__p") > F.col("__lo") if strict_lower else F.col("__p") >= F.col("__lo")
    hits = (
        probes.join(spans, [*keys, "__level", "__cell"])
        .filter(above & (F.col("__p") < F.col("__hi")))
        .select(*keys, "__p", "__lo", "__hi")
    )
    left = points.withColumn("__p", F.col(point))
    right = intervals.withColumn("__lo", F.col(lower)).withColumn("__hi", F.col(upper))
    return left.join(hits, [*keys, "__p"]).join(right, [*keys, "__lo", "__hi"]).drop("__p", "__lo", "__hi")


def overlap_join(
    left: DataFrame, right: DataFrame, lower: tuple[str, str], upper: tuple[str, str], keys: Sequence[str] = (),
) -> DataFrame:
    """Pairs of half-open intervals that overlap; column names of the sides must differ.

    Two intervals overlap when the start of one lies in the other, so the join is
    two disjoint point-in-interval joins.
    """
    first = point_in_interval_join(left, right, lower[0], lower[1], upper[1], keys)
    second = point_in_interval_join(right, left, lower[1], lower[0], upper[0], keys, strict_lower=True)
    # an empty interval overlaps nothing
    whole = (F.col(lower[0]) < F.col(upper[0])) & (F.col(lower[1]) < F.col(upper[1]))
    return first.unionByName(second).filter(whole)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: tuple[str, str], tie: tuple[str, str],
    payload: Sequence[str], direction: str = "backward",
) -> DataFrame:
    """Latest right row at or before (``backward``) or first at or after (``forward``) each left row.

    ``tie`` names a unique column of each side; the greatest (backward) or smallest
    (forward) one wins among equal times. Payload columns come out as a struct ``match``.
    """
    back = direction == "backward"
    side = F.lit(1 if back else 0)
    other = F.lit(0 if back else 1)
    a = left.select(
        *keys, F.col(at[0]).alias("__t"), side.alias("__side"), F.col(tie[0]).alias("__id"),
        F.struct(*left.columns).alias("__row"),
        F.lit(None).cast(right.select(F.struct(*payload).alias("s")).schema["s"].dataType).alias("__hit"),
    )
    b = right.select(
        *keys, F.col(at[1]).alias("__t"), other.alias("__side"), F.col(tie[1]).alias("__id"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("__row"),
        F.struct(*payload).alias("__hit"),
    )
    sign = "" if back else "-"
    order = [f"{sign}__t", f"{sign}__side", f"{sign}__id"]
    joined = ordered.running(a.unionByName(b), keys, order, {"match": ("last", "__hit")})
    return joined.filter("__row is not null").select("__row.*", "match")


def neighbours_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: tuple[str, str], tie: tuple[str, str],
    payload: Sequence[str], names: tuple[str, str] = ("before", "after"),
) -> DataFrame:
    """Left rows with the latest right row at or before and the first at or after them, in one pass.

    ``tie`` names a unique column of each side; among right rows of one time the greatest is
    ``before`` and the smallest ``after``. Both come out as structs of the payload columns,
    NULL where there is none. NULL keys match as equal values do; a NULL time matches nothing.

    Right rows of one key and time are folded into one before rows are ordered, so a time shared
    by many rows costs one. The two sides are then ordered together once.
    """
    here = F.struct(*payload)
    spots = right.filter(F.col(at[1]).isNotNull()).groupBy(*keys, F.col(at[1]).alias("__t")).agg(
        F.max_by(here, F.col(tie[1])).alias("high"), F.min_by(here, F.col(tie[1])).alias("low")
    )
    spots = spots.select(*keys, "__t", F.struct("__t", "high", "low").alias("__hit"))
    hit, row = spots.schema["__hit"].dataType, left.select(F.struct("*").alias("r")).schema["r"].dataType
    none = F.lit(None)
    both = spots.select(*keys, "__t", F.lit(0).alias("__side"), none.alias("__id"), none.cast(row).alias("__row"), "__hit").unionByName(
        left.select(
            *keys, F.col(at[0]).alias("__t"), F.lit(1).alias("__side"), F.col(tie[0]).alias("__id"),
            F.struct("*").alias("__row"), none.cast(hit).alias("__hit"),
        )
    )
    # at its own time a left row stands behind the right row, which is then its neighbour on both sides
    placed = ordered.running(
        both, keys, ["__t", "__side", "__id"], {"__back": ("last", "__hit"), "__fore": ("next", "__hit")}
    ).filter("__row is not null")
    after = F.when(F.col("__back")["__t"] == F.col("__t"), F.col("__back")["low"]).otherwise(F.col("__fore")["low"])
    timed = F.col("__t").isNotNull()
    return placed.select("__row.*", F.when(timed, F.col("__back")["high"]).alias(names[0]), F.when(timed, after).alias(names[1]))


def nearest_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: tuple[str, str], tie: tuple[str, str],
    payload: Sequence[str],
) -> DataFrame:
    """Right row nearest to each left row on a numeric axis; the earlier one on equal distance.

    ``payload`` must contain the right axis column.
    """
    both = neighbours_join(left, right, keys, at, tie, payload, ("__back", "__fore"))
    gap_back = F.col(at[0]) - F.col("__back")[at[1]]
    gap_fore = F.col("__fore")[at[1]] - F.col(at[0])
    use_fore = F.col("__back").isNull() | (gap_fore < gap_back)
    return both.withColumn("match", F.when(use_fore, F.col("__fore")).otherwise(F.col("__back"))).drop("__back", "__fore")


def within_distance_join(
    left: DataFrame, right: DataFrame, left_xy: Sequence[str], right_xy: Sequence[str], radius: float,
) -> DataFrame:
    """Pairs at most ``radius`` apart, in any number of dimensions.

    Points fall in cells as wide as the radius; left points visit neighbour cells.
    Equal points are matched once.
    """
    dims = range(len(left_xy))
    cell = lambda c: F.floor(c / F.lit(radius))
    near = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in zip(dims, offs)]) for offs in product((-1, 0, 1), repeat=len(left_xy))])
    a = left.select(*[F.col(c).alias(f"__a{i}") for i, c in zip(dims, left_xy)]).distinct().withColumn("__o", F.explode(near))
    for i in dims:
        a = a.withColumn(f"__c{i}", cell(F.col(f"__a{i}")) + F.col("__o")[f"o{i}"])
    b = right.select(*[F.col(c).alias(f"__b{i}") for i, c in zip(dims, right_xy)]).distinct()
    for i in dims:
        b = b.withColumn(f"__c{i}", cell(F.col(f"__b{i}")))
    gap = F.sqrt(sum((F.pow(F.col(f"__a{i}") - F.col(f"__b{i}"), 2) for i in dims), F.lit(0.0)))
    hits = (
        a.drop("__o").join(b, [f"__c{i}" for i in dims]).withColumn("distance", gap)
        .filter(F.col("distance") <= radius).drop(*[f"__c{i}" for i in dims])
    )
    for i in dims:
        left = left.withColumn(f"__a{i}", F.col(left_xy[i]))
        right = right.withColumn(f"__b{i}", F.col(right_xy[i]))
    out = left.join(hits, [f"__a{i}" for i in dims]).join(right, [f"__b{i}" for i in dims])
    return out.drop(*[f"__a{i}" for i in dims], *[f"__b{i}" for i in dims])


def trigram_join(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 0.3, ascending: bool = False) -> DataFrame:
    """Pairs of distinct texts with trigram similarity of at least ``threshold``; with ``ascending`` those with ``a < b`` only.

    Every text is cut into its trigrams once. Rare trigrams bound little where few are shared, and common ones are in
    nearly all texts, so no index of trigrams keeps the pairs few: blocks of texts are compared as matrices instead, and
    only pairs that can reach the threshold are counted. Shuffled are the texts with their trigrams, once for each block
    they meet.
    """
    sides = left.select(F.col(a).alias("txt"), F.lit(True).alias("l"), F.lit(False).alias("r")).union(
        right.select(F.col(b).alias("txt"), F.lit(False).alias("l"), F.lit(True).alias("r"))
    )
    texts = sides.filter("txt is not null").groupBy("txt").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    # texts are short and their trigrams take long to make: the few partitions of the texts are dealt out again
    dealt = texts.repartition(ordered.default_chunks(left), F.xxhash64("txt"))
    return overlaps.similar_pairs(dealt.withColumn("gs", strings.trigram_codes(F.col("txt"))), a, b, threshold, ascending)


def edit_one_join(left: DataFrame, right: DataFrame, a: str, b: str, same: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct texts at edit distance 0 or 1, within equal ``same`` columns.

    Two such texts agree after dropping at most one letter of each, so they meet in
    an equi-join on those shortened forms.
    """
    same = list(same)

    def forms(df: DataFrame, name: str) -> DataFrame:
        c = F.col(name)
        cut = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
            lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))),
        )
        return df.select(*same, name).distinct().withColumn(
            "__form", F.explode(F.array_distinct(F.array_append(cut, c)))
        )

    pairs = forms(left, a).join(forms(right, b), [*same, "__form"])
    return (
        pairs.withColumn("distance", F.levenshtein(a, b)).filter("distance <= 1")
        .select(*same, a, b, "distance").distinct()
    )


def edit_join(
    left: DataFrame, right: DataFrame, a: str, b: str, bound: int, insert: int = 1, delete: int = 1, substitute: int = 1, same: Sequence[str] = (),
) -> DataFrame:
    """Pairs of distinct texts whose edits from ``a`` to ``b`` cost at most ``bound``, within equal ``same`` columns.

    So many edits are at most ``bound`` over the least cost. A text of ``b`` is cut into one piece more than that, so one
    piece is left unchanged in ``a``, and it cannot have moved further than the edits before and after it allow. Pairs
    meet on piece, number of the piece and length, and are verified once, in a band of the cost table. Texts of ``b`` too
    short to be cut meet all texts of ``a`` of nearly their length.
    """
    same, edits = list(same), bound // min(insert, delete, substitute)
    pieces = edits + 1
    one = lambda df, c: df.select(*same, c).distinct().filter(F.col(c).isNotNull())
    size = lambda n, i: F.floor((n + i) / pieces).cast("int")  # noqa: E731  pieces of nearly one length, the longer ones last
    start = lambda n, i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda s, k: s + F.when(k < i, size(n, k)).otherwise(0))
    numbers = F.sequence(F.lit(0), F.lit(edits))

    held, n = one(right, b), F.length(b)
    cut = F.transform(numbers, lambda i: F.struct(i.alias("i"), F.substring(F.col(b), start(n, i) + 1, size(n, i)).alias("piece")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("piece")))
    held = held.select(*same, b, n.alias("n"), F.explode(F.when(n >= pieces, cut).otherwise(whole)).alias("p")).select(*same, b, "n", "p.i", "p.piece")

    probe, m = one(left, a), F.length(a)
    probe = probe.withColumn("n", F.explode(F.sequence(F.greatest(m - edits, F.lit(0)), m + edits)))

    def places(i: Column) -> Column:
        """Where piece ``i`` of a text of length ``n`` may stand here, and what stands there."""
        at, moved = start(F.col("n"), i), m - F.col("n")
        low = F.greatest(at - i, at + moved - (edits - i), F.lit(0))
        high = F.least(at + i, at + moved + (edits - i), m - size(F.col("n"), i))
        span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(span, lambda x: F.struct(i.alias("i"), F.substring(F.col(a), x + 1, size(F.col("n"), i)).alias("piece"))))

    probe = probe.select(*same, a, "n", F.explode(F.when(F.col("n") >= pieces, F.flatten(F.transform(numbers, places))).otherwise(whole)).alias("p")).select(*same, a, "n", "p.i", "p.piece")
    pairs = probe.join(held, [*same, "n", "i", "piece"]).select(*same, a, b).distinct()
    return pairs.withColumn("distance", strings.edit_cost(F.col(a), F.col(b), insert, delete, substitute, bound)).filter("distance >= 0")


def json_contains_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct JSON texts of which ``a`` contains ``b``.

    A document contains another one only if it has each of its values under the same keys. Pairs meet on the value of
    ``b`` that the fewest texts of ``a`` have, and are verified; texts of ``b`` without any value (empty objects and
    arrays) meet the texts of ``a`` of their kind.
    """
    one = lambda df, c: df.select(c).distinct().filter(F.col(c).isNotNull())
    kind = lambda c: F.array(F.concat(F.lit("kind "), F.substring(F.ltrim(c), 1, 1)))
    have = one(left, a).select(a, F.explode(F.concat(jsonx.leaves(F.col(a)), kind(a))).alias("leaf"))
    rarity = have.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    found = jsonx.leaves(F.col(b))
    ask = one(right, b).select(b, F.explode(F.when(F.size(found) > 0, found).otherwise(kind(b))).alias("leaf"))
    # a value that no text of a has leaves its text without a partner
    best = ask.join(rarity, "leaf", "left").groupBy(b).agg(F.min_by("leaf", F.coalesce("n", F.lit(0))).alias("leaf"))
    return best.join(have, "leaf").select(a, b).filter(jsonx.contains_json(F.col(a), F.col(b)))
