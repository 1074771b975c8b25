"""Pairs of sets by products of blocks, against brute force."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tablewright.operators import joins, overlaps


def trigrams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)}


def brute(left, right, threshold):
    left, right = ({t: trigrams(t) for t in ts if t is not None} for ts in (left, right))
    shared = {(x, y): (len(left[x] & right[y]), len(left[x] | right[y])) for x, y in product(left, right)}
    return sorted((x, y, n / m) for (x, y), (n, m) in shared.items() if n and n / m >= threshold)


def joined(spark, left, right, threshold, **options):
    left, right = spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string")
    return joins.trigram_join(left, right, "a", "b", threshold, **options)


@pytest.fixture(scope="module")
def texts():
    """Of few syllables, so that no trigram is rare, and of lengths from one word to more than 255 trigrams."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["an", "ther", "ou", "ñé", "st", "le", "7"]) for _ in range(draw.randint(1, 4)))
    out = [" ".join(word() for _ in range(draw.choice([1, 2, 3, 5, 8, 8, 8, 8]))) for _ in range(260)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = ["".join(draw.choice(letters) for _ in range(400)) for _ in range(3)]
    return [*out, *out[:9], *long, *[t[:330] + " end" for t in long], "", " - ", None]


def test_no_index_of_trigrams_is_joined(spark, texts):
    # an index of trigrams meets most pairs many times when none of the trigrams is rare
    plan = joined(spark, texts, texts, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "posexplode" not in plan and plan.count("Join ") == 1


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.75, 1.0])
def test_pairs_against_brute_force(spark, texts, threshold, monkeypatch):
    if threshold != 0.75:
        for name, value in {"LEAST_ROWS": 40, "TILE_X": 16, "TILE_Y": 24, "CHECKED": 500}.items():
            monkeypatch.setattr(overlaps, name, value)
    left, right = texts[:170] + texts[-9:], texts[90:]
    assert sorted(map(tuple, joined(spark, left, right, threshold).collect())) == brute(left, right, threshold)


def test_ascending_pairs_of_one_side(spark, texts, monkeypatch):
    monkeypatch.setattr(overlaps, "BLOCK_BYTES", 200_000)  # blocks of a size, however few tasks there are
    got = joined(spark, texts, texts, 0.4, ascending=True)
    want = [w for w in brute(texts, texts, 0.4) if w[0] < w[1]]
    assert want and sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, joined(spark, texts, texts, 0.4).filter("a < b").collect())) == want


def test_sets_larger_than_a_byte(spark):
    # a shared trigram beyond 255 is counted, and short texts in the same tile are not lost
    draw = random.Random(9)
    base = [draw.choice("abcdefghijklmnopqrstuvwxyz") + draw.choice("bcdfgh") + str(i) for i in range(700)]
    many = [" ".join(base), " ".join(base[:600]), " ".join(base[100:]), " ".join(base[:4]), " ".join(base[:5]), "none"]
    assert len(trigrams(many[0])) > 512
    assert sorted(map(tuple, joined(spark, many, many, 0.5).collect())) == brute(many, many, 0.5)


def test_nothing_to_join(spark):
    assert joined(spark, [None, "", "..."], ["a b", None], 0.3).count() == 0
    assert joined(spark, [None], [""], 0.3).count() == 0


def test_more_numbers_than_columns(spark):
    # few numbers have a column of their own; others fall together, which must not add to what is in common
    rows = [(f"t{i}", True, True, list(range(i * 50, i * 50 + 400))) for i in range(60)]
    sets = spark.createDataFrame(rows, "txt string, l boolean, r boolean, gs array<long>")
    got = overlaps.similar_pairs(sets, "a", "b", 0.5, ascending=True)
    want = {(f"t{i}", f"t{j}", (400 - 50 * abs(i - j)) / (400 + 50 * abs(i - j))) for i in range(60) for j in range(60) if i != j and abs(i - j) < 3}
    assert {tuple(r) for r in got.collect()} == {w for w in want if w[0] < w[1] and w[2] >= 0.5}
    assert got.filter(F.col("similarity") < 0.5).count() == 0
