"""Spelling variants grouped through permuterm rotations.

Each word ends in a terminator and stands in the index with all its rotations. Two words that differ in one code point
share a rotation up to that point: with ``x`` before and ``y`` after it, both have a rotation that starts with ``y$x``
and goes on with one code point more, and the word without it, ``xy``, has the rotation ``y$x`` itself. So the rotations
are sorted by what comes before the code point skipped, and one scan of each range finds the neighbours: a range holds at
most one word of each code point and the word without it. Nothing is emitted for pairs: a word needs its range's size
and its two best words only.

Of a run of equal code points any may be the one left out, with one and the same word left; the pair is counted at the
last of the run. A replacement has one place, so every pair is counted once.

A word's form is the near word of largest count, if that is at least twice its own; so forms lead uphill, at most 63 of
them, and roots are found by pointer doubling in at most six rounds.

All in DataFrame functions. Words are counted before anything is sorted, so a word that makes up a third of all text is
one row. Ranges are bounded by the alphabet: 26 letters and the 64 code points from U+00C0 to U+00FF.

Defined results: a null text has no runs; a null doc_id stands as an empty string in the hash, which only decides
which runs lose a code point; repeated rows count again; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a code point.
DAMAGED = 97
#: No run holds it.
TERMINATOR = "$"


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(1))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, or in one of 97 cases, by the hash of document and run, without one of its code points."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    place = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word n``, for words of at least 5 code points that occur at least 3 times."""
    runs = docs.select(docs["doc_id"].alias("id"), F.explode(runs_of(docs["text"])).alias("run"))
    # a run that loses no more than one code point and is shorter can't be a word
    words = runs.where(F.length("run") >= LEAST_LENGTH).select(damaged(F.col("id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """Per word and place: the rotation that begins after the place, up to the code point skipped. ``whole`` rows are
    rotations in which nothing is skipped. ``last`` tells that the code point skipped is not followed by its like."""
    n = F.length("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    before = F.col("word").substr(F.lit(1), F.col("i"))
    whole = F.concat(F.col("word").substr(F.col("i") + 1, n), F.lit(TERMINATOR), before)
    skipped = F.concat(F.col("word").substr(F.col("i") + 2, n), F.lit(TERMINATOR), before)
    here, after = F.col("word").substr(F.col("i") + 1, F.lit(1)), F.col("word").substr(F.col("i") + 2, F.lit(1))
    kinds = F.array(
        F.struct(whole.alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("last")),
        F.struct(skipped.alias("key"), F.lit(False).alias("whole"), (here != after).alias("last")),
    )
    return (
        places.select("word", "n", F.explode(F.when(F.col("i") < n, kinds).otherwise(F.slice(kinds, 1, 1))).alias("r"))
        .select("word", "n", "r.key", "r.whole", "r.last")
    )


def neighbours(words: DataFrame) -> DataFrame:
    """``word n n_near best``: how many near words each word has, and the count and name of the best of them."""
    in_range = Window.partitionBy("key")
    ranked = in_range.orderBy(F.desc("n"), "word")
    whole_range = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shorter = F.max(F.when(F.col("whole"), F.struct(F.col("n"), F.col("word")))).over(whole_range)
    others = F.when(~F.col("whole"), F.struct("n", "word"))
    first = F.first(others, ignorenulls=True).over(whole_range)
    second = F.nth_value(others, 2, ignoreNulls=True).over(whole_range)
    scanned = rotations(words).select(
        "word", "n", "whole", "last", shorter.alias("shorter"), first.alias("first"), second.alias("second"),
        F.count(F.when(~F.col("whole"), 1)).over(whole_range).alias("n_other"), F.count(F.when(F.col("last"), 1)).over(whole_range).alias("n_last"),
    )
    same = F.col("first.word") == F.col("word")
    better = lambda a, b: F.when(b.isNull() | (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["word"] < b["word"])), a).otherwise(b)
    replaced = F.when(same, F.col("second")).otherwise(F.col("first"))
    best = F.when(F.col("whole"), F.col("first")).when(F.col("shorter").isNull(), replaced).otherwise(F.when(replaced.isNull(), F.col("shorter")).otherwise(better(replaced, F.col("shorter"))))
    near = F.when(F.col("whole"), F.col("n_last")).otherwise(F.col("n_other") - 1 + F.when(F.col("last") & F.col("shorter").isNotNull(), 1).otherwise(0))
    found = scanned.select("word", "n", near.alias("near"), best.alias("best"))
    # largest n, then smallest word
    return found.groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.max("best.n").alias("best_n"), F.min(F.when(F.col("best").isNotNull(), F.struct(-F.col("best.n"), F.col("best.word").alias("word")))).alias("best")).select(
        "word", "n", "n_near", "best_n", F.col("best.word").alias("best")
    )


def roots(links: DataFrame) -> DataFrame:
    """``word root`` for the words of ``links`` (``word form``): the end of each chain."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """``word form root n n_near form_n`` for a table ``word n`` of distinct words."""
    words = stored(words, "words")
    known = stored(neighbours(words), "neighbours")
    has = F.col("best_n") >= 2 * F.col("n")
    named = known.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    ends = roots(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs))
