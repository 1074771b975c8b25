"""Quality rules by distribution divergence. DataFrame functions only.

A document's histogram of character classes and of common words is compared with the reference of its language by
Jensen-Shannon distance. References are totals over all documents of a language, so they follow the corpus; only the
list of words to count is fixed. Histograms of short documents are unstable, with noise as one over the root of the
number of words, so the distance allowed falls with the length in that way until it meets its fixed bound.

Defined results: a null text has no words and fails; a document with a null or unlisted language is compared with the
totals of all documents, by characters only; a text below 20 words fails before the divergence tests; an empty table
gives an empty table; repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD, stored, words_of

# Frequent function words by language.
COMMON = {
    "en": "the of and to in a is that for it with as was be by on this are".split(),
    "fr": "le la les de des du et en un une que qui dans pour est par".split(),
    "de": "der die das und den von zu ist mit dem ein eine nicht auf im".split(),
    "es": "el la los las de y que en un una con por para del se es".split(),
}
SYMBOLS = "[#*$%&|<>]"
PUNCTUATION = "[.,;:!?'\"()-]"
DIGITS = "[0-9]"

#: Jensen-Shannon distance (base 2, 0 to 1) above which a document goes, unless it is short.
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.22, 0.26
#: Distances allowed to n words: what clean texts of any length have, and the noise of one word, divided by sqrt(n).
#: They meet the bounds above at 140 and 120 words. On sf0.1 no text labelled good lies above them.
CHARS_BASE, CHARS_NOISE = 0.11, 1.3
WORDS_BASE, WORDS_NOISE = 0.0, 2.85

SPAN = 8
CLASSES = 6


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that a text holds twice or more.

    Window hashes come from three doublings. Only a text with an equal pair sorts its windows.
    """

    def paired(a: Column, step: int) -> Column:
        return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + step)))

    def bound(a: Column, f) -> Column:
        # a lambda variable holds the array, so it is computed once
        return F.get(F.transform(F.array(a), f), F.lit(0))

    def same(s: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i).getField("h") == x.getField("h"), F.lit(False))

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: same(s, x, i + 1) | ((i > 0) & same(s, x, i - 1))), lambda x: x.getField("i")
        ))
        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN)), F.lit(SPAN)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
        )
        return bound(bound(ordered, starts), covered)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda one: bound(
        paired(one, 1), lambda two: bound(paired(two, 2), lambda four: F.when(
            F.size(F.array_distinct(four)) == F.size(four), F.lit(0).cast("long")  # no four words repeat
        ).otherwise(bound(paired(four, 4), count)))
    ))


def _plain(docs: DataFrame) -> DataFrame:
    """Adds ``__text __words __odd n_words word_chars n_symbols``; ``__odd`` is the text without small letters and
    spaces, a small part of it, in which the rarer classes are counted."""
    return (
        docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
        .withColumn("__words", words_of(F.col("__text")))
        .withColumn("__odd", F.regexp_replace("__text", r"[\p{Ll} ]++", ""))
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", _count(F.col("__odd"), SYMBOLS))
    )


def base_columns(docs: DataFrame) -> DataFrame:
    """The plain counts of each text."""
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return (
        _plain(docs).withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeated_words(F.col("__words")))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def _histograms(df: DataFrame) -> DataFrame:
    """Adds ``__chars`` and ``__common``: counts by character class, and of the words listed for the language."""
    table = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON.values() for w in v})
    odd = F.col("__odd")
    return (
        df.withColumn("__upper", _count(odd, r"\p{Lu}")).withColumn("__punct", _count(odd, PUNCTUATION)).withColumn("__digit", _count(odd, DIGITS))
        .withColumn("__other", F.col("word_chars") - F.col("__upper") - F.col("n_symbols") - F.col("__punct") - F.col("__digit"))
        .withColumn("__chars", F.array("__other", "__upper", F.length("__text") - F.col("word_chars"), "n_symbols", "__punct", "__digit"))
        .withColumn("__hits", F.filter("__words", lambda w: w.isin(*every)))
        .withColumn("__common", F.transform(table[F.col("lang")], lambda c: (F.size("__hits") - F.size(F.array_remove("__hits", c))).cast("long")))
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, base 2; null if either is empty."""

    def share(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return F.transform(a, lambda x: x / F.when(total > 0, total))

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    both = F.zip_with(share(p), share(q), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def references(histograms: DataFrame) -> dict[str | None, tuple[list[int], list[int]]]:
    """Totals of both histograms by listed language, and over everything under None: at most one row per word list."""
    h = histograms.withColumn("__known", F.when(F.col("lang").isin(*COMMON), F.col("lang")))
    width = max(map(len, COMMON.values()))
    sums = [F.sum(F.get("__chars", F.lit(i))).alias(f"c{i}") for i in range(CLASSES)]
    sums += [F.sum(F.get("__common", F.lit(i))).alias(f"w{i}") for i in range(width)] + [F.sum("n_words").alias("n")]
    rows = h.groupBy("__known").agg(*sums).collect()
    out = {None: ([sum(r[f"c{i}"] or 0 for r in rows) for i in range(CLASSES)], [])}
    for r in rows:
        if r["__known"]:
            common = [r[f"w{i}"] or 0 for i in range(len(COMMON[r["__known"]]))]
            out[r["__known"]] = ([r[f"c{i}"] or 0 for i in range(CLASSES)], [*common, r["n"] - sum(common)])
    return out


def allowed(n_words: Column, least: float, base: float, noise: float) -> Column:
    """Distance allowed to a text: ``base + noise / sqrt(n_words)``, and never below ``least``."""
    return F.greatest(F.lit(least), base + noise / F.sqrt(F.greatest(n_words, F.lit(1))))


def judged(counted: DataFrame, refs: dict) -> DataFrame:
    """Adds ``chars_distance words_distance kept`` to rows with base counts and histograms."""

    def numbers(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    def by_language(part: int, otherwise: Column) -> Column:
        known = [x for k, v in refs.items() if k for x in (F.lit(k), numbers(v[part]))]
        return F.coalesce(F.create_map(*known)[F.col("lang")], otherwise) if known else otherwise

    rest = F.col("n_words") - F.aggregate("__common", F.lit(0).cast("long"), lambda s, x: s + x)
    out = (
        counted.withColumn("__ref_chars", by_language(0, numbers(refs[None][0])))
        .withColumn("__ref_words", by_language(1, F.lit(None).cast("array<bigint>")))
        .withColumn("__own", F.concat("__common", F.array(rest)))
        .withColumn("chars_distance", js_distance(F.col("__chars"), F.col("__ref_chars")))
        .withColumn("words_distance", js_distance(F.col("__own"), F.col("__ref_words")))
    )
    n = F.col("n_words")
    far = F.coalesce("chars_distance", F.lit(0.0)) > allowed(n, MAX_CHARS_DISTANCE, CHARS_BASE, CHARS_NOISE)
    far = far | (F.coalesce("words_distance", F.lit(0.0)) > allowed(n, MAX_WORDS_DISTANCE, WORDS_BASE, WORDS_NOISE))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed chars_distance
    words_distance kept``; columns of those names are replaced. Texts are read twice, as they are not stored."""
    own = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed chars_distance words_distance kept".split()
    refs = references(_histograms(_plain(docs.select("text", "lang"))))
    # whatever the columns are called, they travel as one
    out = judged(_histograms(base_columns(docs.select("text", "lang", F.struct(*[docs[c] for c in docs.columns]).alias("row")))), refs)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with.

    A plain filter would be pushed below the columns it is made of and compute each of them anew at every place it is
    used; unnesting no or one row keeps them computed once.
    """
    refs = references(_histograms(_plain(docs.select("text", "lang"))))
    out = judged(_histograms(base_columns(docs.select("text", "lang", F.struct(*[docs[c] for c in docs.columns]).alias("row")))), refs)
    one = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return out.select("row", F.explode(one)).select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    """The counts are stored without the texts, so these are read once."""
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    counted = stored(_histograms(base_columns(docs.select("doc_id", "text", "lang"))).select(*names, "lang", "__chars", "__common"), "quality")
    return judged(counted, references(counted)).select(*names, "kept", "chars_distance", "words_distance")
