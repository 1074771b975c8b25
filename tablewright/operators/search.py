"""Jobs over the words of a corpus: postings, statistics, dictionaries, cover ranking."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import textsearch as ts
from tablewright.operators.joins import broadcast_if_small


def occurrences(df: DataFrame, key: str, vector: Column) -> DataFrame:
    """One row per word occurrence."""
    return df.select(key, F.explode(vector).alias("o")).select(key, "o.term", "o.pos", "o.w")


def postings(df: DataFrame, key: str, vector: Column) -> DataFrame:
    """One row per word and document, with the number of occurrences."""
    return occurrences(df, key, vector).groupBy("term", key).agg(F.count(F.lit(1)).alias("n"))


def term_statistics(df: DataFrame, key: str, vector: Column) -> DataFrame:
    """Documents and occurrences per word."""
    return postings(df, key, vector).groupBy("term").agg(F.count(F.lit(1)).alias("ndoc"), F.sum("n").alias("nentry"))


def match_postings(index: DataFrame, key: str, all_of: Sequence[str], none_of: Sequence[str] = ()) -> DataFrame:
    """Documents with all of some words and none of others, from a postings table.

    One pass over the few postings asked for; the word filter reaches the scan.
    """
    wanted = index.filter(F.col("term").isin(*all_of, *none_of))
    hits = wanted.groupBy(key).agg(
        F.count_if(F.col("term").isin(*all_of)).alias("__yes"), F.count_if(F.col("term").isin(*none_of) if none_of else F.lit(False)).alias("__no")
    )
    return hits.filter((F.col("__yes") == len(set(all_of))) & (F.col("__no") == 0)).select(key)


def cover_rank(df: DataFrame, key: str, vector: Column, query: ts.Query, weights=ts.WEIGHTS, norm: int = 0) -> DataFrame:
    """``key rank covers`` of the documents with a cover, for any query; nothing is shuffled."""
    found = df.select(key, ts.cover_rank(vector, query, weights, norm).alias("c"))
    return found.filter("c.covers > 0").select(key, "c.rank", "c.covers")


def apply_dictionary(tokens: DataFrame, column: str, dictionary: DataFrame, word: str, to: str) -> DataFrame:
    """Replace words by dictionary entries (several entries give several rows); others stay."""
    small = broadcast_if_small(dictionary.select(F.col(word).alias("__w"), F.col(to).alias("__to")))
    out = tokens.join(small, F.col(column) == F.col("__w"), "left")
    return out.withColumn(column, F.coalesce("__to", column)).drop("__w", "__to")


def integer_dictionary(token: Column, max_length: int = 6, reject_long: bool = False) -> Column:
    """Numbers cut to ``max_length`` digits, or dropped when longer."""
    number = token.rlike(r"^[+-]?[0-9]+$")
    cut = F.lit(None).cast("string") if reject_long else F.substring(token, 1, max_length)
    return F.when(number & (F.length(token) > max_length), cut).otherwise(token)


def thesaurus(tokens: Column, phrases: dict[str, str], stop: Sequence[str] = ()) -> Column:
    """Replace phrases in an array of words: the longest that begins at a word, then on behind it. What was put in is not
    looked at again. ``?`` in a phrase stands for any one of the stop words. The phrases form one tree of words, so a
    document costs its words, times the longest phrase at most.
    """
    tree: dict = {}
    for phrase, to in phrases.items():
        node = tree
        for w in phrase.split():
            node = node.setdefault(w, {})
        node[None] = to.split()
    stops = frozenset(stop)

    @F.arrow_udf("array<string>")
    def replaced(rows: pa.Array) -> pa.Array:
        # one row at a time becomes Python objects
        made = (pa.array([None if ws is None else _replaced(ws, tree, stops)], pa.list_(pa.string())) for ws in (r.as_py() for r in rows))
        return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *made])

    return replaced(tokens)


def _replaced(words: list[str], tree: dict, stops: frozenset[str]) -> list[str]:
    out, at = [], 0
    while at < len(words):
        # all ways through the tree at once: a word may be both itself and a stop word
        nodes, end, best, to = [tree], at, 0, None
        while nodes and end < len(words):
            w = words[end]
            nodes = [n for node in nodes for n in (node.get(w), node.get("?") if w in stops else None) if n is not None]
            end += 1
            for n in nodes:
                if None in n:
                    best, to = end, n[None]
                    break
        if to is None:
            out.append(words[at])
            at += 1
        else:
            out += to
            at = best
    return out


def extended_synonyms(
    tokens: DataFrame, column: str, rules: DataFrame, word: str, synonyms: str,
    keep_word: bool = True, match_word: bool = True, keep_synonyms: bool = True, match_synonyms: bool = False,
) -> DataFrame:
    """Replace a word by the words of its rule, one row each. A rule is a word and an array of synonyms; the options tell
    which of them match and which are given back. Words of no rule stay; a word of several rules gets all of them, once
    each; a word whose rule gives nothing back goes.
    """
    pick = lambda head, rest: F.concat(*[F.array(F.lower(word)) if head else F.array().cast("array<string>"), F.transform(synonyms, F.lower) if rest else F.array().cast("array<string>")])
    matching = rules.select(F.explode(F.array_distinct(pick(match_word, match_synonyms))).alias("__w"), pick(keep_word, keep_synonyms).alias("__to"))
    to = matching.groupBy("__w").agg(F.array_distinct(F.flatten(F.collect_list("__to"))).alias("__to"))
    found = tokens.join(broadcast_if_small(to), F.lower(column) == F.col("__w"), "left")
    return found.withColumn(column, F.explode(F.when(F.col("__w").isNull(), F.array(column)).otherwise(F.col("__to")))).drop("__w", "__to")


def affix_stems(tokens: DataFrame, column: str, rules: Sequence[tuple[str, str]], vocabulary: DataFrame, word: str) -> DataFrame:
    """Base forms: strip a suffix, add its replacement, keep what the vocabulary knows.

    Runs on distinct tokens.
    """
    forms = [F.struct(F.col(column).alias("base"))]
    for suffix, replacement in rules:
        base = F.concat(F.substring(F.col(column), F.lit(1), F.length(column) - len(suffix)), F.lit(replacement))
        forms.append(F.when(F.endswith(F.col(column), F.lit(suffix)), F.struct(base.alias("base"))))
    distinct = tokens.select(column).distinct()
    candidates = distinct.select(column, F.explode(F.array_distinct(F.array_compact(F.array(*forms)))).alias("f")).select(column, "f.base")
    known = vocabulary.select(F.col(word).alias("base")).distinct()
    return candidates.join(known, "base", "left_semi").select(column, "base")
