"""Full-text search.

A document vector is ``array<struct<term, pos, w>>``: one entry per word occurrence,
in text order. Stop words take a position but have no entry. Everything here is
evaluated inside the scan; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import stemming
from tablewright.functions.core import bind
from tablewright.functions.expressions import parse as parse_expression
from tablewright.functions.expressions import unquoted
from tablewright.functions.stemmers import STEMMERS

# English stop words.
STOP_ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don should now"
).split()

# Number, name and pattern of each token type, tried in this order.
TOKEN_TYPES = (
    (4, "email", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    (5, "url", r"https?://[^\s<>\"]+"),
    (6, "host", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    (20, "float", r"[0-9]+\.[0-9]+"),
    (16, "asciihword", r"[A-Za-z]+(?:-[A-Za-z]+)+"),
    (1, "asciiword", r"[A-Za-z]+(?![\p{L}\p{N}])"),
    (22, "uint", r"[0-9]+(?![\p{L}\p{N}])"),
    (2, "word", r"\p{L}+(?![\p{L}\p{N}])"),
    (3, "numword", r"[\p{L}\p{N}]+"),
    (12, "blank", r"[^\p{L}\p{N}]"),
)


# The two commonest tokens first: a letter run that nothing longer can begin with, and a sign that begins no token.
QUICK = r"[A-Za-z]++(?![\p{L}\p{N}@.:_+-])|[^\p{L}\p{N}._+-]"


def tokens(c: Column) -> Column:
    """Tokens of a text in order, blanks included."""
    return F.regexp_extract_all(c, F.lit("(" + "|".join([QUICK, *(p for _, _, p in TOKEN_TYPES)]) + ")"), F.lit(1))


def token_type(token: Column) -> Column:
    """Number of the type of one token of :func:`tokens`."""
    kind = F.lit(12)
    for number, _, pattern in reversed(TOKEN_TYPES[:-1]):
        kind = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(number)).otherwise(kind)
    # most tokens are one blank or a run of ASCII letters, and need no other test
    return F.when(token == " ", F.lit(12)).when(token.rlike("^[A-Za-z]+$"), F.lit(1)).otherwise(kind)


def parse(c: Column) -> Column:
    """Tokens of a text as ``array<struct<tokid, token>>``, blanks included."""
    return F.transform(tokens(c), lambda token: F.struct(token_type(token).alias("tokid"), token.alias("token")))


# Types of words of a language, which are stemmed.
LANGUAGE_TYPES = (1, 2, 16)


def type_name(tokid: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, name, _ in TOKEN_TYPES:
        out = F.when(tokid == number, F.lit(name)).otherwise(out)
    return out


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Stop words by configuration; others have none unless they are given.
STOPS = {"english": STOP_ENGLISH}


def stem(word: Column, config: str = "english") -> Column:
    """Stem of one lower-case word in ``english``, ``german``, ``spanish`` or ``french``; the word itself in ``simple``."""
    if config == "simple":
        return word
    strip_suffix = STEMMERS[config]

    @F.pandas_udf(T.StringType())
    def stems(words: pd.Series) -> pd.Series:
        return words.map(strip_suffix, na_action="ignore")

    return stems(word)


def stem_by(word: Column, config: Column) -> Column:
    """Stem of a word by the configuration of its row; an unknown or NULL configuration leaves the word."""

    @F.pandas_udf(T.StringType())
    def stems(words: pd.Series, configs: pd.Series) -> pd.Series:
        return pd.Series([w if w is None or c not in STEMMERS else STEMMERS[c](w) for w, c in zip(words, configs)], dtype=object)

    return stems(word, config)


def _stem_all(tokens: Column, config: str) -> Column:
    strip_suffix = STEMMERS[config]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stems(lists: pa.Array) -> pa.Array:
        return over_distinct(lists, lambda words: [w if w is None else strip_suffix(w) for w in words])

    return stems(tokens)


def over_distinct(lists: pa.Array, rule: Callable[[list], list]) -> pa.Array:
    """Lists of words with every word replaced by what ``rule`` makes of it. Python sees each distinct word of a
    batch once; the occurrences stay in Arrow."""
    coded = lists.flatten().dictionary_encode()
    made = pa.array(rule(coded.dictionary.to_pylist()), pa.string()).take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
    return pa.ListArray.from_arrays(offsets, made, mask=lists.is_null())


@F.pandas_udf(T.StringType())
def stem_english(word: pd.Series) -> pd.Series:
    return word.map(stemming.english, na_action="ignore")


def to_vector(c: Column, config: str = "simple", weight: str = "D", stop: Sequence[str] | None = None) -> Column:
    """Document vector. ``simple`` keeps lower-case words; the languages stem them and drop stop words, those of
    :data:`STOPS` unless ``stop`` names others. Positions count every word."""
    tokens = words(c)
    if config == "simple" and not stop:
        return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos"), F.lit(weight).alias("w")))
    stems = tokens if config == "simple" else _stem_all(tokens, config)
    dropped = list(STOPS.get(config, ()) if stop is None else stop)
    pairs = F.arrays_zip(tokens.alias("t"), stems.alias("s"))
    marked = F.transform(
        pairs, lambda p, i: F.struct(p["s"].alias("term"), (i + 1).alias("pos"), F.lit(weight).alias("w"), p["t"].isin(*dropped).alias("stop"))
    )
    return F.transform(F.filter(marked, lambda o: ~o["stop"]), lambda o: F.struct(o["term"].alias("term"), o["pos"].alias("pos"), o["w"].alias("w")))


def lexize(word: Column, config: str = "simple", stop: Sequence[str] | None = None) -> Column:
    """What a dictionary makes of one token: its lexeme in an array, an empty array for a stop word, NULL for NULL."""
    low = F.lower(word)
    dropped = list(STOPS.get(config, ()) if stop is None else stop)
    return F.when(low.isin(*dropped), F.array().cast("array<string>")).when(word.isNotNull(), F.array(stem(low, config)))


def debug(c: Column, config: str = "simple", stop: Sequence[str] | None = None) -> Column:
    """Every token of a text with its type, the dictionary that takes it and its lexemes, as
    ``array<struct<alias, token, dictionary, lexemes>>``. Blanks go to no dictionary; numbers, addresses and
    the like to the one that keeps words as they are."""
    dropped = list(STOPS.get(config, ()) if stop is None else stop)
    tokens = parse(c)
    stems = F.transform(tokens, lambda t: F.lower(t["token"]))
    both = F.arrays_zip(tokens.alias("t"), (stems if config == "simple" else _stem_all(stems, config)).alias("s"))
    return F.transform(both, lambda x: described(x["t"]["tokid"], x["t"]["token"], x["s"], config, dropped))


def described(tokid: Column, token: Column, stemmed: Column, config: str, stop: Sequence[str]) -> Column:
    """One token of :func:`debug`, given its type and the stem of its lower-case form."""
    spoken, low = tokid.isin(*LANGUAGE_TYPES), F.lower(token)
    dictionary = F.when(tokid == 12, F.lit(None)).when(spoken & F.lit(config != "simple"), F.lit(f"{config}_stem")).otherwise(F.lit("simple"))
    lexemes = (
        F.when(tokid == 12, F.lit(None)).when(~spoken, F.array(low))
        .when(low.isin(*stop), F.array().cast("array<string>")).otherwise(F.array(stemmed))
    )
    return F.struct(type_name(tokid).alias("alias"), token.alias("token"), dictionary.alias("dictionary"), lexemes.alias("lexemes"))


def normalise(word: str, config: str) -> str:
    word = word.lower()
    return word if config == "simple" else STEMMERS[config](word)


# -- vector editing ------------------------------------------------------------


def set_weight(v: Column, weight: str) -> Column:
    return F.transform(v, lambda o: o.withField("w", F.lit(weight)))


def strip(v: Column) -> Column:
    """Sorted distinct terms, without positions."""
    return F.array_sort(F.array_distinct(F.transform(v, lambda o: o["term"])))


def length(v: Column) -> Column:
    return F.size(strip(v))


def delete(v: Column, terms: Sequence[str]) -> Column:
    return F.filter(v, lambda o: ~o["term"].isin(*terms))


def keep_weights(v: Column, weights: Sequence[str]) -> Column:
    return F.filter(v, lambda o: o["w"].isin(*weights))


def from_terms(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("pos"), F.lit("D").alias("w")))


def append(a: Column, b: Column) -> Column:
    """Concatenation; positions of ``b`` follow the last one of ``a``."""
    last = F.coalesce(F.array_max(F.transform(a, lambda o: o["pos"])), F.lit(0))
    return F.concat(a, F.transform(b, lambda o: o.withField("pos", o["pos"] + last)))


# -- queries -------------------------------------------------------------------


class Query:
    """Boolean text query, built with ``&``, ``|``, ``~`` and :meth:`then`."""

    def __and__(self, other: Query) -> Query:
        return And(self, other)

    def __or__(self, other: Query) -> Query:
        return Or(self, other)

    def __invert__(self) -> Query:
        return Not(self)

    def then(self, other: Query, distance: int = 1) -> Query:
        """``other`` follows exactly ``distance`` words later."""
        return Phrase(self, other, distance)

    parts: tuple = ()

    def on(self, v: Column) -> Column:
        """Does the vector match?"""
        return F.size(self.positions(v)) > 0

    def positions(self, v: Column) -> Column:
        """End positions of matches."""
        raise TypeError("only words and phrases have positions")

    def terms(self) -> list[Term]:
        """Distinct words, outside of negations."""
        return list(dict.fromkeys(t for p in self.parts for t in p.terms()))

    def leaves(self) -> list[Term]:
        """Distinct words, those of negations as well."""
        return list(dict.fromkeys(t for p in self.parts for t in p.leaves()))

    def extents(self, at: Mapping[Term, list[int]]) -> list[tuple[int, int]]:
        """Shortest stretches (first and last position) that match, given each word's positions in order. None of them
        holds another one, so they are in order by both ends."""
        raise NotImplementedError

    def nodes(self) -> int:
        """Number of words and operators."""
        return 1 + sum(p.nodes() for p in self.parts)

    def holds(self, other: Query) -> bool:
        """Are all words of ``other`` among the words here?"""
        return set(other.all_words()) <= set(self.all_words())

    def all_words(self) -> list[str]:
        return [w for p in self.parts for w in p.all_words()]

    def rewrite(self, rules: Mapping[Query, Query]) -> Query:
        """Replace every subquery that equals a rule's left side."""
        if self in rules:
            return rules[self]
        return self.rebuild([p.rewrite(rules) for p in self.parts]) if self.parts else self

    def indexable(self) -> Query | None:
        """The query without negations; None when nothing is left."""
        kept = [q for q in (p.indexable() for p in self.parts) if q is not None]
        if not kept:
            return None
        return kept[0] if len(kept) == 1 else self.rebuild(kept)

    def rebuild(self, parts: list[Query]) -> Query:
        return type(self)(*parts)

    def _key(self):
        return (type(self).__name__, *self.parts)

    def __eq__(self, other):
        return isinstance(other, Query) and self._key() == other._key()

    def __hash__(self):
        return hash(self._key())


class Term(Query):
    def __init__(self, word: str, prefix: bool = False, weights: str = ""):
        self.word, self.prefix, self.weights = word, prefix, weights

    def _test(self, o: Column) -> Column:
        hit = F.startswith(o["term"], F.lit(self.word)) if self.prefix else o["term"] == self.word
        return hit & o["w"].isin(*self.weights) if self.weights else hit

    def on(self, v: Column) -> Column:
        return F.exists(v, self._test)

    def positions(self, v: Column) -> Column:
        return F.transform(F.filter(v, self._test), lambda o: o["pos"])

    def terms(self) -> list[Term]:
        return [self]

    def leaves(self) -> list[Term]:
        return [self]

    def extents(self, at):
        return [(p, p) for p in at[self]]

    def nodes(self) -> int:
        return 1

    def all_words(self) -> list[str]:
        return [self.word]

    def indexable(self) -> Query | None:
        return self

    def _key(self):
        return ("Term", self.word, self.prefix, self.weights)

    def __repr__(self):
        tail = (":" if self.prefix or self.weights else "") + ("*" if self.prefix else "") + self.weights
        return f"'{self.word}'{tail}"


class And(Query):
    def __init__(self, *parts: Query):
        self.parts = parts

    @classmethod
    def of(cls, *parts: Query) -> Query:
        """Joined parts, those of the same kind taken apart."""
        return cls(*[q for p in parts for q in (p.parts if isinstance(p, cls) else (p,))])

    def on(self, v: Column) -> Column:
        out = self.parts[0].on(v)
        for p in self.parts[1:]:
            out = out & p.on(v)
        return out

    def extents(self, at):
        """Stretches with a match of every part that is not negated, and with none of those that are."""
        wanted = [p.extents(at) for p in self.parts if not isinstance(p, Not)]
        out = _together(wanted)
        for p in self.parts:
            if isinstance(p, Not):
                out = _without(out, p.parts[0].extents(at))
        return out

    def __repr__(self):
        return " & ".join(f"( {p} )" if isinstance(p, Or) else repr(p) for p in self.parts)


class Or(Query):
    def __init__(self, *parts: Query):
        self.parts = parts

    of = classmethod(And.of.__func__)

    def on(self, v: Column) -> Column:
        out = self.parts[0].on(v)
        for p in self.parts[1:]:
            out = out | p.on(v)
        return out

    def positions(self, v: Column) -> Column:
        out = self.parts[0].positions(v)
        for p in self.parts[1:]:
            out = F.array_union(out, p.positions(v))
        return out

    def extents(self, at):
        """Of any part; a negation alone has no place."""
        return _shortest(e for p in self.parts for e in p.extents(at))

    def __repr__(self):
        return " | ".join(map(repr, self.parts))


class Not(Query):
    def __init__(self, part: Query):
        self.parts = (part,)

    def on(self, v: Column) -> Column:
        return ~self.parts[0].on(v)

    def terms(self) -> list[Term]:
        return []

    def extents(self, at):
        return []

    def indexable(self) -> Query | None:
        return None

    def __repr__(self):
        p = self.parts[0]
        return f"!{p!r}" if isinstance(p, Term) else f"!( {p!r} )"


class Phrase(Query):
    def __init__(self, left: Query, right: Query, distance: int = 1):
        self.parts, self.distance = (left, right), distance

    def positions(self, v: Column) -> Column:
        left, right = (p.positions(v) for p in self.parts)
        return F.array_intersect(F.transform(left, lambda x: x + self.distance), right)

    def extents(self, at):
        left, right = (p.extents(at) for p in self.parts)
        starts = {last: first for first, last in left}
        return _shortest((starts[q - self.distance], q) for _, q in right if q - self.distance in starts)

    def rebuild(self, parts: list[Query]) -> Query:
        return Phrase(*parts, self.distance)

    def _key(self):
        return ("Phrase", self.distance, *self.parts)

    def __repr__(self):
        return (" <-> " if self.distance == 1 else f" <{self.distance}> ").join(map(repr, self.parts))


def _shortest(extents: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without those that hold another one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(set(extents), key=lambda e: (e[1], -e[0])):
        if not out or first > out[-1][0]:
            out.append((first, last))
    return out


def _together(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Shortest stretches that hold one of each part: for every end the latest match of each part up to it."""
    if not parts or not all(parts):
        return []
    ends = sorted((last, i, first) for i, part in enumerate(parts) for first, last in part)
    latest: list[int | None] = [None] * len(parts)
    out = []
    for last, i, first in ends:
        latest[i] = first
        if None not in latest:
            out.append((min(latest), last))
    return _shortest(out)


def _without(extents: list[tuple[int, int]], unwanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that hold none of the unwanted ones."""
    out, k = [], 0
    for first, last in extents:
        while k < len(unwanted) and unwanted[k][0] < first:
            k += 1
        if k == len(unwanted) or unwanted[k][1] > last:
            out.append((first, last))
    return out


def match(v: Column, query: Query) -> Column:
    """``vector @@ query``; the vector is made once, however many words are asked for."""
    return bind(v, query.on)


def match_text(c: Column, query: Query) -> Column:
    """The same on plain text, for words and phrases without weights.

    The words are written out with one blank between them, and each word or phrase
    asked for is a substring search in that.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return bind(spaced, lambda s: _in_text(s, query))


def _in_text(s: Column, query: Query) -> Column:
    if isinstance(query, Not):
        return ~_in_text(s, query.parts[0])
    if isinstance(query, (And, Or)):
        out = _in_text(s, query.parts[0])
        for p in query.parts[1:]:
            out = out & _in_text(s, p) if isinstance(query, And) else out | _in_text(s, p)
        return out
    steps = _chain(query)
    if all(gap == 1 for _, gap in steps):
        return F.contains(s, F.lit("".join(f" {t.word}" for t, _ in steps) + ("" if steps[-1][0].prefix else " ")))
    pattern = ""
    for term, gap in steps:
        skip = r"(?: \S+){%d}" % (gap - 1) if gap > 1 else ""
        pattern += skip + " " + re.escape(term.word)
    return s.rlike(pattern + ("" if steps[-1][0].prefix else " "))


def _chain(query: Query) -> list[tuple[Term, int]]:
    """Words of a phrase with their distance to the word before."""
    if isinstance(query, Term):
        if query.weights:
            raise TypeError("weights need a vector")
        return [(query, 1)]
    left, right = (_chain(p) for p in query.parts)
    if any(t.prefix for t, _ in left) or len(right) > 1:
        raise TypeError("this phrase needs a vector")
    return [*left, (right[0][0], query.distance)]


def plain_query(text: str, config: str = "simple") -> Query:
    """All words of a text, joined by ``&``."""
    found = [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOPS.get(config, ())]
    parts = [Term(normalise(w, config)) for w in found]
    return parts[0] if len(parts) == 1 else And(*parts)


def phrase_query(text: str, config: str = "simple") -> Query:
    """All words of a text in sequence; stop words widen the distance."""
    out, gap = None, 1
    for w in re.findall(r"[^\W_]+", text.lower()):
        if w in STOPS.get(config, ()):
            gap += 1
            continue
        term = Term(normalise(w, config))
        out = term if out is None else Phrase(out, term, gap)
        gap = 1
    return out


def to_query(text: str, config: str = "simple") -> Query | None:
    """``fat & (rat | cat:*) & !dog:AB``, ``'old town' <-> (hall | square) <2> clock`` as a query; None when only stop
    words are left."""

    def leaf(token: str) -> Query | None:
        word, flags = unquoted(token)
        found = [w for w in re.findall(r"[^\W_]+", word.lower()) if w not in STOPS.get(config, ())]
        parts = [Term(normalise(w, config), "*" in flags, "".join(sorted(set(flags.upper()) & set("ABCD")))) for w in found]
        return None if not parts else parts[0] if len(parts) == 1 else And(*parts)

    return parse_expression(text, leaf, And.of, Or.of, Not, in_sequence)


def in_sequence(left: Query, right: Query, distance: int = 1) -> Query:
    """``right`` so many words after ``left``, with the operators of both drawn out of the phrase: words and phrases are
    left in it. What may not follow, or precede, is excluded from what must stand there."""
    for side, other, put in ((left, right, lambda p, o: in_sequence(p, o, distance)), (right, left, lambda p, o: in_sequence(o, p, distance))):
        if isinstance(side, (And, Or)):
            return type(side).of(*[put(p, other) for p in side.parts])
    if isinstance(left, Not) and isinstance(right, Not):
        return And.of(left, right)
    if isinstance(left, Not):
        return And.of(Not(in_sequence(left.parts[0], right, distance)), right)
    if isinstance(right, Not):
        return And.of(left, Not(in_sequence(left, right.parts[0], distance)))
    return Phrase(left, right, distance)


# -- ranking -------------------------------------------------------------------

WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}  # fixed values
BASEL = 1.64493406685  # fixed value: limit of the sum of 1/i^2


def _weight(w: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(weights["D"])
    for label in "CBA":
        out = F.when(w == label, F.lit(weights[label])).otherwise(out)
    return out


def _places(v: Column, term: Term, weights: Mapping[str, float]) -> Column:
    return F.transform(
        F.filter(v, term._test), lambda o: F.struct(o["pos"].alias("pos"), _weight(o["w"], weights).alias("wt"))
    )


def _rank_any(v: Column, terms: Sequence[Term], weights: Mapping[str, float]) -> Column:
    """Per word: its best occurrence in full, the others damped by their place squared."""
    total = F.lit(0.0)
    for term in terms:
        wts = F.transform(_places(v, term, weights), lambda p: p["wt"])
        damped = F.aggregate(F.transform(wts, lambda x, j: x / ((j + 1) * (j + 1))), F.lit(0.0), lambda s, x: s + x)
        best = F.array_max(wts)
        at = F.array_position(wts, best)
        total = total + F.when(F.size(wts) > 0, (best + damped - best / (at * at)) / BASEL).otherwise(F.lit(0.0))
    return total / len(terms)


def word_distance(gap: Column) -> Column:
    # fixed values: the constants of the distance curve
    return F.when(gap > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(gap / 1.5 - 2)))


def _miss_all(others: Column):
    """Fold step: chance that an occurrence is near none of ``others``."""

    def step(acc: Column, x: Column) -> Column:
        def one(s: Column, y: Column) -> Column:
            near = F.sqrt(x["wt"] * y["wt"] * word_distance(F.abs(x["pos"] - y["pos"])))
            return s * (1.0 - F.when(x["pos"] == y["pos"], F.lit(0.0)).otherwise(near))

        return F.aggregate(others, acc, one)

    return step


def _rank_all(v: Column, terms: Sequence[Term], weights: Mapping[str, float]) -> Column:
    """Nearness of every pair of occurrences of different words, combined as chances."""
    places = [_places(v, t, weights) for t in terms]
    miss = F.lit(1.0)
    for i, a in enumerate(places):
        for b in places[:i]:
            miss = F.aggregate(a, miss, _miss_all(b))
    return F.when(miss == 1.0, F.lit(1e-20)).otherwise(1.0 - miss)


def rank(v: Column, query: Query, weights: Mapping[str, float] = WEIGHTS, norm: int = 0) -> Column:
    """Rank of a vector. ``norm`` is a sum of 1 (log length), 2 (length), 8 (unique
    words), 16 (log unique words) and 32 (rank / (rank + 1))."""
    terms = query.terms()
    score = _rank_all if isinstance(query, (And, Phrase)) and len(terms) > 1 else _rank_any

    def asked(o: Column) -> Column:
        out = terms[0]._test(o)
        for t in terms[1:]:
            out = out | t._test(o)
        return out

    # one pass keeps the occurrences that matter; the rest of the work is on those
    return normalise_rank(bind(F.filter(v, asked), lambda few: score(few, terms, weights)), v, norm)


def cover_rank(v: Column, query: Query, weights: Mapping[str, float] = WEIGHTS, norm: int = 0) -> Column:
    """Struct of ``rank`` and ``covers``: every shortest stretch that matches adds its words' weight, divided by one
    plus the number of other words inside. Any query will do; a negation excludes the stretches that hold its match.

    ``norm`` as for :func:`rank`, and 4 for the mean harmonic distance between covers. Only the occurrences of the
    query's words leave the JVM.
    """
    leaves = query.leaves()

    def seen(o: Column) -> Column:
        bits = F.lit(0).cast("long")
        for i, t in enumerate(leaves):
            bits = bits + F.when(t._test(o), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(o["pos"].cast("int").alias("pos"), bits.alias("bits"), (1.0 / _weight(o["w"], weights)).alias("inv"))

    kind = pa.struct([("rank", pa.float64()), ("covers", pa.int64())])

    @F.arrow_udf("struct<rank:double,covers:long>")
    def covered(occurrences: pa.Array) -> pa.Array:
        # one row at a time becomes Python objects
        ranks = [_covers(o.as_py(), query, leaves, bool(norm & 4)) for o in occurrences]
        return pa.array([{"rank": r, "covers": k} for r, k in ranks], kind)

    few = F.filter(F.transform(v, seen), lambda o: o["bits"] > 0)
    return bind(F.struct(covered(few).alias("c"), v.alias("v")), lambda s: F.struct(
        normalise_rank(s["c"]["rank"], s["v"], norm, natural=True).alias("rank"), s["c"]["covers"].alias("covers")))


def _covers(occurrences, query: Query, leaves: Sequence[Term], spread: bool) -> tuple[float, int]:
    rows = sorted((o["pos"], o["inv"], o["bits"]) for o in occurrences) if occurrences is not None else []
    at = {t: [p for p, _, bits in rows if bits >> i & 1] for i, t in enumerate(leaves)}
    places, sums = [p for p, _, _ in rows], [0.0]
    for _, inv, _ in rows:
        sums.append(sums[-1] + inv)
    total = near = 0.0
    before = None
    extents = query.extents(at)
    for first, last in extents:
        a, b = bisect.bisect_left(places, first), bisect.bisect_right(places, last)
        others = (last - first) - (b - a - 1)
        total += (b - a) / (sums[b] - sums[a]) / (1 + (others if others >= 0 else (b - a - 1) // 2))
        middle = (first + last) / 2
        if before is not None and middle > before:
            near += 1 / (middle - before)
        before = middle
    if spread and near > 0:
        total /= len(extents) / near
    return total, len(extents)


def normalise_rank(r: Column, v: Column, norm: int, natural: bool = False) -> Column:
    """Rank adjusted for the size of the document; with ``natural`` logarithms for its length."""
    import math

    log_base = math.e if natural else 2.0
    size, uniq = F.size(v), length(v)
    if norm & 1:
        r = r / (F.log(size + 1.0) / math.log(log_base))
    if norm & 2:
        r = r / F.greatest(size, F.lit(1))
    if norm & 8:
        r = r / F.greatest(uniq, F.lit(1))
    if norm & 16:
        r = r / (F.log(uniq + 1.0) / math.log(2.0))
    if norm & 32:
        r = r / (r + 1)
    return F.when(size == 0, F.lit(0.0)).otherwise(r)


def headline(c: Column, terms: Iterable[str], start: str = "<b>", stop: str = "</b>", max_words: int | None = None, config: str = "simple") -> Column:
    """Text with the words marked; with ``max_words`` only the stretch from the first hit on."""
    wanted = [normalise(t, config) for t in terms]
    pieces = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    keys = F.transform(pieces, F.lower)
    if config != "simple":
        keys = _stem_all(keys, config)
    both = F.arrays_zip(pieces.alias("p"), keys.alias("k"))
    marked = F.transform(both, lambda x: F.when(x["k"].isin(*wanted), F.concat(F.lit(start), x["p"], F.lit(stop))).otherwise(x["p"]))
    if max_words is not None:
        hits = F.transform(keys, lambda k: k.isin(*wanted))
        first = F.greatest(F.array_position(hits, True), F.lit(1))
        marked = F.slice(marked, first.cast("int"), F.lit(2 * max_words - 1))
    return F.array_join(marked, "")
