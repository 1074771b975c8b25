"""Headlines: the stretch of a text that shows a text query best, or several fragments of it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, fields

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import textsearch as ts
from tablewright.functions.stemmers import STEMMERS

# Markup counts as a blank, anything else that is no word stays as it is.
TAG = r"</?[A-Za-z][^<>]*>"
WORD = regex.compile(rf"(?P<tag>{TAG})|[\p{{L}}\p{{N}}]+")
WORD_ASCII = re.compile(rf"(?P<tag>{TAG})|[A-Za-z0-9]+")
NUMBER = regex.compile(r"\p{N}+")


@dataclass(frozen=True)
class Options:
    """``short_word``: words of that length or less, and numbers, do not end a headline unless they
    are query words. ``max_fragments`` 0 gives one stretch; more gives fragments of at most ``max_words``."""

    # The defaults.
    max_words: int = 35
    min_words: int = 15
    short_word: int = 3
    max_fragments: int = 0
    highlight_all: bool = False
    start_sel: str = "<b>"
    stop_sel: str = "</b>"
    fragment_delimiter: str = " ... "

    def __post_init__(self):
        if not self.highlight_all and self.min_words >= self.max_words:
            raise ValueError("min_words must be less than max_words")
        if self.min_words <= 0:
            raise ValueError("min_words must be positive")
        if self.short_word < 0 or self.max_fragments < 0:
            raise ValueError("short_word and max_fragments must not be negative")

    @classmethod
    def of(cls, text: str) -> Options:
        """From a text such as ``MaxFragments=2, FragmentDelimiter="***"``."""
        kinds = {f.name.replace("_", ""): f for f in fields(cls)}
        given = {}
        for name, quoted, bare in re.findall(r'(\w+)\s*=\s*(?:"([^"]*)"|([^,]*))', text):
            field = kinds.get(name.lower())
            if field is None:
                raise ValueError(f"unrecognized headline parameter: {name}")
            value = quoted or bare.strip()
            kind = type(field.default)
            given[field.name] = value.lower() in ("1", "on", "true", "t", "y", "yes") if kind is bool else kind(value)
        return cls(**given)


def headline(c: Column, query: ts.Query | None, options: Options | str = Options(), config: str = "simple") -> Column:
    """The part of a text that shows a query best, its words marked.

    Of the shortest stretches that match, each lengthened to ``min_words``, the one that ends well and
    holds most query words is taken, the first of equal ones. With ``max_fragments`` a match longer
    than a fragment is cut at query words, and fragments with most query words come first. A text
    without a match gives its first ``min_words`` words; NULL gives NULL, an empty text an empty one.
    Words of negations are not marked.
    """
    chosen = Options.of(options) if isinstance(options, str) else options

    @F.pandas_udf(T.StringType())
    def shown(texts: pd.Series) -> pd.Series:
        stems: dict[str, str | None] = {}
        return texts.map(lambda text: _Text(text, query, chosen, config, stems).headline(), na_action="ignore")

    return shown(c)


class _Text:
    """Words of one text, the places of query words among them, and what makes a headline of it."""

    def __init__(self, text: str, query: ts.Query | None, options: Options, config: str, stems: dict):
        self.text, self.options = text, options
        self.tags, self.spans = [], []
        for m in (WORD_ASCII if text.isascii() else WORD).finditer(text):
            (self.tags if m.lastgroup else self.spans).append(m.span())
        leaves = query.leaves() if query else []
        # words that are not asked for are not kept
        asked = None if any(leaf.prefix for leaf in leaves) else {leaf.word for leaf in leaves}
        places: dict[str, list[int]] = {}
        for i, (a, b) in enumerate(self.spans):
            k = _key(text[a:b], config, stems)
            if k is not None and (asked is None or k in asked):
                places.setdefault(k, []).append(i)
        at = {leaf: _occurrences(leaf, places) for leaf in leaves}
        self.marked = {i for leaf in (query.terms() if query else []) for i in at[leaf]}
        self.hits = sorted(self.marked)
        self.matches = query.extents(at) if query else []

    def _ends(self, i: int) -> bool:
        """May a headline end with this word? Asked of few words of a text."""
        a, b = self.spans[i]
        return i in self.marked or (b - a > self.options.short_word and not NUMBER.fullmatch(self.text, a, b))

    def headline(self) -> str:
        o = self.options
        if o.highlight_all:
            return self._cut(0, len(self.text), tags=True)
        if not self.matches:
            last = min(o.min_words, len(self.spans)) - 1
            return self._cut(0, self.spans[last][1]) if last >= 0 else ""
        if o.max_fragments:
            return o.fragment_delimiter.join(self._part(a, b) for a, b in self._fragments())
        return self._part(*max((self._stretch(*m) for m in self.matches), key=lambda p: (self._ends(p[1]), self._count(*p))))

    def _count(self, first: int, last: int) -> int:
        """Query words from ``first`` to ``last``."""
        return bisect_right(self.hits, last) - bisect_left(self.hits, first)

    def _stretch(self, first: int, last: int) -> tuple[int, int]:
        """A match lengthened to the right, at the text's end to the left, or cut."""
        o, n = self.options, len(self.spans)
        last = min(last, first + o.max_words - 1)
        while last + 1 < n and last - first + 1 < o.max_words and (last - first + 1 < o.min_words or not self._ends(last)):
            last += 1
        while last - first + 1 > o.min_words and not self._ends(last):
            last -= 1
        if last - first + 1 < o.min_words:
            while first > 0 and last - first + 1 < o.max_words and (last - first + 1 < o.min_words or not self._ends(first)):
                first -= 1
        return first, last

    def _pieces(self) -> set[tuple[int, int]]:
        """Matches, those longer than a fragment cut into pieces that begin and end with query words."""
        out = set()
        for first, last in self.matches:
            inside = self.hits[bisect_left(self.hits, first) : bisect_right(self.hits, last)]
            while inside:
                held = bisect_right(inside, inside[0] + self.options.max_words - 1)
                out.add((inside[0], inside[held - 1]))
                inside = inside[held:]
        return out

    def _fragments(self) -> list[tuple[int, int]]:
        """The fragments to show, in the order of the text."""
        taken: list[tuple[int, int]] = []
        for first, last in sorted(self._pieces(), key=lambda p: (-self._count(*p), p[1] - p[0], p[0])):
            if all(last < a or b < first for a, b in taken):
                taken.append(self._widen(first, last, taken))
                if len(taken) == self.options.max_fragments:
                    break
        return sorted(taken)

    def _widen(self, first: int, last: int, taken: list[tuple[int, int]]) -> tuple[int, int]:
        """A piece with words around it: half of the room to the left, what is left of it to the right."""
        low = max((b + 1 for _, b in taken if b < first), default=0)
        high = min((a - 1 for a, _ in taken if a > last), default=len(self.spans) - 1)
        room = self.options.max_words - (last - first + 1)
        left = max(low, first - room // 2)
        while left < first and not self._ends(left):
            left += 1
        right = min(high, left + self.options.max_words - 1)
        while right > last and not self._ends(right):
            right -= 1
        return left, right

    def _part(self, first: int, last: int) -> str:
        return self._cut(self.spans[first][0], self.spans[last][1])

    def _cut(self, start: int, stop: int, tags: bool = False) -> str:
        """Text between two offsets with query words marked, markup as a blank unless ``tags``."""
        o = self.options
        inside = lambda spans: spans[bisect_left(spans, (start, start)) : bisect_right(spans, (stop, stop))]
        hits = inside([self.spans[i] for i in self.hits])
        changes = [(a, b, o.start_sel + self.text[a:b] + o.stop_sel) for a, b in hits]
        if not tags:
            changes += [(a, b, " ") for a, b in inside(self.tags)]
        out, done = [], start
        for a, b, new in sorted(changes):
            if start <= a and b <= stop:
                out += [self.text[done:a], new]
                done = b
        return "".join(out) + self.text[done:stop]


def _key(word: str, config: str, stems: dict) -> str | None:
    """What a word is compared by; None for a stop word. Each distinct word is stemmed once a batch."""
    low = word.lower()
    if config == "simple":
        return low
    if low not in stems:
        stems[low] = None if low in ts.STOPS.get(config, ()) else STEMMERS[config](low)
    return stems[low]


def _occurrences(term: ts.Term, places: dict[str, list[int]]) -> list[int]:
    if term.prefix:
        return sorted(i for k, at in places.items() if k.startswith(term.word) for i in at)
    return places.get(term.word, [])
