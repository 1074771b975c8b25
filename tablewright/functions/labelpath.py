"""Dot-separated label paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.core import bound

from tablewright.functions import arrays as ar


def labels(p: Column) -> Column:
    return F.filter(F.split(p, r"\."), lambda x: x != "")


def nlevel(p: Column) -> Column:
    return F.size(labels(p))


def is_ancestor(a: Column, b: Column) -> Column:
    """``a @> b``: a is b or above it."""
    return (a == "") | (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


def is_descendant(a: Column, b: Column) -> Column:
    return is_ancestor(b, a)


def subpath(p: Column, offset: int, length: int | None = None) -> Column:
    """Labels from ``offset`` (from the end when negative); a negative length stops that far from the end."""
    parts = labels(p)
    n = F.size(parts)
    start = F.lit(offset) if offset >= 0 else F.greatest(n + offset, F.lit(0))
    stop = n if length is None else (start + length if length >= 0 else n + length)
    return F.array_join(F.slice(parts, start + 1, F.greatest(F.least(stop, n) - start, F.lit(0))), ".")


@bound
def index(p: Column, q: Column) -> Column:
    """Position of the first occurrence of ``q`` in ``p``, from 0; -1 when absent."""
    padded = F.concat(F.lit("."), p, F.lit("."))
    at = F.position(F.concat(F.lit("."), q, F.lit(".")), padded)
    before = F.substring(padded, F.lit(1), at - 1)
    return F.when(at == 0, F.lit(-1)).otherwise(F.size(labels(before)))


@bound
def lca(*paths: Column) -> Column:
    """Deepest common ancestor above all of the paths."""
    parts = [labels(p) for p in paths]
    shortest = F.least(*[F.size(x) for x in parts]) if len(parts) > 1 else F.size(parts[0])
    depths = F.sequence(F.lit(0), F.greatest(shortest - 1, F.lit(0)))
    same = lambda k: sum(((F.slice(x, F.lit(1), k) == F.slice(parts[0], F.lit(1), k)).cast("int") for x in parts), F.lit(0)) == len(parts)
    best = F.array_max(F.filter(depths, same))
    return F.array_join(F.slice(parts[0], F.lit(1), best), ".")


def path_regex(pattern: str) -> str:
    """Anchored regex for a label pattern.

    ``*`` any labels, ``*{n,m}`` so many labels; on a label ``|`` lists choices, ``!``
    negates, and the marks ``@`` (any case), ``*`` (prefix) and ``%`` (leading words).
    """
    import re

    out = ""
    for item in re.split(r"\.(?![^{]*\})", pattern):
        star = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", item)
        if star:
            low, comma, high = star.group(1), star.group(2), star.group(3)
            if low is None:
                count = "*"
            elif comma:
                count = "{%s,%s}" % (low or "0", high)
            else:
                count = "{%s}" % low
            out += rf"(?:[^.]+\.){count}"
            continue
        negate, body = item.startswith("!"), item.lstrip("!")
        choices = []
        for choice in body.split("|"):
            name = choice.rstrip("@*%")
            marks = choice[len(name):]
            rx = re.escape(name)
            if "%" in marks:
                tail = "[^._]*" if "*" in marks else ""
                rx += rf"{tail}(?:_[^.]*)?"
            elif "*" in marks:
                rx += "[^.]*"
            choices.append(f"(?i:{rx})" if "@" in marks else rx)
        one = "(?:" + "|".join(choices) + ")"
        out += (rf"(?!{one}\.)[^.]+\." if negate else rf"{one}\.")
    return f"^{out}$"


def matches(p: Column, pattern: str) -> Column:
    """``path ~ pattern``."""
    return F.concat(p, F.lit(".")).rlike(path_regex(pattern))


def matches_words(p: Column, query: str) -> Column:
    """``path @ query``: ``&``, ``|``, ``!`` over labels with the marks ``@ * %``."""
    def leaf(token: str) -> Column:
        return F.concat(p, F.lit(".")).rlike("(?:^|\\.)" + path_regex(token)[1:-1])

    return ar.boolean_query(query, leaf)


def any_matches(paths: Column, pattern: str) -> Column:
    rx = path_regex(pattern)
    return F.exists(paths, lambda p: F.concat(p, F.lit(".")).rlike(rx))


def any_ancestor(paths: Column, b: Column) -> Column:
    return F.exists(paths, lambda p: is_ancestor(p, b))


def first_ancestor(paths: Column, b: Column) -> Column:
    """First path of the array at or above ``b``; NULL when none is."""
    return F.get(F.filter(paths, lambda p: is_ancestor(p, b)), F.lit(0))


def first_match(paths: Column, pattern: str) -> Column:
    rx = path_regex(pattern)
    return F.get(F.filter(paths, lambda p: F.concat(p, F.lit(".")).rlike(rx)), F.lit(0))
