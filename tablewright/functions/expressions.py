"""Small boolean expressions in text: words with ``& | ! ( )``, and ``<->`` or ``<n>`` between words that follow each other.

``!`` binds most, then ``<->``, then ``&``, then ``|``. A word in single quotes may hold anything; two quotes stand for one.
What a word and the operators become is up to the caller.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TypeVar

N = TypeVar("N")

_TOKENS = re.compile(r"\s*(?:(<->|<\d+>)|([&|!()])|((?:'(?:[^']|'')*'|(?!<->|<\d+>)[^\s&|!()'])+)|(\S))")


def parse(
    text: str, leaf: Callable[[str], N | None], both: Callable[[N, N], N], either: Callable[[N, N], N], negated: Callable[[N], N],
    followed: Callable[[N, N, int], N] | None = None,
) -> N | None:
    """The expression built bottom up. A leaf that is None (a stop word) leaves its operator; in a sequence it widens
    the distance between its neighbours."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if m is None or m.group(4):
            raise ValueError(f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
        tokens.append(m.group(1) or m.group(2) or m.group(3))
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take(wanted: str | None = None) -> str:
        nonlocal place
        token = peek()
        if token is None or (wanted and token != wanted):
            raise ValueError(f"{wanted or 'a word'} expected at word {place + 1} of {text!r}")
        place += 1
        return token

    def joined(operator: str, part: Callable[[], N | None], join: Callable[[N, N], N]) -> N | None:
        out = part()
        while peek() == operator:
            take()
            more = part()
            out = more if out is None else out if more is None else join(out, more)
        return out

    def alternatives() -> N | None:
        return joined("|", all_of, either)

    def all_of() -> N | None:
        return joined("&", sequence, both)

    def sequence() -> N | None:
        out, gap = single(), 0
        while (token := peek()) is not None and token[0] == "<":
            if followed is None:
                raise ValueError(f"{token} has no meaning here")
            take()
            gap += 1 if token == "<->" else int(token[1:-1])
            more = single()
            if more is not None:
                out, gap = more if out is None else followed(out, more, gap), 0
        return out

    def single() -> N | None:
        token = take()
        if token == "!":
            part = single()
            return None if part is None else negated(part)
        if token == "(":
            part = alternatives()
            take(")")
            return part
        if token in "&|)" or token[0] == "<":
            raise ValueError(f"a word expected before {token!r} in {text!r}")
        return leaf(token)

    out = alternatives()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in {text!r}")
    return out


def unquoted(token: str) -> tuple[str, str]:
    """A word and the flags after its last colon."""
    m = re.fullmatch(r"'((?:[^']|'')*)'(?::(.*))?", token)
    if m:
        return m.group(1).replace("''", "'"), m.group(2) or ""
    word, _, flags = token.partition(":")
    return word, flags
