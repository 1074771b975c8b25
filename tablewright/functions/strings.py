"""Text functions as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def words(c: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """Distinct trigrams; each word is padded with two blanks before and one after."""
    per_word = F.transform(
        words(c),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def trigram_codes(c: Column) -> Column:
    """Distinct trigrams as numbers: three code points of 21 bits each."""
    part = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(trigrams(c), lambda g: F.shiftleft(part(g, 1), 42) + F.shiftleft(part(g, 2), 21) + part(g, 3))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both texts."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def word_similarity(needle: Column, haystack: Column) -> Column:
    """Greatest similarity of ``needle`` to any contiguous run of trigrams of ``haystack``.

    Work grows with the length of ``haystack``, times the trigrams of ``needle``.
    """
    return _word_similarity(F.lower(needle), F.lower(haystack))


@F.pandas_udf(T.DoubleType())
def _word_similarity(needle: pd.Series, haystack: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_extent(trigram_stream(x), trigram_stream(y)) for x, y in zip(needle, haystack)], dtype="float64")


def trigram_stream(text: str) -> list[str]:
    """All trigrams of a lower-case text in order, each word padded as in :func:`trigrams`."""
    return [padded[i:i + 3] for w in re.findall(r"[^\W_]+", text) for padded in [f"  {w} "] for i in range(len(w) + 1)]


def best_extent(wanted: list[str], stream: list[str]) -> float:
    """Greatest share, of all distinct trigrams of both, that a run of ``stream`` has in common with ``wanted``.

    For every count of common trigrams the shortest run that ends at each place and has as many is found by moving its
    start forward only; of those a shorter run never has more other trigrams.
    """
    own = set(wanted)
    # what stands before the first and after the last common trigram is in no best run
    hits = [i for i, g in enumerate(stream) if g in own]
    if not hits:
        return 0.0
    stream = stream[hits[0]:hits[-1] + 1]
    codes: dict[str, int] = {}
    run = [codes.setdefault(g, len(codes)) for g in stream]
    common = [g in own for g in codes]
    best = 0.0
    for count in range(1, sum(common) + 1):
        seen, start, hit, other = [0] * len(codes), 0, 0, 0
        for end, g in enumerate(run):
            seen[g] += 1
            if seen[g] == 1:
                if common[g]:
                    hit += 1
                else:
                    other += 1
            # drop what is not needed at the start
            while hit > count or (seen[run[start]] > 1 or not common[run[start]]) and hit >= count and start < end:
                s = run[start]
                seen[s] -= 1
                if not seen[s]:
                    if common[s]:
                        hit -= 1
                    else:
                        other -= 1
                start += 1
            if hit == count and common[g]:
                best = max(best, hit / (len(own) + other))
    return best


@F.pandas_udf(T.IntegerType())
def _bounded_cost(a: pd.Series, b: pd.Series, insert: pd.Series, delete: pd.Series, substitute: pd.Series, bound: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else banded_cost(x, y, *w) for x, y, *w in zip(a, b, insert, delete, substitute, bound)], dtype="Int32")


def edit_cost(a: Column, b: Column, insert: int = 1, delete: int = 1, substitute: int = 1, bound: int | None = None) -> Column:
    """Least cost of edits that turn ``a`` into ``b``; with a bound, -1 for what is above it.

    Only the band of the cost table that the bound can reach is filled. Equal costs without Python.
    """
    if insert == delete == substitute:
        least = F.levenshtein(a, b) if bound is None else F.levenshtein(a, b, bound // insert)
        return F.when(least >= 0, least * insert).otherwise(least)
    return _bounded_cost(a, b, *[F.lit(x) for x in (insert, delete, substitute, -1 if bound is None else bound)])


def banded_cost(a: str, b: str, insert: int, delete: int, substitute: int, bound: int) -> int:
    """Least cost of turning ``a`` into ``b``, or -1 above the bound; a negative bound is none."""
    if bound < 0:
        bound = insert * len(b) + delete * len(a)
    # so many letters of a, or of b, can be passed over within the bound
    ahead = bound // insert if insert else len(b)
    behind = bound // delete if delete else len(a)
    above = bound + 1
    row = [j * insert if j <= ahead else above for j in range(len(b) + 1)]
    for i, letter in enumerate(a, 1):
        low, high = max(0, i - behind), min(len(b), i + ahead)
        new = [above] * (len(b) + 1)
        if low == 0:
            new[0] = min(above, i * delete)
        for j in range(max(low, 1), high + 1):
            new[j] = min(row[j - 1] + (letter != b[j - 1]) * substitute, row[j] + delete, new[j - 1] + insert, above)
        row = new
        if min(row[low:high + 1], default=above) > bound:
            return -1
    return row[-1] if row[-1] <= bound else -1


# The digit each letter A..Z stands for in a sound code; 0 is silent.
SOUND_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SOUND_DIGITS = "01230120022455012623010202"


def sound_code(c: Column) -> Column:
    """Four-character sound code; letters of one digit count once when adjacent."""
    text = F.regexp_replace(F.upper(c), "^[^A-Z]+", "")
    digits = F.translate(text, SOUND_LETTERS, SOUND_DIGITS)
    for d in "123456":
        digits = F.regexp_replace(digits, f"{d}+", d)
    tail = F.regexp_replace(F.substring(digits, F.lit(2), F.length(digits)), "[^1-6]", "")
    code = F.rpad(F.concat(F.substring(text, 1, 1), tail), 4, "0")
    return F.when(F.length(text) == 0, F.lit("")).otherwise(code)


def sound_difference(a: Column, b: Column) -> Column:
    """Number of equal positions, 0 to 4, of two sound codes."""
    x, y = sound_code(a), sound_code(b)
    return sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(1, 5)), F.lit(0))


def initcap_words(c: Column) -> Column:
    """First letter of each run of letters and digits in upper case, the rest lower."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""
    )


def left(c: Column, n: int) -> Column:
    """First ``n`` characters; a negative ``n`` drops that many from the end."""
    return F.substring(c, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(c) + n, F.lit(0)))


def right(c: Column, n: int) -> Column:
    """Last ``n`` characters; a negative ``n`` drops that many from the start."""
    if n < 0:
        return F.substring(c, F.lit(1 - n), F.length(c))
    return F.substring(c, F.greatest(F.length(c) - n, F.lit(0)) + 1, F.lit(n))


def concat_skip(*cols: Column) -> Column:
    """Concatenation that skips NULLs."""
    return F.concat_ws("", *cols)


def chr_code(c: Column) -> Column:
    """Character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 4, "0")), "UTF-16BE")


def replace_first(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Regex replace of the first match, or all with flag ``g``; ``i`` ignores case."""
    p = f"(?i){pattern}" if "i" in flags else pattern
    if "g" in flags:
        return F.regexp_replace(c, p, replacement)
    at = F.regexp_instr(c, F.lit(p))
    hit = F.regexp_substr(c, F.lit(p))
    rest = F.substring(c, at + F.length(hit), F.length(c))
    swapped = F.regexp_replace(hit, p, replacement)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), swapped, rest)).otherwise(c)


def sql_regex(pattern: str) -> str:
    """Anchored Java regex of a SQL ``SIMILAR TO`` pattern."""
    out, i = [], 0
    in_set = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1])
            i += 1
        elif in_set:
            out.append(ch)
            in_set = ch != "]"
        elif ch == "[":
            out.append(ch)
            in_set = True
        elif ch in "%_":
            out.append("(?s:.*)" if ch == "%" else "(?s:.)")
        elif ch in ".^$":
            out.append("\\" + ch)
        elif ch == "(":
            out.append("(?:")
        else:
            out.append(ch)
        i += 1
    return "^(?:" + "".join(out) + ")$"


def similar_to(c: Column, pattern: str) -> Column:
    return c.rlike(sql_regex(pattern))


def substring_similar(c: Column, pattern: str, escape: str = "#") -> Column:
    """``substring(s FROM 'a#"b#"c' FOR '#')``: the part between the two marks."""
    before, middle, after = pattern.split(f'{escape}"')
    bits = [sql_regex(p)[1:-1] for p in (before, middle, after)]
    whole = f"^{bits[0]}({bits[1]}){bits[2]}$"
    return F.when(c.rlike(whole), F.regexp_extract(c, whole, 1))


def quote_literal(c: Column) -> Column:
    body = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    mark = F.when(F.instr(c, "\\") > 0, F.lit(" E'")).otherwise(F.lit("'"))
    return F.concat(mark, body, F.lit("'"))


def quote_nullable(c: Column) -> Column:
    return F.coalesce(quote_literal(c), F.lit("NULL"))


def quote_ident(c: Column) -> Column:
    """Identifier, quoted unless it is plain lower case."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike("^[a-z_][a-z0-9_]*$"), c).otherwise(quoted)


def format_text(template: str, *cols: Column) -> Column:
    """``%s`` value, ``%I`` identifier, ``%L`` literal, ``%%``; ``%n$s`` picks argument n."""
    out, i, nxt = [], 0, 0
    while i < len(template):
        if template[i] != "%":
            j = template.find("%", i)
            j = len(template) if j < 0 else j
            out.append(F.lit(template[i:j]))
            i = j
            continue
        i += 1
        if template[i] == "%":
            out.append(F.lit("%"))
            i += 1
            continue
        digits = ""
        while template[i].isdigit():
            digits += template[i]
            i += 1
        if digits:
            i += 1  # the dollar sign
            nxt = int(digits) - 1
        arg = cols[nxt].cast("string")
        nxt += 1
        kind = template[i]
        i += 1
        out.append({"s": F.coalesce(arg, F.lit("")), "I": quote_ident(arg), "L": quote_nullable(arg)}[kind])
    return F.concat(*out)


def unaccent(c: Column, rules: dict[str, str]) -> Column:
    """Replace characters by a rule table; longer replacements are applied one by one."""
    short = {k: v for k, v in rules.items() if len(k) == 1 and len(v) == 1}
    out = F.translate(c, "".join(short), "".join(short.values())) if short else c
    for k, v in rules.items():
        if k not in short:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Keyed digest in hex, built from two hash passes over padded keys."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ m for b in block) for m in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), c.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


# Name spaces of name-based UUIDs.
UUID_NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid_named(c: Column, namespace: str = UUID_NAMESPACE_URL, version: int = 5) -> Column:
    """UUID of a name: version 3 uses MD5, version 5 SHA-1."""
    raw = F.concat(F.unhex(F.lit(namespace)), c.cast("binary"))
    digest = F.md5(raw) if version == 3 else F.sha1(raw)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit(str(version)), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def check_digit_ean13(c: Column) -> Column:
    """Check digit of the first twelve digits: weights 1 and 3, modulo 10."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)), F.lit(0),
        lambda acc, i: acc + F.substring(c, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1),
    )
    return (F.lit(10) - total % 10) % 10


def _weighted_mod11(c: Column, digits: int) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(digits)), F.lit(0),
        lambda acc, i: acc + F.substring(c, i, F.lit(1)).cast("int") * (F.lit(digits + 2) - i),
    )
    value = (F.lit(11) - total % 11) % 11
    return F.when(value == 10, F.lit("X")).otherwise(value.cast("string"))


def check_char_isbn10(c: Column) -> Column:
    """Check character of nine digits: weights 10 down to 2, modulo 11."""
    return _weighted_mod11(c, 9)


def check_char_issn(c: Column) -> Column:
    """Check character of seven digits: weights 8 down to 2, modulo 11."""
    return _weighted_mod11(c, 7)


def padded_equal(a: Column, b: Column) -> Column:
    """Equality of blank-padded text: trailing blanks do not count."""
    return F.rtrim(a) == F.rtrim(b)


class Enum:
    """Labels with a declared order."""

    def __init__(self, *labels: str):
        self.labels = labels

    def ordinal(self, c: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, label in reversed(list(enumerate(self.labels))):
            out = F.when(c == label, F.lit(i)).otherwise(out)
        return out

    def less(self, a: Column, b: Column) -> Column:
        return self.ordinal(a) < self.ordinal(b)

    def first(self) -> str:
        return self.labels[0]

    def last(self) -> str:
        return self.labels[-1]

    def between(self, low: str | None, high: str | None) -> list[str]:
        lo = 0 if low is None else self.labels.index(low)
        hi = len(self.labels) - 1 if high is None else self.labels.index(high)
        return list(self.labels[lo : hi + 1])
