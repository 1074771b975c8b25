"""Network addresses: ``struct<family, addr, bits>`` with the address as hex digits
(8 for version 4, 32 for version 6) and the prefix length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.core import bind, bound

HEX = "0123456789abcdef"


def _v4_hex(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.lower(F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), ""))


def _v6_hex(text: Column) -> Column:
    # a dotted tail becomes two groups, then "::" is filled up to eight groups
    tail = F.regexp_extract(text, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    tail_hex = _v4_hex(F.when(tail != "", tail))
    plain = F.when(tail != "", F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4))).otherwise(text)
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    head, rest = groups(F.split_part(plain, F.lit("::"), F.lit(1))), groups(F.split_part(plain, F.lit("::"), F.lit(2)))
    full = F.concat(head, F.array_repeat(F.lit("0"), (F.lit(8) - F.size(head) - F.size(rest)).cast("int")), rest)
    return F.lower(F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


@bound
def parse(text: Column) -> Column:
    """``10.1.2.3/16`` or ``fd00::1/64``; without a prefix length all bits count."""
    addr = F.split_part(text, F.lit("/"), F.lit(1))
    given = F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit(""))
    six = F.contains(addr, F.lit(":"))
    return F.struct(
        F.when(six, 6).otherwise(4).alias("family"), F.when(six, _v6_hex(F.when(six, addr))).otherwise(_v4_hex(F.when(~six, addr))).alias("addr"),
        F.coalesce(given.cast("int"), F.when(six, 128).otherwise(32)).alias("bits"),
    )


def make(family: Column, addr: Column, bits: Column) -> Column:
    return F.struct(family.alias("family"), addr.alias("addr"), bits.cast("int").alias("bits"))


def width(a: Column) -> Column:
    return F.when(a["family"] == 6, 128).otherwise(32)


def _digits(a: Column) -> Column:
    return F.length(a["addr"])


def _mask_hex(bits: Column, digits: Column) -> Column:
    """Hex digits with ``bits`` leading ones."""
    nibble = F.get(F.array(*[F.lit(c) for c in "08ce"]), bits % 4)
    head = F.concat(F.repeat(F.lit("f"), F.floor(bits / 4).cast("int")), F.when(bits % 4 > 0, nibble).otherwise(""))
    return F.rpad(head, digits, "0")


def _zip_hex(a: Column, b: Column, rule) -> Column:
    merged = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.lower(F.hex(rule(_nibble(x), _nibble(y)))))
    return F.array_join(merged, "")


def _nibble(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def _not_hex(a: Column) -> Column:
    return F.translate(a, HEX, HEX[::-1])


def _with(a: Column, addr: Column, bits: Column | None = None) -> Column:
    return make(a["family"], addr, a["bits"] if bits is None else bits)


def network_hex(addr: Column, bits: Column) -> Column:
    """Address with the bits beyond the prefix cleared."""
    return _zip_hex(addr, _mask_hex(bits, F.length(addr)), lambda x, y: x.bitwiseAND(y))


@bound
def network(a: Column) -> Column:
    return _with(a, network_hex(a["addr"], a["bits"]))


@bound
def netmask(a: Column) -> Column:
    return _with(a, _mask_hex(a["bits"], _digits(a)), width(a))


@bound
def hostmask(a: Column) -> Column:
    return _with(a, _not_hex(_mask_hex(a["bits"], _digits(a))), width(a))


@bound
def broadcast(a: Column) -> Column:
    return _with(a, _zip_hex(a["addr"], _not_hex(_mask_hex(a["bits"], _digits(a))), lambda x, y: x.bitwiseOR(y)))


def set_masklen(a: Column, bits: Column) -> Column:
    return _with(a, a["addr"], bits)


def same_family(a: Column, b: Column) -> Column:
    return a["family"] == b["family"]


@bound
def contains_eq(a: Column, b: Column) -> Column:
    """``a >>= b``: b lies in the network of a."""
    return same_family(a, b) & (a["bits"] <= b["bits"]) & (network_hex(a["addr"], a["bits"]) == network_hex(b["addr"], a["bits"]))


def contains(a: Column, b: Column) -> Column:
    return contains_eq(a, b) & (a["bits"] < b["bits"])


@bound
def overlaps(a: Column, b: Column) -> Column:
    return contains_eq(a, b) | contains_eq(b, a)


@bound
def merge(a: Column, b: Column) -> Column:
    """Smallest network that holds both."""
    return bind(_zip_hex(a["addr"], b["addr"], lambda x, y: x.bitwiseXOR(y)), lambda diff: _merge_at(a, b, diff))


def _merge_at(a: Column, b: Column, diff: Column) -> Column:
    zeros = F.length(F.regexp_extract(diff, "^(0*)", 1))
    first = F.substring(diff, zeros + 1, F.lit(1))
    lead = F.when(first == "", 0).when(first == "1", 3).when(first.isin("2", "3"), 2).when(first.isin("4", "5", "6", "7"), 1).otherwise(0)
    common = F.least(zeros * 4 + lead, a["bits"], b["bits"])
    return bind(common, lambda n: _with(a, network_hex(a["addr"], n), n))


@bound
def bit_and(a: Column, b: Column) -> Column:
    return _with(a, _zip_hex(a["addr"], b["addr"], lambda x, y: x.bitwiseAND(y)), F.greatest(a["bits"], b["bits"]))


@bound
def bit_or(a: Column, b: Column) -> Column:
    return _with(a, _zip_hex(a["addr"], b["addr"], lambda x, y: x.bitwiseOR(y)), F.greatest(a["bits"], b["bits"]))


@bound
def bit_not(a: Column) -> Column:
    return _with(a, _not_hex(a["addr"]))


def v4_number(a: Column) -> Column:
    return F.conv(a["addr"], 16, 10).cast("long")


@bound
def v4_plus(a: Column, n: Column) -> Column:
    """Version 4 address moved by ``n``; leaving the address space is an error."""
    moved = v4_number(a) + n
    wrong = F.raise_error(F.lit("result is out of range"))
    return _with(a, F.when((moved < 0) | (moved > 0xFFFFFFFF), wrong).otherwise(F.lower(F.lpad(F.hex(moved), 8, "0"))))


def v4_minus(a: Column, b: Column) -> Column:
    return v4_number(a) - v4_number(b)


@bound
def sort_key(a: Column) -> Column:
    """Order: family, network bits, prefix length, address."""
    shared = network_hex(a["addr"], a["bits"])
    return F.struct(a["family"].alias("f"), shared.alias("n"), a["bits"].alias("b"), a["addr"].alias("a"))


@bound
def host(a: Column) -> Column:
    """Address as text, without the prefix length."""
    pair = lambda i: F.conv(F.substring(a["addr"], 2 * i + 1, 2), 16, 10)
    four = F.concat_ws(".", *[pair(i) for i in range(4)])
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.regexp_replace(F.substring(a["addr"], i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    )
    return F.when(a["family"] == 6, bind(F.array_join(groups, ":"), _fold_zeros)).otherwise(four)


def _fold_zeros(six: Column) -> Column:
    """Write the first of the longest runs of zero groups as ``::``."""
    short = six
    for n in range(2, 9):
        run = r"(?:^|:)0(?::0){%d}(?=:|$)" % (n - 1)
        short = F.when(six.rlike(run), F.regexp_replace(_first(six, run), "\u0001:?", "::")).otherwise(short)
    return short


def _first(c: Column, pattern: str) -> Column:
    """Mark the first match of a pattern."""
    return F.regexp_replace(c, f"^(.*?){pattern}", "$1\u0001")


@bound
def text(a: Column) -> Column:
    """Address with the prefix length where it is not the full one."""
    return F.when(a["bits"] == width(a), host(a)).otherwise(F.concat(host(a), F.lit("/"), a["bits"].cast("string")))


# -- hardware addresses --------------------------------------------------------


def mac(c: Column) -> Column:
    """Twelve lower-case hex digits of any of the usual notations."""
    return F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))


def mac_text(m: Column) -> Column:
    return F.concat_ws(":", *[F.substring(m, 2 * i + 1, 2) for i in range(6)])


def mac_trunc(m: Column) -> Column:
    """Maker part kept, the rest zero."""
    return F.concat(F.substring(m, 1, 6), F.lit("000000"))


def mac_and(a: Column, b: Column) -> Column:
    return _zip_hex(a, b, lambda x, y: x.bitwiseAND(y))


def mac_or(a: Column, b: Column) -> Column:
    return _zip_hex(a, b, lambda x, y: x.bitwiseOR(y))


def mac_not(a: Column) -> Column:
    return _not_hex(a)
