"""XML in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def element(name: str, *content: Column, **attributes: Column) -> Column:
    """``<name a="...">content</name>``; content is markup already, NULLs are skipped."""
    attrs = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape(v.cast("string")), F.lit('"'))) for k, v in attributes.items()]
    inner = F.concat_ws("", *content) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), F.concat_ws("", *attrs) if attrs else F.lit(""))
    return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>")))


def forest(**fields: Column) -> Column:
    """One element per column; NULL columns give none."""
    return F.concat_ws("", *[F.when(c.isNotNull(), element(k, escape(c.cast("string")))) for k, c in fields.items()])


def concat(*parts: Column) -> Column:
    return F.concat_ws("", *parts)


def instruction(target: str, content: Column | None = None) -> Column:
    return F.concat(F.lit(f"<?{target}"), F.concat(F.lit(" "), content) if content is not None else F.lit(""), F.lit("?>"))


def root(c: Column, version: str = "1.0") -> Column:
    return F.concat(F.lit(f'<?xml version="{version}"?>'), c)


def comment(c: Column) -> Column:
    return F.concat(F.lit("<!--"), c, F.lit("-->"))


def exists(c: Column, path: str) -> Column:
    return F.xpath_boolean(c, F.lit(f"boolean({path})"))


def is_well_formed(c: Column) -> Column:
    """Does the parser accept the whole text?"""
    corrupt = F.from_xml(c, "__none string, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return F.coalesce(corrupt["__bad"].isNull(), F.lit(False)) & c.isNotNull()


def table_rows(name: str, columns: list[str]) -> Column:
    """Row element with one child per column; NULLs are left out."""
    return element(name, forest(**{c: F.col(c) for c in columns}))
