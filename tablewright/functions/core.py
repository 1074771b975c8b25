"""Helpers for building expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Reusing a Column object repeats its whole expression; a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(function: Callable[..., Column]) -> Callable[..., Column]:
    """Decorator: every Column argument is evaluated once per row."""

    @functools.wraps(function)
    def wrapper(*args, **kwargs):
        at = [i for i, a in enumerate(args) if isinstance(a, Column)]
        if not at:
            return function(*args, **kwargs)
        packed = F.struct(*[args[i].alias(f"_{i}") for i in at])

        def body(s: Column) -> Column:
            inner = list(args)
            for i in at:
                inner[i] = s[f"_{i}"]
            return function(*inner, **kwargs)

        return bind(packed, body)

    return wrapper
