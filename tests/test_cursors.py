"""Cursors against a plain list: every direction, NULL and equal keys, chunks of any number."""

import random

import pytest

from tablewright.operators.relational import Cursor
from tests.plans import files_opened


class Listed:
    """The same moves on a list held in memory."""

    def __init__(self, rows):
        self.rows, self.at = rows, 0

    def fetch(self, direction, n=None):
        size = len(self.rows)
        if direction == "next":
            direction, n = "forward", 1
        if direction == "prior":
            direction, n = "backward", 1
        if direction in ("forward", "backward") and n != "all" and n < 0:
            direction, n = {"forward": "backward", "backward": "forward"}[direction], -n
        if direction in ("forward", "backward") and n != 0:
            out, step = [], 1 if direction == "forward" else -1
            left = size + 1 if n == "all" else n
            while left and 0 <= self.at + step <= size + 1:
                self.at += step
                if not 1 <= self.at <= size:
                    break
                out.append(self.rows[self.at - 1])
                left -= 1
            return out
        goal = {"first": 1, "last": size, "forward": self.at, "backward": self.at}.get(direction)
        if goal is None:
            goal = self.at + n if direction == "relative" else n if n >= 0 else size + 1 + n
        self.at = min(max(goal, 0), size + 1)
        return [self.rows[self.at - 1]] if 1 <= self.at <= size else []


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(15)]), f"r{i}") for i in range(90)]
    return rows, spark.createDataFrame(rows, "a int, b int, name string").repartition(4).cache()


@pytest.mark.parametrize("order, chunks", [(["a", "b"], 3), (["-a", "b"], 16), (["b"], None), (["-b", "-a"], 1)])
def test_every_direction(table, order, chunks):
    rows, df = table

    def sort_key(r):
        out = []
        for o in [*order, *[c for c in ("a", "b", "name") if c not in [x.lstrip("-") for x in order]]]:
            v = r["a b name".split().index(o.lstrip("-"))]
            null = v is None
            if o.startswith("-"):
                out += [not null, 0 if null else -v]
            else:
                out += [null, "" if null and o == "name" else 0 if null else v]
        return out

    cursor, listed = Cursor(df, order, chunks=chunks), Listed(sorted(rows, key=sort_key))
    rng = random.Random(len(order))
    steps = [("forward", 5), ("backward", 2), ("last",), ("next",), ("prior",), ("backward", "all"), ("prior",), ("forward", "all"), ("next",), ("first",), ("absolute", 90), ("absolute", 91), ("absolute", -90), ("absolute", -91), ("relative", 0), ("forward", 0), ("forward", -3)]
    steps += [(d, rng.randint(-40, 60)) for d in rng.choices(["forward", "backward", "absolute", "relative"], k=12)]
    for i, step in enumerate(steps):
        expect = listed.fetch(*step)
        if i % 4 == 3:
            assert cursor.move(*step) == len(expect), step
        else:
            assert [tuple(r) for r in cursor.fetch(*step).collect()] == expect, step
        assert cursor.at == listed.at, step


def test_one_chunk_is_opened(spark):
    cursor = Cursor(spark.range(5000), ["id"], chunks=50)
    assert len(cursor.bounds) > 20 and cursor.count == 5000
    page = cursor.fetch_numbered("absolute", 2500)
    assert [(r.id, r.position) for r in page.collect()] == [(2499, 2500)]
    assert sum(a < 2500 <= b for a, b in cursor.bounds.values()) == 1
    # one file of fifty
    assert [n for n, _ in files_opened(cursor._range(2500, 2500))] == [1]


def test_forward_only(spark):
    cursor = Cursor(spark.range(10), ["id"], scroll=False)
    assert [r.id for r in cursor.fetch(3).collect()] == [0, 1, 2]
    for step in (("backward", 1), ("absolute", 1), ("relative", -1), ("first",), ("prior",)):
        with pytest.raises(ValueError):
            cursor.fetch(*step)
    assert [r.id for r in cursor.fetch("absolute", 5).collect()] == [4]
    assert [r.id for r in cursor.fetch("forward", "all").collect()] == [5, 6, 7, 8, 9]


def test_empty(spark):
    cursor = Cursor(spark.range(0), ["id"])
    assert cursor.fetch(3).collect() == [] and cursor.fetch("last").collect() == [] and cursor.move("backward", "all") == 0
