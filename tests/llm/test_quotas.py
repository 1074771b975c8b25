"""Quotas and targets of the mix against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing


def highest_quotients(votes, seats):
    """Seats one by one to the party of the greatest votes / (2 seats + 1), the first of equal ones."""
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda p: (votes[p] / (2 * won[p] + 1), -p))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(3))
def test_seats_by_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for group in range(12):
        n = rnd.choice([1, 2, 3, 8, 25])
        # hot parties, ties and parties without votes
        votes = [float(rnd.choice([0, 1, 7, 7, 100, rnd.randint(1, 5000), 100000 if i == 0 else 3])) for i in range(n)]
        seats = rnd.choice([0, 1, 2, 17, 400])
        rows += [(group, p, v, float(seats)) for p, v in enumerate(votes)]
        want |= {(group, p): s for p, s in enumerate(highest_quotients(votes, seats))}
    parties = spark.createDataFrame(rows, "g int, p int, votes double, seats double")
    got = mixing.sainte_lague(parties, ["g"], [F.col("p")], "votes", "seats").collect()
    assert {(r.g, r.p): r["__quota"] for r in got} == want


def poured(sizes):
    """Targets by pouring the total in rounds over the sources that are not full."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(names)}
    left, full = mixing.SHARE * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0.0
        over = [s for s in rest if mixing.CAP * sizes[s] <= level * weight[s]]
        if not over:
            return {**full, **{s: level * weight[s] for s in rest}}
        for s in over:
            full[s] = float(mixing.CAP * sizes[s])
            left -= full[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_pouring(spark, seed):
    rnd = random.Random(seed)
    names = rnd.sample([None, "a", "b", "c", "dd", "e", "Z", "\u00e9"], rnd.randint(1, 8))
    sizes = {s: rnd.choice([0, 1, 5, 40, 1000, 90000]) for s in names}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(poured(sizes))
