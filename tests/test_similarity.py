"""Edit distance, word similarity, JSON containment and recursion against brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import jsonx, strings
from tablewright.operators import joins, recursion


def cost(a, b, insert, delete, substitute):
    row = [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * delete]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y) * substitute, row[j] + delete, new[-1] + insert))
        row = new
    return row[-1]


def drawn(n, seed, most=9, letters="aab"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)})


@pytest.mark.parametrize("weights", [(1, 1, 1), (2, 2, 2), (1, 3, 2), (3, 1, 5), (2, 3, 1)])
@pytest.mark.parametrize("bound", [0, 1, 3, 6])
def test_edit_join(spark, weights, bound):
    left, right = drawn(60, 1), drawn(60, 2) + ["äöü", "äou"]
    a, b = (spark.createDataFrame([(w, len(w or "") % 2) for w in [*ws, None, ws[3]]], f"{n} string, k int") for ws, n in ((left + ["äöu"], "a"), (right, "b")))
    got = [tuple(r) for r in joins.edit_join(a, b, "a", "b", bound, *weights).collect()]
    assert sorted(got) == sorted((x, y, c) for x in {*left, "äöu"} for y in set(right) if (c := cost(x, y, *weights)) <= bound)
    same = {tuple(r)[1:] for r in joins.edit_join(a, b, "a", "b", bound, *weights, same=["k"]).collect()}
    assert same == {(x, y, c) for x, y, c in got if len(x) % 2 == len(y) % 2}


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_edit_join_of_longer_texts(spark, n):
    rng = random.Random(n)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(10, 40))) for _ in range(20)]

    def changed(w):
        for _ in range(rng.randint(0, n + 1)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + "z" + w[at:], w[:at] + "y" + w[at + 1:]])
        return w

    left, right = {changed(w) for w in base for _ in range(4)}, {changed(w) for w in base for _ in range(4)}
    frames = [spark.createDataFrame([(w,) for w in sorted(ws)], f"{c} string") for ws, c in ((left, "a"), (right, "b"))]
    got = {tuple(r) for r in joins.edit_join(*frames, "a", "b", n).collect()}
    assert got == {(x, y, c) for x in left for y in right if (c := cost(x, y, 1, 1, 1)) <= n}


def test_bounded_costs(spark):
    pairs = list(itertools.product(drawn(25, 5), drawn(25, 6)))
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for weights in ((1, 1, 1), (1, 3, 2), (4, 1, 9)):
        for bound in (None, 0, 2, 7):
            got = df.select("a", "b", strings.edit_cost(F.col("a"), F.col("b"), *weights, bound=bound).alias("c")).collect()
            for r in got:
                want = None if r.a is None or r.b is None else cost(r.a, r.b, *weights)
                assert r.c == (want if want is None or bound is None or want <= bound else -1)


def test_best_extents():
    rng = random.Random(9)
    for _ in range(400):
        wanted = rng.sample("abcdef", rng.randint(1, 5))
        stream = [rng.choice("abcdefgxyz") for _ in range(rng.randint(0, 14))]
        runs = [set(stream[i:j]) for i in range(len(stream)) for j in range(i + 1, len(stream) + 1)]
        expect = max((len(r & set(wanted)) / len(r | set(wanted)) for r in runs), default=0.0)
        assert strings.best_extent(wanted, stream) == pytest.approx(expect)


def test_word_similarity(spark):
    rows = [("word", "two words", 0.8), ("", "x", 0.0), ("abc", "", 0.0), (None, "x", None), ("x", None, None), ("abc", "abc", 1.0), ("there", "there was " * 3000, 1.0)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(strings.word_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [None if s is None else pytest.approx(s) for *_, s in rows]


CASES = [
    ('{"a":1,"b":2}', '{"a":1}', True), ('{"a":1}', '{"a":1.0}', True), ('{"a":1}', '{"a":"1"}', False), ('{"a":{"b":1,"c":2}}', '{"a":{"c":2}}', True), ('{"a":1}', "{}", True),
    ("[1,2,3]", "[3,1,1]", True), ("[1,2]", "2", True), ("[1,2]", '"2"', False), ("2", "[2]", False), ("[[1,2]]", "[1]", False), ("[[1,2],3]", "[[2]]", True), ("[[1,2],3]", "3", True),
    ('[{"a":1},{"b":2}]', '[{"a":1,"b":2}]', False), ('[{"a":1,"b":2}]', '[{"a":1},{"b":2}]', True), ('{"a":[1,2]}', '{"a":1}', False), ('{"a":[1,2]}', '{"a":[]}', True), ("[]", "{}", False),
    ("{}", "[]", False), ("null", "null", True), ("[null]", "null", True), ('{"a":null}', '{"a":null}', True), ('{"a":true}', '{"a":1}', False), ("1e2", "100", True), ('{"a":12345678901234567890.1}', '{"a":12345678901234567890.2}', False),
    (None, "1", None), ("1", None, None), ('{"k":[{"x":[1,{"y":2}]}]}', '{"k":[{"x":[{"y":2}]}]}', True),
]


def test_json_containment_of_columns(spark):
    got = spark.createDataFrame([c[:2] for c in CASES], "a string, b string").select("a", "b", jsonx.contains_json(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == CASES


def test_json_containment_join(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(5 if depth else 3)
        return [rng.randrange(3), rng.choice("xy"), rng.choice([None, True, 1.0])][kind] if kind < 3 else {k: value(depth - 1) for k in rng.sample("abc", rng.randint(0, 2))} if kind == 3 else [value(depth - 1) for _ in range(rng.randint(0, 3))]

    left, right = [json.dumps(value(3)) for _ in range(80)] + [c[0] for c in CASES if c[0]], [json.dumps(value(2)) for _ in range(50)] + [c[1] for c in CASES if c[1]]
    a, b = (spark.createDataFrame([(x,) for x in [*xs, None]], f"{c} string") for xs, c in ((left, "a"), (right, "b")))
    got = sorted(tuple(r) for r in joins.json_contains_join(a, b, "a", "b").collect())
    assert got == sorted((x, y) for x in set(left) for y in set(right) if jsonx.held_in(jsonx._read(x), jsonx._read(y), True))


def test_recursion_opens_few_parts(spark, monkeypatch):
    monkeypatch.setattr(recursion, "PART_ROWS", 40)
    monkeypatch.setattr(recursion, "REWRITE_ROUNDS", 4)
    made = []
    init = recursion.Seen.__init__
    monkeypatch.setattr(recursion.Seen, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    # a bush of 400 rows at once, then a path that adds one row a round and meets the bush again
    edges = spark.createDataFrame([(0, i) for i in range(100, 500)] + [(i, i + 1) for i in range(14)] + [(3, 0), (14, 0), (5, 100)] + [(7, None), (None, 1)], "f long, t long").cache()
    seed = spark.createDataFrame([(0,)], "node long")
    got = recursion.fixpoint(seed, lambda r: r.join(edges, F.col("node").eqNullSafe(F.col("f"))).select(F.col("t").alias("node")))
    assert sorted((r.node is None, r.node) for r in got.collect()) == sorted((x is None, x) for x in [*range(15), *range(100, 500), None])
    seen = made[0]
    assert seen.parts >= 20 and seen.rows == 416
    # the rounds of one or two candidates opened as many parts at most
    assert max(seen.opened[3:]) <= 3


def test_recursion_can_be_stopped(spark):
    step = lambda r: r.select((F.col("n") + 1).alias("n"))
    for distinct in (True, False):
        with pytest.raises(RuntimeError):
            recursion.fixpoint(spark.range(1).select(F.col("id").alias("n")), step, distinct, max_rounds=3)
    assert recursion.fixpoint(spark.range(0).select(F.col("id").alias("n")), step).count() == 0


def test_trigram_pairs_are_tested_inside_the_join(spark):
    texts = [f"{x}{y} {y}{z}" for x in ("alpha", "beta", "gamma") for y in ("water", "stone") for z in ("line", "lane", "")]
    df = spark.createDataFrame([(t,) for t in texts + texts[:4]] + [(None,), ("",)], "t string")
    got = joins.trigram_join(df.select(F.col("t").alias("a")), df.select(F.col("t").alias("b")), "a", "b", 0.4)
    # candidates grow with the square of the texts: none is aggregated or joined again
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join ") == 1
    a, b = df.filter("t <> ''").select(F.col("t").alias("a")).distinct(), df.filter("t <> ''").select(F.col("t").alias("b")).distinct()
    want = a.crossJoin(b).withColumn("similarity", strings.similarity(F.col("a"), F.col("b"))).filter("similarity >= 0.4")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
