"""Approximate nearest neighbours in a hierarchical k-means tree, by largest inner product.

The tree is fitted on a hashed sample of about ``SAMPLE`` rows and has at most ``LEAVES`` leaves, so it fits a
broadcast; every row is put into a leaf. A query goes through the tree best bin first: a priority queue holds the nodes
met, by inner product with their centre, and gives the next best leaf. The number of leaves to visit is calibrated:
for ``CALIBRATION`` queries the true neighbours are found by comparing with every row, and visits widen until the
leaves reached hold ``RECALL`` of them.

Leaves with many rows are cut into chunks, and so are the queries that visit one leaf; a task compares a chunk of
queries with a chunk of rows and keeps the best ``k`` of each query, so a leaf full of equal vectors is no larger task.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component takes no part, neither as
a query nor as a candidate; nor does a vector whose length differs from the most frequent one. Fewer candidates than k
give fewer rows; equal scores go by smaller id; repeated rows of one id are candidates each; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import per_batch, record, ship, stored

SAMPLE = 20_000
LEAVES = 4096
LEAF_ROWS = 4096
BRANCHES = 16
CALIBRATION = 200
RECALL = 0.97
ROWS_PER_CHUNK = 8192
QUERIES_PER_CHUNK = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id v`` of the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null").filter(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def k_means(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (0.5 * (centres**2).sum(1)[None, :] - x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        for j in np.flatnonzero(count):
            centres[j] = x[near == j].mean(0)
    return centres, (0.5 * (centres**2).sum(1)[None, :] - x @ centres.T).argmin(1)


class Tree:
    """Nodes as arrays: centre, first child and number of children; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, n_leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children = [sample.mean(0)], [[]]
        self.leaf_of: dict[int, int] = {}
        parts = [(-len(sample), 0, sample)]
        leaves = 1
        while parts and leaves < n_leaves:
            # the largest part is split next
            size, node, x = heapq.heappop(parts)
            k = min(BRANCHES, n_leaves - leaves + 1, len(np.unique(x, axis=0)))
            if k < 2:
                continue
            centres, near = k_means(x, k, rng)
            for j in range(k):
                if (near == j).any():
                    self.children[node].append(len(self.centres))
                    heapq.heappush(parts, (-int((near == j).sum()), len(self.centres), x[near == j]))
                    self.centres.append(centres[j])
                    self.children.append([])
            leaves += len(self.children[node]) - 1
        self.centres = np.array(self.centres)
        self.leaf_of = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to: the nearest centre at every level."""
        out, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centres[self.children[node]]
            near = (0.5 * (c**2).sum(1)[None, :] - x[rows] @ c.T).argmin(1)
            work += [(child, rows[near == j]) for j, child in enumerate(self.children[node]) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least_rows: int = 0) -> list[int]:
        """Leaves in best-bin-first order: so many, and more as long as they hold fewer rows than ``least_rows``."""
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < most or rows < least_rows):
            _, node = heapq.heappop(queue)
            while self.children[node]:
                c = self.children[node]
                score = self.centres[c] @ q
                best = int(score.argmax())
                for j, child in enumerate(c):
                    if j != best:
                        heapq.heappush(queue, (-float(score[j]), child))
                node = c[best]
            out.append(self.leaf_of[node])
            rows += 0 if sizes is None else int(sizes[out[-1]])
        return out


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """For each query its k best rows other than itself, with scores summed in one order for every row."""
    approx = q @ v.T
    slack = 1e-9 * (np.abs(approx).max() if approx.size else 0.0)
    for i in range(len(q)):
        row = approx[i].copy()
        row[ids == q_ids[i]] = -np.inf
        top = np.flatnonzero(row > -np.inf)
        if len(top) > k:
            top = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack)
        score = (v[top] * q[i]).sum(axis=1)
        by = np.lexsort((ids[top], -score))[:k]
        yield i, ids[top][by], score[by]


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _exact(queries: dict, rows: DataFrame, k: int) -> DataFrame:
    """Best of each query among all rows: a bounded set of queries goes to every task."""

    def build():
        q_ids, q = np.array(list(queries)), np.array(list(queries.values()))

        def step(batch: pa.RecordBatch):
            ids, v = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            leaf = batch.column("leaf").to_numpy()
            got = [(np.full(len(x), q_ids[i]), x, s) for i, x, s in best(q_ids, q, ids, v, k)]
            out = [np.concatenate(c) for c in zip(*got)]
            at = np.argsort(ids, kind="stable")
            where = at[np.searchsorted(ids[at], out[1])] if len(out[1]) else np.zeros(0, np.int64)
            return record(query_id=out[0], vec_id=out[1], score=out[2], leaf=leaf[where])

        return step

    return _ranked(per_batch(rows, build, FOUND + ", leaf long"), k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id rank vec_id score``: for each vector with an id divisible by ``every`` the k nearest found."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "tree-vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashed = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows if n <= SAMPLE else rows.filter(hashed < SAMPLE / n)
    sample = np.array([r["v"] for r in sample.orderBy("vec_id").select("v").collect()])
    tree = Tree(sample, int(min(LEAVES, max(1, n // LEAF_ROWS))))

    def place():
        def step(batch: pa.RecordBatch):
            return record(vec_id=batch.column("vec_id"), v=batch.column("v"), leaf=tree.leaves(matrix(batch.column("v"))))

        return step

    rows = stored(per_batch(rows, place, "vec_id long, v array<double>, leaf long"), "tree-leaves")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").dropDuplicates(["vec_id"])
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    probe = asked if n_asked <= CALIBRATION else asked.filter(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(12)), F.lit(1 << 30)) / float(1 << 30) < CALIBRATION / n_asked)
    probe = {r["vec_id"]: np.array(r["v"]) for r in probe.orderBy("vec_id").collect()}
    depth, truth = [], _exact(probe, rows, k).select("query_id", "leaf").collect() if probe else []
    order = {i: {leaf: d for d, leaf in enumerate(tree.visits(q, len(tree.leaf_of)))} for i, q in probe.items()}
    depth = sorted(order[r["query_id"]][r["leaf"]] for r in truth)
    visits = depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)] + 1 if depth else len(tree.leaf_of)

    # rows of each leaf: at most LEAVES numbers
    sizes = np.zeros(len(tree.leaf_of), np.int64)
    for r in rows.groupBy("leaf").agg(F.countDistinct("vec_id").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]

    def route():
        def step(batch: pa.RecordBatch):
            q = matrix(batch.column("v"))
            # the query itself is one of the rows
            leaves = [tree.visits(x, visits, sizes, k + 1) for x in q]
            at = np.repeat(np.arange(len(q)), [len(x) for x in leaves])
            return record(query_id=batch.column("vec_id").take(pa.array(at)), q=batch.column("v").take(pa.array(at)), leaf=np.concatenate(leaves).astype(np.int64))

        return step

    routed = stored(per_batch(asked, route, "query_id long, q array<double>, leaf long"), "tree-visits")
    many = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("nq")).join(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("nv")), "leaf")
    many = many.select("leaf", F.ceil(F.col("nq") / QUERIES_PER_CHUNK).alias("cq"), F.ceil(F.col("nv") / ROWS_PER_CHUNK).alias("cv"))
    deal = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int")))
    left = routed.join(F.broadcast(many), "leaf").select("leaf", deal("query_id", "cq").alias("a"), spread("cv").alias("b"), "query_id", "q")
    right = rows.join(F.broadcast(many), "leaf").select("leaf", spread("cq").alias("a"), deal("vec_id", "cv").alias("b"), "vec_id", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        q, v = matrix(left.column("q").combine_chunks()), matrix(right.column("v").combine_chunks())
        got = [(np.full(len(x), q_ids[i]), x, s) for i, x, s in best(q_ids, q, ids, v, k)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*got)))))

    ship(spark)
    found = left.groupBy("leaf", "a", "b").cogroup(right.groupBy("leaf", "a", "b")).applyInArrow(compare, FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"))
