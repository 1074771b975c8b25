"""Change logs: replays, late changes, compaction by levels, what readers see meanwhile."""

import pytest

from tablewright.session import scratch_path
from tablewright.sources.manifests import Manifest, Run, Store
from tablewright.streaming import changes

FEED = "k int, seq int, op string, v double"


class Log:
    def __init__(self, spark):
        self.spark, self.base = spark, scratch_path(spark, "log")
        self.target, self.sent = f"{self.base}/t", 0

    def feed(self, rows, offsets="offsets"):
        if rows:
            self.spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{self.base}/feed")
        changes.start_apply(self.spark, f"{self.base}/feed", FEED, self.target, ["k"], "seq", f"{self.base}/{offsets}", files_per_batch=1).awaitTermination()

    def rows(self, number=None):
        return {r.k: r.v for r in changes.current(self.spark, self.target, ["k"], "seq", number=number).collect()}

    def compact(self, **how):
        return changes.compact(self.spark, self.target, ["k"], "seq", **how)

    @property
    def store(self):
        return Store(self.spark, self.target)

    def live_bytes(self):
        return self.store.bytes_of(self.store.read().runs)


@pytest.fixture()
def log(spark):
    return Log(spark)


def test_replayed_batches_change_nothing(log):
    log.feed([(1, 1, "I", 5.0), (1, 2, "U", 6.0), (2, 3, "I", 7.0), (2, 4, "D", None)])
    before = log.store.read()
    log.feed([])  # nothing new
    assert log.store.read() == before and log.rows() == {1: 6.0}
    log.feed([], offsets="fresh")  # every batch again, under other offsets: same rows
    assert log.rows() == {1: 6.0}
    log.compact(full=True)
    log.feed([], offsets="third")
    assert log.rows() == {1: 6.0}


def test_known_batches_are_not_written_again(log):
    log.feed([(1, 1, "I", 5.0)])
    name = log.store.read().batches[0].name
    folded = log.compact(full=True)
    assert folded.knows(name) and [r.level for r in folded.runs] == [True]
    again = log.store.change(lambda m: None if m.knows(name) else Manifest(runs=(Run(name, 1),)))
    assert again == folded


def test_compaction_makes_reading_cheaper(log):
    expect = {}
    for turn in range(2):
        for batch in range(3):
            at = 1000 * (3 * turn + batch)
            log.feed([(k, at + k, "D" if k % 7 == 0 and batch else "U", float(at)) for k in range(300)])
            expect |= {k: float(at) for k in range(300)}
            expect = {k: v for k, v in expect.items() if not (k % 7 == 0 and batch)}
        assert log.rows() == expect
        size, number = log.live_bytes(), log.store.read().number
        m = log.compact()
        assert log.live_bytes() < size / 2 and log.rows() == expect
        assert log.rows(number) == expect  # readers of the earlier manifest still have its runs
        assert len(m.runs) == 1
        # the only level holds no deletes
        assert log.spark.read.parquet(log.store.path(m.runs[0].name)).count() == len(expect)
    gone = log.store.vacuum(keep=1)
    assert len(gone) >= 7 and log.rows() == expect and log.store.vacuum(keep=1) == []


def test_large_levels_are_left_alone(log):
    log.feed([(k, k, "I", 1.0) for k in range(2000)])
    base = log.compact().runs[0]
    log.feed([(5, 5000, "D", None), (6, 5001, "U", 2.0), (9000, 5002, "I", 3.0)])
    m = log.compact()
    assert [r.rows for r in m.runs] == [2000, 3] and m.runs[0] == base
    expect = {k: 1.0 for k in range(2000) if k != 5} | {6: 2.0, 9000: 3.0}
    assert log.rows() == expect
    # a change that comes late is older than what the levels hold
    log.feed([(6, 4, "U", 99.0), (5, 4999, "U", 98.0), (7, 7000, "U", 4.0)])
    expect[7] = 4.0
    assert log.rows() == expect
    m = log.compact()
    assert len(m.levels) == 2 and log.rows() == expect
    m = log.compact(full=True)
    assert [r.rows for r in m.runs] == [2000] and log.rows() == expect
    assert log.compact(full=True) == m


@pytest.mark.parametrize("small", [0, 100_000])
def test_null_keys_and_new_columns(spark, monkeypatch, small):
    monkeypatch.setattr(changes, "SMALL_ROWS", small)
    store = Store(spark, scratch_path(spark, "log"))
    spark.createDataFrame([(None, 1, "I"), (1, 2, "I")], "k int, seq int, op string").write.parquet(store.path("a"))
    spark.createDataFrame([(None, 3, "U", 7), (2, 4, "I", 8)], "k int, seq int, op string, extra int").write.parquet(store.path("b"))
    store.change(lambda m: Manifest(runs=(Run("a", 2, True), Run("b", 2))))
    got = changes.current(spark, store.target, ["k"], "seq").collect()
    assert sorted((r.k or 0, r.seq, r.extra) for r in got) == [(0, 3, 7), (1, 2, None), (2, 4, 8)]


def test_two_writers(spark):
    store = Store(spark, scratch_path(spark, "log"))
    tried = []

    def edit(m):
        tried.append(m.number)
        if len(tried) == 1:  # another writer is first
            Store(spark, store.target).change(lambda m: Manifest(runs=(*m.runs, Run("other", 1))))
        return Manifest(runs=(*m.runs, Run("own", 1)))

    assert [r.name for r in store.change(edit).runs] == ["other", "own"] and tried == [0, 1]
    with pytest.raises(FileNotFoundError):
        changes.current(spark, scratch_path(spark, "none"), ["k"], "seq")
