import os
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.operators.incremental import Conflict, Ledger, changed_since_success, merge, outside, subtract

T0 = datetime(2025, 1, 1)
LISTING = "run_id int, path string, size long, mtime long, seen_at timestamp, status string"
intervals = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)).map(lambda t: (min(t), max(t))), max_size=6)


@settings(max_examples=200, deadline=None)
@given(intervals, intervals)
def test_intervals_are_sets(a, b):
    points = lambda xs: {p for lo, hi in xs for p in range(lo, hi + 1)}
    assert points(merge(a)) == points(a)
    assert points(subtract(a, b)) == points(a) - points(b)
    m = merge(a)
    assert all(x[1] + 1 < y[0] for x, y in zip(m, m[1:], strict=False))


def brute(rows, ok):
    seen = {}
    for r, p, s, m, at, *_ in rows:
        if None not in (r, p, s, m) and ((r, p) not in seen or (at, s, m) > seen[r, p]):
            seen[r, p] = (at, s, m)
    last, out = {}, set()
    for r in sorted({r for r, _ in seen}):
        now = {p: v[1:] for (rr, p), v in seen.items() if rr == r}
        if r in ok:
            out |= {(r, p) for p, v in now.items() if last.get(p) != v}
            if ok[r]:
                last |= now
    return out


def test_changes_match_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = []
    for r in range(1, 8):
        for p in "abcdefgh":
            for _ in range(rng.choice((0, 1, 1, 2))):
                rows.append((r, p, rng.choice((1, 2, None)), rng.choice((5, 6)), T0 + timedelta(seconds=rng.randint(0, 5)), "clash"))
    rows += [(None, "a", 1, 1, T0, "x"), (3, None, 1, 1, T0, "x"), (9, "z", 1, 1, T0, "x")]  # run 9 is unknown
    status = {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: False}
    runs = spark.createDataFrame([(r, "ok" if s else "failed", "extra") for r, s in status.items()], "run_id int, status string, path string")
    got = {tuple(x) for x in changed_since_success(spark.createDataFrame(rows, LISTING), runs).select("run_id", "path").collect()}
    assert got == brute(rows, status)
    assert changed_since_success(spark.createDataFrame([], LISTING), runs).count() == 0


def values(ledger):
    return sorted(r.v for r in ledger.output().collect())


def test_ledger_survives_failure_and_late_rows(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([(i, f"r{i}") for i in (1, 2, 3, 7, 8)], "seq long, v string")
    ledger = Ledger(spark, root)
    assert ledger.output() is None and ledger.process(rows.limit(0)) is None
    assert ledger.process(rows) == 1
    assert ledger.done == [(1, 3), (7, 8)] and ledger.process(rows) is None
    # a batch that wrote output but died before its commit leaves nothing behind
    spark.createDataFrame([(99, "lost")], "seq long, v string").write.parquet(f"{root}/data/died")
    again = Ledger(spark, root)
    assert again.done == ledger.done and again.output().count() == 5
    late = rows.unionAll(spark.createDataFrame([(4, "late"), (9, "new"), (None, "no number")], "seq long, v string"))
    assert sorted(r.seq for r in again.pending(late).collect()) == [4, 9]
    again.process(late)
    assert again.done == [(1, 4), (7, 9)]
    assert values(Ledger(spark, root)) == ["late", "new", "r1", "r2", "r3", "r7", "r8"]
    assert again.clean(older_than_s=3600) == [] and again.clean(older_than_s=-60) == ["data/died"]
    assert values(again) == ["late", "new", "r1", "r2", "r3", "r7", "r8"]


def test_two_writers_keep_every_row_once(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    a, b = Ledger(spark, root), Ledger(spark, root)
    one = spark.createDataFrame([(1, "r1"), (2, "r2")], "seq long, v string")
    both = one.unionAll(spark.createDataFrame([(3, "r3")], "seq long, v string"))
    todo = b.pending(both)
    a.process(one)
    with pytest.raises(Conflict):
        b.commit(todo)
    assert b.done == [] and b.batch == 0 and values(Ledger(spark, root)) == ["r1", "r2"]
    # process() starts again from the new state; the other writer commits in between
    other = Ledger(spark, root)
    late = spark.createDataFrame([(9, "r9")], "seq long, v string")
    went = []

    def between():
        if not went:
            went.append(other.process(late))

    assert b.process(both, before_commit=between) == 3
    assert values(Ledger(spark, root)) == ["r1", "r2", "r3", "r9"] and b.done == [(1, 3), (9, 9)]
    assert len(os.listdir(tmp_path / "ledger" / "data")) == 3 and os.listdir(tmp_path / "ledger" / "staged") == []


@pytest.mark.parametrize("step", ["isEmpty", "_commit", "merged", "_publish", "after"])
def test_a_crash_at_any_step_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step):
    from codexmill.operators import incremental

    root = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([(1, "r1"), (5, "r5")], "seq long, v string")
    Ledger(spark, root).process(rows.where("seq = 1"))

    def crash(*_, **__):
        raise KeyboardInterrupt

    ledger = Ledger(spark, root)
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        if step == "isEmpty":
            m.setattr(ledger, "pending", crash)
        elif step == "merged":
            m.setattr(incremental, "merged", crash)
        elif step == "after":
            publish = ledger._publish
            m.setattr(ledger, "_publish", lambda *x: publish(*x) and crash())
        else:
            m.setattr(ledger, step, crash)
        ledger.process(rows)  # after: it dies right behind the commit, and the batch must stay
    after = Ledger(spark, root)
    assert after.done == ([(1, 1), (5, 5)] if step == "after" else [(1, 1)])
    after.process(rows)
    assert values(after) == ["r1", "r5"] and after.done == [(1, 1), (5, 5)]


def test_a_growing_source_counts_only_what_was_written(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.createDataFrame([(1, "r1")], "seq long, v string").write.parquet(source)
    ledger, table = Ledger(spark, f"file://{tmp_path}/ledger"), lambda: spark.read.schema("seq long, v string").parquet(source)

    def grows(rows):
        spark.createDataFrame([(2, "r2")], "seq long, v string").write.mode("append").parquet(source)
        return rows

    ledger.process(table(), grows)
    assert ledger.done == [(1, 1)]
    ledger.process(table())
    assert values(ledger) == ["r1", "r2"]


def test_many_intervals_are_kept_beside_the_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    odd = spark.range(1, 4_000_001, 4000).select(F.col("id").alias("seq"), F.lit("x").alias("v"))
    ledger.process(odd)
    assert ledger.count == 1000 and len(ledger.done) == 64
    more = odd.unionAll(spark.range(2, 1_000_000, 4000).select("id", F.lit("y"))).unionAll(spark.createDataFrame([(-7, "z")], "seq long, v string"))
    assert Ledger(spark, ledger.root).pending(more).count() == 251
    ledger.process(more)
    assert ledger.count == 1001 and ledger.output().count() == 1251 and ledger.pending(more).count() == 0


@settings(max_examples=12, deadline=None)
@given(intervals, st.lists(st.integers(0, 40), max_size=8), st.sampled_from([2, 20, None]))
def test_outside_is_subtraction(spark, taken, numbers, width):
    rows = spark.createDataFrame([(n, "x") for n in numbers] + [(None, "no number")], "seq long, __c string")
    got = outside(rows, spark.createDataFrame(taken, "lo long, hi long"), "seq", width=width)
    assert got.columns == rows.columns
    assert sorted(r.seq for r in got.collect()) == sorted(n for n in numbers if not any(lo <= n <= hi for lo, hi in taken))


def test_merged_ranges(spark, monkeypatch):
    from codexmill.operators import incremental

    monkeypatch.setattr(incremental, "MERGE_ROWS", 100)
    points = spark.range(0, 1000).selectExpr("id lo", "id hi").where("lo % 250 <> 0")
    got = sorted((r.lo, r.hi) for r in incremental.merged(points, 1000).collect())
    assert merge(got) == [(1, 249), (251, 499), (501, 749), (751, 999)] and sum(b - a + 1 for a, b in got) == 996
