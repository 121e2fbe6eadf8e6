"""The searches deal blocks to a grid of tasks: nothing is broadcast, and every pair of blocks meets once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtrace.llm import exact_search, hard_negatives, vectors
from roomtrace.llm.exact_search import exact_top_k
from tests.llm.test_lines_vectors import brute_negatives


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def numbers(spark, n: int, scale: float, dims: int = 6):
    r = np.random.default_rng(n)
    held = [(k, [float(np.floor(c * scale)) for c in r.standard_normal(dims)]) for k in range(n)]
    held += [(n + k, held[k][1]) for k in range(0, n, 9)] + [(5, [float(scale)] * dims)]  # ties, and a repeated id
    return held, spark.createDataFrame(held, "vec_id long, embedding array<double>").repartition(5)


def brute_top(held, k: int, step: int):
    asked = {}
    for i, v in held:
        if i % step == 0:
            asked.setdefault(i, v)
    out = []
    for i, q in asked.items():
        best = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in held if j != i)[:k]
        out += [(i, rank, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_exact_search_broadcasts_nothing(spark):
    _, rows = numbers(spark, 60, 40)
    assert "Broadcast" not in plan(exact_top_k(rows, F.col("id") % 7 == 0, 5))


@pytest.mark.parametrize("cells, most", [(1, 1 << 24), (8, 1 << 24), (24, 1 << 24), (6, 1500)])
@pytest.mark.parametrize("n, scale", [(230, 40), (120, 1e6), (70, 3e15)])
def test_exact_search_over_a_grid(spark, monkeypatch, cells, most, n, scale):
    monkeypatch.setattr(exact_search, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(exact_search, "FIRST", 3)
    monkeypatch.setattr(vectors, "CELL_ASKED", most)
    monkeypatch.setattr(vectors, "CELL_HELD", 4 * most)
    held, rows = numbers(spark, n, scale)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", cells)
        found = exact_top_k(rows, F.col("id") % 7 == 0, 5)
        assert sorted(map(tuple, found.collect())) == brute_top(held, 5, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cells, asked, held", [(1, 9, 200), (25, 30_770, 615_384), (12, 0, 0), (200, 9_000_000, 180_000_000)])
def test_a_grid_sends_no_more_than_its_cells_need(spark, cells, asked, held):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", cells)
        down, across = vectors.grid(spark, asked, 400, held, 130)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert down * across >= cells and down * vectors.CELL_ASKED >= 400 * asked and across * vectors.CELL_HELD >= 130 * held
    if 400 * asked <= vectors.CELL_ASKED and held:
        assert across * asked * 400 + down * held * 130 <= 3 * math.sqrt(cells * asked * 400 * held * 130) + asked * 400 + held * 130


@pytest.mark.parametrize("down, across", [(1, 1), (1, 5), (3, 1), (3, 4)])
def test_every_pair_of_rows_meets_in_one_task(spark, down, across):
    asked = vectors.numbered(spark.range(0, 7, 1, 2).select(F.col("id").alias("q")), 2)
    held = vectors.numbered(spark.range(0, 23, 1, 3).select(F.col("id").alias("x")), 3)
    cells = vectors.meet(asked, held, down, across).withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).collect()
    pairs = [(a.q, b.x) for a in cells for b in cells if a.side == 0 and b.side == 1 and a.cell == b.cell]
    assert sorted(pairs) == [(q, x) for q in range(7) for x in range(23)]
    assert all(a.place < b.place for a in cells for b in cells if a.cell == b.cell and a.side < b.side)
    tasks = {r.cell: r.task for r in cells}
    assert len(set(tasks.values())) == len(tasks) and all(r.task == tasks[r.cell] for r in cells)


def test_a_cell_is_limited_in_bytes(spark):
    for wide in (1, 10, 100):
        down, across = vectors.grid(spark, 100_000, 400 * wide, 2_000_000, 130 * wide)
        assert down * vectors.CELL_ASKED >= 100_000 * 400 * wide and across * vectors.CELL_HELD >= 2_000_000 * 130 * wide


def test_smallest_type_keeps_every_number():
    for most, kind in ((127, "i1"), (128, "i2"), (-32768, "i2"), (40000, "i4"), (2**31, "f8"), (2**52 + 1, "f8"), (0.5, "f8")):
        x = np.array([[0.0, most], [1, -1]])
        held = vectors.smallest(x)
        assert held.dtype.str.endswith(kind) and (held == x).all()


# --- hard negatives ---------------------------------------------------------------


def labelled(spark, n: int, scale: float):
    r = np.random.default_rng(n)
    held = [(k, int(r.integers(3)), [float(c) for c in (r.standard_normal(9) + 0.7) * np.exp(-np.arange(9) / 4) * scale]) for k in range(n)]
    held += [(n + k, 1, held[k][2]) for k in range(0, n, 9)]  # ties
    return held, spark.createDataFrame(held, "vec_id long, label int, embedding array<double>").repartition(3)


def test_hard_negatives_broadcast_nothing(spark, monkeypatch):
    plans, write = [], hard_negatives.materialize
    monkeypatch.setattr(hard_negatives, "materialize", lambda rows, name: (plans.append(plan(rows)), write(rows, name))[1])
    _, rows = labelled(spark, 60, 1.0)
    plans.append(plan(hard_negatives.hard_negatives(rows, F.col("id") % 7 == 0)))
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("cells, most", [(1, 1 << 24), (24, 1 << 24), (6, 1500)])
@pytest.mark.parametrize("n, scale", [(230, 1.0), (120, 2e13)])
def test_hard_negatives_over_a_grid(spark, monkeypatch, cells, most, n, scale):
    monkeypatch.setattr(hard_negatives, "SHARD", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "TOGETHER", 3)
    monkeypatch.setattr(vectors, "CELL_ASKED", most)
    monkeypatch.setattr(vectors, "CELL_HELD", 4 * most)
    held, rows = labelled(spark, n, scale)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", cells)
        found = sorted(map(tuple, hard_negatives.hard_negatives(rows, F.col("id") % 10 == 0).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found and found == brute_negatives(held, lambda i: i % 10 == 0)


def test_windows_keep_the_first_rows_of_many_shards():
    r = np.random.default_rng(3)
    spans = [[(1, None, None), (2, -50, 40)], [(1, 10, 90)], [(1, 0, 0), (2, -200, 200), (3, 500, 600)]]
    for kind in (np.int64, object):
        windows, seen = hard_negatives.Windows(spans, 4), []
        for shard in range(6):
            ids, scores = np.arange(shard, 300, 6), r.integers(-100, 100, (3, 50))
            a, at = (v.ravel() for v in np.indices(scores.shape))
            seen += [(i, int(ids[x]), int(scores[i, x])) for i, x in zip(a, at)]
            w, place = windows.choose(0, 3, a, at, scores.ravel().astype(kind), ids)
            windows.add(w, ids[at[place]], scores.ravel().astype(kind)[place])
        got = [(int(windows.of[w]), int(windows.names[w]), int(i), int(s)) for w, i, s in zip(windows.window, windows.ids, windows.scores)]
        want = []
        for i, own in enumerate(spans):
            for name, low, high in own:
                best = sorted((-s, x) for j, x, s in seen if j == i and (low is None or s >= low) and (high is None or s <= high))[:4]
                want += [(i, name, x, -s) for s, x in best]
        assert got == want
