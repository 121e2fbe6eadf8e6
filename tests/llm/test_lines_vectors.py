"""Line dedup, hard negatives and whitening against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtrace.llm import hard_negatives as hn
from roomtrace.llm import line_dedup, whitening
from roomtrace.llm.exact_search import exact_top_k
from roomtrace.llm.queries import QUERIES, SQL
from tests.compare import connect, difference
from tests.llm.test_texts import empty_docs, odd_docs


def brute_lines(rows, least_chars=20, least_documents=3):
    holders = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = lambda k: i is not None and len(holders.get(k, ())) >= least_documents and max(holders[k]) != i
        kept = [x for x in lines if not gone(key(x))]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def dedup(docs, **more):
    return sorted((str(r.doc), r.n_lines, r.n_dropped, hashlib.sha256(r.kept).hexdigest()) for r in line_dedup.dedup_lines(docs, **more).collect())


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    yield lambda n: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("seed, batch", [(1, 3), (2, 7), (3, 10_000)])
def test_lines_of_random_documents(spark, small_batches, seed, batch):
    small_batches(batch)
    r = random.Random(seed)
    lines = [f"line number {k} of all of them" for k in range(12)] + ["short", "", "  The line of which there are Many  \r", "é" * 20, "é" * 19, "É" * 20, "\tthe line of which there are many"]
    rows = [(r.randrange(40) if k % 3 else k, "\n".join(r.choices(lines, weights=[1] * 17 + [6, 6], k=r.randrange(9)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert dedup(docs) == brute_lines(rows)


def test_a_line_that_fills_partitions_is_split(spark, small_batches):
    small_batches(11)
    rows = [(k, "this line is in every document\n" * (1 + k % 4) + f"this one is only in document {k}") for k in range(300)]
    rows += [(500, "this line is in every document\n" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert dedup(docs) == brute_lines(rows)
    assert dedup(docs, least_documents=2) == brute_lines(rows, least_documents=2)
    assert dedup(docs, least_documents=400) == brute_lines(rows, least_documents=400)


def test_lines_of_odd_rows(spark):
    odd = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert dedup(odd) == brute_lines(rows)
    assert dedup(odd.withColumnsRenamed({"lang": "position", "source": "doc"} if "lang" in odd.columns else {})) == brute_lines(rows)
    assert dedup(empty_docs(spark)) == []
    texts = spark.createDataFrame([("a", "x" * 30, 1), ("b", "X" * 30, 2), ("c", " " + "x" * 30, 3), (None, "x" * 30, 4), (None, None, 5)], "doc_id string, text string, h1 long")
    assert dedup(texts) == brute_lines([(r.doc_id, r.text) for r in texts.collect()])


def test_line_key_follows_the_contract():
    assert line_dedup.line_key(b" \t\x0b\x0c\r ABz\xc3\x89 \x85 ") == b"abz\xc3\x89 \x85"


def test_bitmaps_keep_lines_behind_their_end(spark):
    drops = spark.createDataFrame([(1, 5, 2), (1, 5, 8)], "doc long, mark long, position int")
    row = line_dedup.keep_bitmaps(drops).first()
    text = b"\n".join(b"%d" % k for k in range(30))
    assert line_dedup.kept_lines(text, row.kept) == ([b"%d" % k for k in range(30) if k not in (2, 8)], 30)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_line_dedup"])
def test_query_is_its_sql(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), sf_dir, QUERIES[name], SQL[name]) is None


# --- hard negatives ---------------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=10, scale=256):
    held = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v):
            whole = [int(np.floor(c * scale)) for c in v]
            if all(abs(c) < 1 << 53 for c in whole):
                held.append((i, label, whole))
    out = []
    for a, label, q in held:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, own == label) for i, own, v in held if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            found = [(i, -t) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            shown = lambda score: max(-(1 << 63), min((1 << 63) - 1, score))
            out += [(a, p, rank, i, shown(-s), shown(t)) for rank, (i, t) in enumerate(found, 1)]
    return sorted(out)


def mined(rows, is_anchor, **more):
    return sorted(map(tuple, hn.hard_negatives(rows, is_anchor, **more).collect()))


VECTORS = "vec_id long, label int, embedding array<double>, id string, x int"


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 3e6), (3, 2e13)])
def test_hard_negatives_of_random_vectors(spark, monkeypatch, seed, scale):
    monkeypatch.setattr(hn, "SHARD", 50)
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "TOGETHER", 3)
    r = np.random.default_rng(seed)
    centre = r.standard_normal(20) * (np.arange(20) < 9)
    data = [(k % 290, int(r.integers(3)), [float(c) for c in (centre * r.integers(2) + r.standard_normal(20) * np.exp(-np.arange(20) / 4)) * scale], "z", 0) for k in range(300)]
    data += [(300 + k, 1, data[k][2], "z", 0) for k in range(20)]  # ties
    rows = spark.createDataFrame(data, VECTORS).repartition(3)
    want = brute_negatives([d[:3] for d in data], lambda i: i % 10 == 0)
    assert mined(rows, F.col("id") % 10 == 0) == want and want
    assert mined(rows, F.col("id") % 10 == 0, positives=2, negatives=3) == brute_negatives([d[:3] for d in data], lambda i: i % 10 == 0, 2, 3)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, k % 2, [1.0 + k % 5, 0.5 * (k % 3), 0.0], "z", 0) for k in range(30)]
    odd = [(None, 1, [1.0, 1.0, 1.0]), (40, None, [1.0, 1.0, 1.0]), (41, 1, None), (42, 0, [1.0, None, 1.0]), (43, 0, [nan, 1.0, 1.0]), (44, 0, [inf, 1.0, 1.0]), (45, 1, [0.0, 0.0, 0.0]), (46, 1, []), (47, 0, [1e300, 1.0, 1.0]), (48, 0, [-1.0, -1.0, 0.0])]
    data = good + good[:4] + [(*o, "z", 0) for o in odd]
    rows = spark.createDataFrame(data, VECTORS)
    assert mined(rows, F.col("id") % 3 == 0) == brute_negatives([d[:3] for d in data], lambda i: i % 3 == 0)
    assert mined(rows.limit(0), F.col("id") % 3 == 0) == []
    assert mined(rows.filter("vec_id = 3"), F.col("id") % 3 == 0) == []
    assert mined(rows, F.lit(False)) == []


@pytest.mark.parametrize("share", [-2.0, 0.0, 0.3, 0.6, 0.9])
def test_pairs_above_a_threshold_are_complete(share):
    r = np.random.default_rng(7)
    x = np.floor(r.standard_normal((200, 30)) * np.exp(-np.arange(30) / 5) * 256)
    q, rest, q_rest = x[:9], hn.remaining_norms(x), hn.remaining_norms(x[:9])
    least = share * q_rest[:, 0] * rest[:, 0].max()
    depth = (rest[:, :-1] >= (least / q_rest[:, 0]).min() * (1 - hn.SLACK)).sum(axis=1)
    order = np.argsort(-depth, kind="stable")
    x, rest, depth = x[order], rest[order], depth[order]
    ends = np.array([(depth > k).sum() for k in range(4)])
    assert share < 0.5 or ends[-1] < 200
    lists = [x[:, k : k + hn.WIDTH] for k in range(0, 30, hn.WIDTH)]
    a, row, score = hn.pairs_above(q, q_rest, least, lists, rest, ends)
    found = {(i, j): s for i, j, s in zip(a, row, score) if s >= least[i]}
    assert found == {(i, j): q[i] @ x[j] for i in range(9) for j in range(200) if q[i] @ x[j] >= least[i]}


@pytest.mark.parametrize("scale, n", [(1, 90), (5e8, 300), (3e15, 70), (40, 15)])
def test_exact_search_at_any_size(spark, scale, n):
    r = np.random.default_rng(4)
    held = [(k // 2 if k < 8 else k, [float(np.floor(c * scale)) for c in r.standard_normal(5)]) for k in range(n)] + [(n, [float(scale)] * 5), (n + 1, [2.0**60] * 5)]
    rows = spark.createDataFrame(held, "vec_id long, embedding array<double>").repartition(2)
    asked = {}
    for i, v in held[:-1]:
        if i % 7 == 0 and i > 7:
            asked[i] = v
    shown = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for i, q in asked.items():
        best = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in held[:-1] if j != i)[:20]
        want += [(i, rank, j, shown(-s)) for rank, (s, j) in enumerate(best, 1)]
    got = exact_top_k(rows, (F.col("id") % 7 == 0) & (F.col("id") > 7), 20)
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- whitening ------------------------------------------------------------------------


def brute_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n = len(x)
    away = n * x - x.sum(axis=0)
    centred = away / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    real = values > 1e-12 * values[0]
    return n, (away * away).sum(axis=1), centred, values[real], basis[:, real], np.trace(centred.T @ centred / n)


def whitened(rows, **more):
    found = whitening.whiten(rows, **more).toPandas()
    return found.sort_values(["id", "component"]).reset_index(drop=True)


def check_whitening(spark, vectors, k=8, exact_vectors=True):
    rows = spark.createDataFrame([(i, [float(c) for c in v], "z") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component string").repartition(3)
    found = whitened(rows, components=k)
    n, deviation, centred, values, basis, trace = brute_whitening(vectors, k)
    c = len(values)
    assert len(found) == n * c and set(found.n) == {n}
    assert found.deviation.tolist() == np.repeat(deviation, c).tolist()
    ours = found.whitened.to_numpy().reshape(n, c)
    assert np.allclose(found.explained.to_numpy()[:c], values / trace, rtol=1e-10)
    assert found.identity_error.max() < 1e-8 and np.allclose(ours.T @ ours / n, np.eye(c), atol=1e-8)
    if exact_vectors:
        theirs = centred @ basis / np.sqrt(values)
        sign = np.sign((ours * theirs).sum(axis=0))
        assert np.abs(ours - theirs * sign).max() < 1e-7
    return ours


def test_whitening_of_random_vectors(spark):
    r = np.random.default_rng(1)
    check_whitening(spark, r.standard_normal((300, 12)))
    check_whitening(spark, r.standard_normal((300, 40)) * np.exp(-np.arange(40) / 3), k=5)
    check_whitening(spark, r.standard_normal((5, 12)) + 7)  # four components


def test_components_of_equal_variance_are_all_found(spark):
    axes = np.vstack([np.eye(6), -np.eye(6)])
    ours = check_whitening(spark, np.vstack([axes, axes]), k=6, exact_vectors=False)
    assert ours.shape == (24, 6)
    scaled = np.vstack([np.diag([8, 8, 8, 2, 2, 1]), -np.diag([8, 8, 8, 2, 2, 1])])
    assert check_whitening(spark, scaled, k=4, exact_vectors=False).shape == (12, 4)


def test_search_goes_on_outside_of_found_vectors():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((60, 30)))[0]
    turn = np.linalg.qr(r.standard_normal((30, 30)))[0]
    values = np.concatenate([[9, 9, 9, 5, 5], np.linspace(1, 0.1, 25)])
    x, passes = q * values @ turn.T, []

    def product(c, earlier):
        passes.append(1)
        p = x @ c
        return p @ p, (x @ earlier).T @ p, x.T @ p

    found, vectors = whitening.leading_pairs(product, 30, 5, 9.0)
    assert np.allclose(found, values[:5], rtol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ vectors, axis=0), values[:5], rtol=1e-10)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [0.1 * k, float(k % 3), -0.5]) for k in range(9)]
    odd = [(50, None), (51, [1.0, None, 1.0]), (52, [nan, 0.0, 0.0]), (53, [inf, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    more = [(None, [3.0, 1.0, -0.5]), (2, [0.2, 2.0, -0.5])]
    rows = spark.createDataFrame([(*x, 1) for x in good + odd + more], "vec_id long, embedding array<double>, n int")
    found = whitening.whiten(rows).toPandas()
    assert len(found) == 11 * 2 and set(found.n) == {11} and found.id.isna().sum() == 2
    n, deviation, _, values, _, trace = brute_whitening([v for _, v in good + more], 8)
    assert sorted(found.deviation) == sorted(np.repeat(deviation, 2)) and np.allclose(sorted(set(found.explained.round(12))), sorted((values / trace).round(12)))
    assert whitening.whiten(rows.limit(0)).collect() == []
    assert whitening.whiten(rows.filter("vec_id = 3")).collect() == []


def test_deviations_beyond_a_long_are_null_and_others_exact(spark):
    vectors = [[float(k * 10**9)] for k in range(-3, 4)] + [[float(10**12)]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = [1024 * int(v[0]) + 100_000 for v in vectors]
    want = [(len(x) * c - sum(x)) ** 2 for c in x]
    assert [r.deviation for r in whitening.whiten(rows).orderBy("id").collect()] == [w if w < 1 << 63 else None for w in want]


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    found = whitening.op13_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    n, deviation, centred, values, basis, trace = brute_whitening([r.embedding for r in rows], 8)
    theirs = centred @ basis / np.sqrt(values)
    ours = found.whitened.to_numpy().reshape(n, 8)
    assert np.abs(ours - theirs * np.sign((ours * theirs).sum(axis=0))).max() < 1e-9
    assert found.deviation.tolist() == np.repeat(deviation, 8).tolist()
    assert np.allclose(found.explained.to_numpy()[:8], values / trace) and found.identity_error.max() < 1e-10
