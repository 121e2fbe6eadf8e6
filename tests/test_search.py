"""Batch search against a plain loop, for many random thresholds."""

import random

import duckdb
import pytest

from roomtrace.functions.text import district_key
from roomtrace.operators import search as SE
from roomtrace.plans import skew
from pyspark.sql import functions as F

DISTRICTS = ["caugiay", "namtuliem", "bactuliem", "dongda", "", "hadong"]
ASKED = ["Cầu Giấy", "tu liem", "Từ Liêm!", None, "", "!!!", "a", "zzz", "ĐỐNG ĐA", "liem"]


def _data(seed, n_listings, n_requests):
    rng = random.Random(seed)
    listings = [
        (i, f"pr{i}", rng.choice(DISTRICTS), rng.choice([None, rng.randint(0, 60)]), rng.randint(1, 300) / 4,
         rng.choice([None, rng.randint(-2, 40)]))
        for i in range(n_listings)
    ]
    requests = [
        (i, rng.choice(ASKED), rng.choice([None, rng.randint(-3, 60)]),
         rng.choice([None, 0.0, -0.0, rng.randint(0, 80) / 1.0]), rng.choice([None, rng.randint(0, 40)]),
         rng.choice([None, 1, 5, 20, 21, 0]))
        for i in range(n_requests)
    ]
    return listings, requests


def _brute(listings, requests, keys):
    out = []
    for rid, _, price, area, days, limit in requests:
        limit = 5 if limit is None else limit
        if not 1 <= limit <= 20 or any(x is not None and x < 0 for x in (price, area, days)):
            continue
        hits = [
            x for x in listings
            if keys[rid] in x[2]
            and (price is None or (x[3] is not None and x[3] <= price))
            and (area is None or x[4] >= area)
            and (days is None or (x[5] is not None and x[5] <= days))
        ]
        hits.sort(key=lambda x: (x[5] is None, x[5] or 0, x[0]))
        out += [(rid, n, x[1]) for n, x in enumerate(hits[:limit], 1)]
    return sorted(out)


def _run(spark, listings, requests):
    ls = spark.createDataFrame(
        listings, "row_index bigint, id string, district_key string, price_vnd bigint, area_m2 double, days_old int")
    rq = spark.createDataFrame(
        requests, "request_id bigint, district string, max_price bigint, min_area double, max_days_old int, limit int")
    keys = {r.request_id: r.k for r in rq.select("request_id", district_key(F.coalesce("district", F.lit(""))).alias("k")).collect()}
    found = SE.search_batch(rq, ls, ["id"])
    return sorted((r.request_id, r["rank"], r.id) for r in found.collect()), _brute(listings, requests, keys), found


def test_search_batch_equals_loop(spark):
    got, want, found = _run(spark, *_data(11, 800, 250))
    assert got == want and len(got) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_hundred_thousand_thresholds_of_either_kind(spark, tmp_path):
    n = 100_000
    listings = spark.range(3000).selectExpr(
        "id AS row_index", "concat('pr', id) AS id", "concat('d', id % 3) AS district_key", "CAST(id * 7919 % 100003 AS bigint) AS price_vnd",
        "CAST(id * 104729 % 100019 AS double) / 8 AS area_m2", "CAST(id * 31 % 400 AS int) AS days_old")
    requests = spark.range(n).selectExpr(
        "id AS request_id", "concat('D', id % 4) AS district", "CAST(id * 7 % 100003 AS bigint) AS max_price", "CAST(id * 11 % 100019 AS double) / 8 AS min_area",
        "CAST(NULL AS int) AS max_days_old", "CAST(3 AS int) AS limit")
    assert requests.select("max_price").distinct().count() == requests.select("min_area").distinct().count() == n
    found = SE.search_batch(requests, listings, ["id"])
    listings.write.parquet(str(tmp_path / "l"))
    requests.write.parquet(str(tmp_path / "r"))
    want = duckdb.sql(f"""SELECT request_id, rank, id FROM (
        SELECT r.request_id, l.id, row_number() OVER (PARTITION BY r.request_id ORDER BY l.days_old, l.row_index) AS rank
        FROM '{tmp_path}/r/*.parquet' r JOIN '{tmp_path}/l/*.parquet' l ON lower(r.district) = l.district_key AND l.price_vnd <= r.max_price AND l.area_m2 >= r.min_area)
        WHERE rank <= 3""").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > n


def test_no_step_of_the_search_gathers_thresholds(spark, monkeypatch):
    frame = type(spark.range(0))

    def small(self, plain=frame.collect):
        rows = plain(self)
        assert len(rows) <= 2 and self.columns == ["_kind", "n"]  # how many there are of each kind
        return rows

    monkeypatch.setattr(frame, "collect", small)
    listings, requests = _data(12, 50, 20)
    ls = spark.createDataFrame(listings, "row_index bigint, id string, district_key string, price_vnd bigint, area_m2 double, days_old int")
    rq = spark.createDataFrame(requests, "request_id bigint, district string, max_price bigint, min_area double, max_days_old int, limit int")
    plan = SE.search_batch(rq, ls, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_batch_with_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew.lookup, "__defaults__", ("left", 5))
    got, want, _ = _run(spark, *_data(15, 300, 120))
    assert got == want


@pytest.mark.parametrize("prices,areas", [(False, False), (True, False), (False, True)])
def test_requests_without_thresholds(spark, prices, areas):
    listings, requests = _data(13, 200, 40)
    requests = [(a, b, c if prices else None, d if areas else None, e, f) for a, b, c, d, e, f in requests]
    got, want, _ = _run(spark, listings, requests)
    assert got == want


def test_no_requests(spark):
    listings, _ = _data(14, 20, 0)
    got, want, _ = _run(spark, listings, [(1, None, -1, None, None, 5)])
    assert got == want == []
