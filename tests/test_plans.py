"""Building blocks for skewed data, and the shape of physical plans."""

import glob
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.operators import bookings as BK
from roomtrace.operators import listings as LS
from roomtrace.operators import search as SE
from roomtrace.plans import prefix, ranges, skew
from roomtrace.sources.listings import read_normalized, write_listings
from roomtrace.plans.scratch import scratch_dir
from roomtrace.sources.by_id import ListingsById, known_listings, write_by_id
from roomtrace.sources.ledger import empty_ledger


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_with_hot_and_null_keys(spark):
    rng = random.Random(1)
    many = [(i, "hot" if i % 3 else (None if i % 7 == 0 else f"k{rng.randint(0, 40)}")) for i in range(3000)]
    unique = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)]
    left = spark.createDataFrame(many, "i int, k string")
    right = spark.createDataFrame(unique, "k string, v int")
    for how in ("left", "inner"):
        got = skew.lookup(left, right, ["k"], ["i"], how, hot_rows=100).select("i", "k", "v").collect()
        want = left.join(right, "k", how).select("i", "k", "v").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_hot_key_is_spread_over_tasks(spark, monkeypatch):
    many = spark.range(9000).select("id", (F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))).alias("k"))
    unique = spark.range(-1, 9000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    seen = {}

    def capture(self, other, on, how):
        if "_salt" in self.columns:
            seen["parts"] = self.where("k = -1").select("_salt").distinct().count()
        return plain(self, other, on, how)

    plain = type(many).join
    monkeypatch.setattr(type(many), "join", capture)
    joined = skew.lookup(many, unique, ["k"], ["id"], hot_rows=1000)
    assert seen["parts"] == 3 and joined.where("v = 1").count() == 9000


def test_every_hot_key_is_found_with_its_parts(spark):
    df = spark.range(200_000).select((F.col("id") % 5000).alias("k"))
    assert skew.hot_keys(df, ["k"], hot_rows=1).count() == 5000
    assert {r["_parts"] for r in skew.hot_keys(df, ["k"], hot_rows=15).collect()} == {3}
    assert skew.hot_keys(df, ["k"], hot_rows=41).count() == 0


def _gappy(spark, monkeypatch, parts):
    """Rows of a long key and short ones, with gaps of thousands, over many partitions."""
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, *c, plain=type(spark.range(0)).repartitionByRange: plain(self, parts, *c))
    rng = random.Random(2)
    rows = [("a", t * 5000 + rng.randint(0, 4000), rng.choice([0, 1, None, 3])) for t in range(400)]
    rows += [(k, t, rng.choice([0, 1, None])) for k in "bcd" for t in sorted(rng.sample(range(10**9), 30))] + [("e", -3, 7)]
    rng.shuffle(rows)
    return sorted(rows, key=lambda r: r[:2]), spark.createDataFrame(rows, "k string, t bigint, x int").repartition(5)


@pytest.mark.parametrize("parts", [1, 13, 60])
def test_sums_and_last_values_along_an_order_with_gaps(spark, monkeypatch, parts):
    rows, df = _gappy(spark, monkeypatch, parts)
    ordered = prefix.placed(df, ["k"], ["t"])
    assert ordered.select("_part").distinct().count() == parts
    got = {(r.k, r.t): (r.s, r.v) for r in prefix.last_known(prefix.running_sum(ordered, ["k"], F.coalesce("x", F.lit(0)), "s"), ["k"], F.col("x"), "v").collect()}
    sums, last, want = {}, {}, {}
    for k, t, x in rows:
        sums[k] = sums.get(k, 0) + (x or 0)
        last[k] = last.get(k) if x is None else x
        want[k, t] = (sums[k], last[k])
    assert got == want
    # no window group holds more than one partition's share of a key
    assert parts == 1 or ordered.groupBy("k", "_part").count().agg(F.max("count")).first()[0] < 400


def test_a_sum_over_all_rows_needs_no_constant_key(spark, monkeypatch):
    rows, df = _gappy(spark, monkeypatch, 17)
    got = prefix.running_sum(prefix.placed(df, [], ["t", "k"]), [], F.lit(1), "n")
    assert "SinglePartition" not in physical(got) and "Window [" in physical(got)
    assert [r.n for r in got.orderBy("t", "k").collect()] == list(range(1, len(rows) + 1))


def test_trailing_across_stretches(spark):
    rows = [(k, p) for k in "ab" for p in range(100) if (p * 7) % 5]
    df = spark.createDataFrame(rows, "k string, p bigint")
    got = skew.trailing(df, ["k"], "p", 10, {"seen": F.collect_list("p")}, chunk=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert sorted(r.seen) == [p for k, p in rows if k == r.k and r.p - 10 <= p < r.p]


def test_blocks_cover_exactly_the_ranks_below(spark):
    n = 13
    levels = ranges.levels_for(n)
    counts = spark.range(n + 1).select(
        F.col("id").alias("n"), F.explode(ranges.blocks_below(F.col("id"), levels)).alias("b"))
    ranks = spark.range(n + 1).select(
        F.col("id").alias("r"), F.explode(ranges.blocks_of_rank(F.col("id"), levels)).alias("b"))
    pairs = sorted((r.n, r.r) for r in counts.join(ranks, "b").collect())
    assert pairs == [(c, r) for c in range(n + 1) for r in range(c)]


def _listings(spark):
    return spark.range(2000).select(
        F.col("id").alias("row_index"), F.concat(F.lit("d"), F.col("id") % 9).alias("district_key"),
        (F.col("id") * 1000).alias("price_vnd"), (F.col("id") % 50).cast("double").alias("area_m2"),
        (F.col("id") % 30).cast("int").alias("days_old"))


def test_search_is_a_top_k_with_pushed_filters(spark):
    path = scratch_dir(spark, "t")
    _listings(spark).write.parquet(path)
    plan = physical(LS.search(spark.read.parquet(path), "d3", 1_500_000, 10.0, 7))
    assert "TakeOrderedAndProject" in plan
    assert "LessThanOrEqual(price_vnd,1500000)" in plan and "GreaterThanOrEqual(area_m2,10.0)" in plan
    assert "StringContains(district_key,d3)" in plan


def test_top_k_prunes_before_the_shuffle(spark):
    plan = physical(skew.top_k(_listings(spark), ["district_key"], LS.recency(), 20))
    assert plan.count("WindowGroupLimit") == 2


def test_listing_files_are_clustered_and_skipped(spark):
    path = scratch_dir(spark, "t")
    rows = spark.range(40_000).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 4 == 0, "popular").when(F.col("id") == 1, "").otherwise(F.format_string("k%05d", F.col("id"))).alias("district_key"))
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in read_schema()}
    write_listings(rows.select(*[F.col(n) if n in rows.columns else m for n, m in missing.items()]), path)
    back = read_normalized(spark, path)
    assert back.count() == 40_000 and back.where("district_key = ''").count() == 1
    # 30,001 keys in as many files as there are partitions, each with a span of its own
    files = sorted(glob.glob(f"{path}/*.parquet"))
    spans = []
    for file in files:
        meta = pq.ParquetFile(file).metadata
        stats = [meta.row_group(g).column(meta.schema.names.index("district_key")).statistics for g in range(meta.num_row_groups)]
        spans.append((min(s.min for s in stats), max(s.max for s in stats)))
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    one = read_normalized(spark, path, "K00 017!")
    assert [r.row_index for r in one.collect()] == [17]
    plan = physical(one)
    assert "GreaterThanOrEqual(district_key,k00017)" in plan and "LessThanOrEqual(district_key,k00017)" in plan
    assert read_normalized(spark, path, "popular").count() == 10_000 and read_normalized(spark, path, "nowhere").count() == 0


def read_schema():
    from roomtrace.sources.listings import LISTING_SCHEMA

    return LISTING_SCHEMA.fields


def test_first_per_link_combines_before_the_shuffle(spark):
    df = _listings(spark).withColumn("url", F.lit("x"))
    plan = physical(LS.dedup_by_link(df))
    assert "partial_min(" in plan and "Window" not in plan


def test_normalize_reads_only_needed_columns(spark, sf_dir):
    from catalog import fixtures as X

    plan = physical(LS.normalize(X.raw_listings(spark, sf_dir), X.NOW).select("id", "price_vnd"))
    scanned = plan[plan.index("ReadSchema"):]
    assert all(c in scanned for c in (K.COL_LINK, K.COL_PRICE, K.COL_AREA))
    assert not any(c in scanned for c in (K.COL_TITLE, K.COL_DESCRIPTION, K.COL_POSTED, K.COL_ADDRESS))
    assert "Exchange" not in plan


def test_duplicates_leave_without_moving_whole_rows(spark):
    path, rng = scratch_dir(spark, "t"), random.Random(8)
    rows = [(i, rng.choice(["", "hot", "hot", f"u{rng.randint(0, 60)}"]), f"pr{rng.randint(0, 90)}", "wide " * 50) for i in range(600)]
    spark.createDataFrame(rows, "row_index bigint, url string, id string, description string").repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    first, last = {}, {}
    for i, url, id_, _ in rows:
        first.setdefault(url or i, i)
        last[id_] = i
    for found, want in ((LS.dedup_by_link(df), first), (LS.latest_by_id(df), last)):
        assert found.columns == df.columns and sorted(r.row_index for r in found.collect()) == sorted(want.values())
        plan = physical(found)
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "HashAggregate" in plan
        exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "description" in line]
        assert exchanged == []


def test_lookups_read_only_the_folders_they_ask_for(spark):
    path = scratch_dir(spark, "by_id")
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in read_schema()}
    rows = spark.range(4000).select(F.col("id").alias("row_index"), F.format_string("pr%d", F.col("id") % 3000).alias("id"), F.format_string("t%d", F.col("id")).alias("title"))
    rows = rows.select(*[F.col(n) if n in rows.columns else m for n, m in missing.items()])
    write_by_id(rows, path, folders=32)
    table = ListingsById(spark, path, folders=32)
    assert table.rows().count() == 3000
    asked = spark.createDataFrame([("pr5",), ("pr5",), ("pr2999",), ("nowhere",), (None,)], "id string")
    found = table.of(asked, ["id", "title"])
    assert sorted(map(tuple, found.collect())) == [("pr2999", "t2999"), ("pr5", "t3005")]
    plan = physical(found)
    folders = re.search(r"PartitionFilters: \[.*?folder#\d+ (?:IN \(([^)]*)\)|= (\d+))", plan)
    assert folders and len((folders[1] or folders[2]).split(",")) <= 3
    assert sorted(map(tuple, known_listings(rows, asked, ["id", "title"]).collect())) == [("pr2999", "t2999"), ("pr5", "t3005")]


def test_details_and_bookings_agree_over_either_layout(spark):
    path = scratch_dir(spark, "by_id")
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in read_schema()}
    rows = spark.range(300).select(F.col("id").alias("row_index"), F.format_string("pr%d", F.col("id") % 200).alias("id"), F.format_string("t%d", F.col("id")).alias("title"))
    rows = rows.select(*[F.col(n) if n in rows.columns else m for n, m in missing.items()])
    write_by_id(rows, path, folders=8)
    requests = spark.range(500).selectExpr(
        "id AS request_id", "concat(' pr', id * 7 % 260, ' ') AS listing_id", "'2026-07-28' AS date", "'09:00' AS slot", "'n' AS name",
        "TIMESTAMP_NTZ'2026-07-27 08:00:00' AS requested_at")
    answers = [
        (sorted(map(str, SE.details_batch(requests.select("request_id", "listing_id"), x).select("request_id", "status", "title").collect())),
         sorted(map(str, BK.adjudicate(requests, x, empty_ledger(spark), "2026-07-27").collect())))
        for x in (rows, ListingsById(spark, path, folders=8))
    ]
    assert answers[0] == answers[1] and "status=404" in str(answers[0]) and "status=201" in str(answers[0])


def _no_small_joins(spark):
    """As with tables too large for the optimizer's own broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    return lambda: spark.conf.set(name, before)


def test_few_losers_leave_without_moving_whole_rows_at_any_size(spark, monkeypatch):
    path = scratch_dir(spark, "t")
    spark.range(600).selectExpr("id AS row_index", "concat('u', id % 590) AS url", "repeat('wide ', 50) AS description").write.parquet(path)
    reset = _no_small_joins(spark)
    try:
        found = LS.dedup_by_link(spark.read.parquet(path))
        exchanged = [line for line in physical(found).splitlines() if "Exchange hashpartitioning(row_index" in line]
        assert exchanged == [] and sorted(r.row_index for r in found.collect()) == list(range(590))
        # many of them: rows are dealt by index, but not sorted
        monkeypatch.setattr(LS, "FEW_ROWS", 5)
        found = LS.dedup_by_link(spark.read.parquet(path))
        plan = physical(found)
        assert "ShuffledHashJoin" in plan and "Sort [row_index" not in plan and sorted(r.row_index for r in found.collect()) == list(range(590))
    finally:
        reset()


def test_a_small_table_is_looked_up_where_the_rows_are(spark, monkeypatch):
    many = spark.range(20_000).selectExpr("id", "id % 300 AS k", "repeat('wide ', 20) AS text")
    unique = spark.range(200).selectExpr("id AS k", "id * 2 AS v")
    reset = _no_small_joins(spark)
    try:
        found = skew.lookup(many, unique, ["k"], ["id"])
        plan = physical(found)
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert found.count() == 20_000 and found.where("v = k * 2").count() == found.where("k < 200").count()
        monkeypatch.setattr(skew, "SMALL_ROWS", 100)
        again = skew.lookup(many, unique, ["k"], ["id"])
        assert sorted(map(str, again.select(found.columns).collect())) == sorted(map(str, found.collect()))
    finally:
        reset()


def test_derived_inputs_spread_keys_and_not_the_rows_made_from_them(spark, sf_dir, monkeypatch):
    from catalog import fixtures as X

    seen = []
    monkeypatch.setattr(X, "_stored", {})
    monkeypatch.setattr(X, "_ROWS_PER_FILE", 100)
    monkeypatch.setattr(X, "materialize", lambda df, name: seen.append(df) or df)
    for build, key in ((X.raw_listings, "o_orderkey"), (X.booking_requests, "o_orderkey"), (X.search_requests, "c_custkey")):
        rows = build(spark, sf_dir)
        plan = physical(seen[-1])
        assert "RoundRobinPartitioning" not in plan and plan.count("Exchange") == 1 and f"Exchange hashpartitioning({key}" in plan
        # partitions grow with the rows
        assert rows.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-rows.count() // 100))
