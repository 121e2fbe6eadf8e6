"""CSV reading, row index, test cases, listing stream."""

import csv
import json
import os
import random
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalog.queries import _keyed_state, _run
from roomtrace import constants as K
from roomtrace.operators import listings as LS
from roomtrace.plans.scratch import scratch_dir
from roomtrace.sources import cases
from roomtrace.sources.csv_records import ends_inside
from roomtrace.sources import listings as SRC
from roomtrace.streaming.listings import stream_listings

HEADER = ",".join(K.RAW_COLUMNS)


def _folder(**files) -> str:
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, text in files.items():
        with open(os.path.join(path, name + ".csv"), "w", encoding="utf-8-sig", newline="") as f:
            f.write(text)
    return path


def _row(i, title="t", link=None):
    return f'"Thứ 2, 18:16 27/07/2026",{title},2 triệu/tháng,25 m2,"Cầu Giấy, Hà Nội",mô tả,{link if link is not None else f"x-pr{i}.html"}'


def test_quotes_line_breaks_and_byte_order_mark(spark):
    title = '"nói ""hay""\nhai dòng, phẩy"'
    path = _folder(a=HEADER + "\n" + _row(1, title) + "\r\n" + _row(2) + "\n")
    rows = SRC.read_listings(spark, path).orderBy(K.COL_LINK).collect()
    assert [r[K.COL_TITLE] for r in rows] == ['nói "hay"\nhai dòng, phẩy', "t"]
    assert rows[0][K.COL_POSTED] == "Thứ 2, 18:16 27/07/2026"


def test_columns_are_found_by_name(spark):
    path = _folder(a="Link,Giá,Thừa\nx-pr1.html,2 triệu/tháng,?\n")
    row = SRC.read_listings(spark, path).first()
    assert (row[K.COL_LINK], row[K.COL_PRICE], row[K.COL_TITLE]) == ("x-pr1.html", "2 triệu/tháng", None)


def test_files_with_other_headers_are_refused(spark):
    path = _folder(a="Link,Giá\nx,y\n", b="Giá,Link\ny,x\n")
    with pytest.raises(Exception, match="header"):
        SRC.read_listings(spark, path).collect()


def test_missing_file_is_an_error(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        SRC.read_listings(spark, "/tmp/there-is-no-such-crawl")


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of this many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def split(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield split
    for n, v in before.items():
        spark.conf.set(n, v)


def _one_by_one(path):
    """What Python's reader gives, file by file; empty fields are null."""
    out = []
    for name in sorted(os.listdir(path)):
        with open(f"{path}/{name}", encoding="utf-8-sig", newline="") as f:
            out += [tuple(r[c] or None for c in K.RAW_COLUMNS) for r in csv.DictReader(f)]
    return out


@pytest.mark.parametrize("seed, size", [(1, 333), (2, 5000)])
def test_records_over_many_splits_equal_those_of_one_reader(spark, small_splits, seed, size):
    r = random.Random(seed)
    inner = ["a", "é", ",", '""', "\n", "\n\n", "\r\n", " ", "x,y", "\n\"\"\n", "đặt"]
    plain = ["", "t", "2 triệu", 'in 5" wide', " lead", "it's", "z" * 150]

    def field():
        return '"' + "".join(r.choices(inner, k=r.randrange(8))) + '"' if r.random() < 0.5 else r.choice(plain)

    files, rows = {}, 0
    for name in ("a", "b"):
        lines = []
        for k in range(80):
            fields = [field() for _ in K.RAW_COLUMNS]
            fields[-1] = f"x-{name}{k}.html"
            if k == 40:
                fields[3] = '"' + "long\n" * 400 + '"'  # over several splits
            lines.append(",".join(fields) + r.choice(["\n", "\r\n", "\n\n"]))
            rows += 1
        files[name] = HEADER + ("\r\n" if seed == 2 else "\n") + "".join(lines)
    path = _folder(**files)
    want = _one_by_one(path)
    small_splits(size)
    got = SRC.read_listings(spark, path)
    assert got.select("_file", "_block").distinct().count() > (2 if size == 5000 else 15)
    indexed = SRC.with_row_index(got).orderBy("row_index").collect()
    assert [x.row_index for x in indexed] == list(range(rows))
    assert [tuple(x[c] or None for c in K.RAW_COLUMNS) for x in indexed] == want and len(want) == rows


def test_one_large_file_is_many_tasks(spark, small_splits):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{path}/big.csv", "w", encoding="utf-8", newline="") as f:
        f.write(HEADER + "\n")
        for k in range(60_000):
            f.write(_row(k, f'"dòng một\nsố ""{k}"", hai"') + "\n")
    small_splits(500_000)
    rows = SRC.read_listings(spark, path)
    assert rows.count() == 60_000 and rows.rdd.getNumPartitions() >= 12
    last = SRC.with_row_index(rows).where("row_index % 10000 = 9999").orderBy("row_index").collect()
    assert [(x.row_index, x[K.COL_TITLE]) for x in last] == [(k, f'dòng một\nsố "{k}", hai') for k in range(9999, 60_000, 10_000)]


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'a,"b', True, False), (b'a,"b"', False, False), (b'"a"",b', True, False), (b'5" x,y', False, False), (b'"a""b",c', False, False),
    (b'x","y', True, True), (b'x"', False, False), (b'","', False, True), (b'""', False, True), (b"", False, True), (b'"', True, False),
])
def test_state_at_the_end_of_a_line(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)


def test_row_index_is_dense_in_file_order(spark):
    files, n = {}, 0
    for name, size in [("a", 3), ("b", 1), ("c", 40), ("d", 7), ("e", 2)]:
        files[name] = HEADER + "\n" + "".join(_row(n + i) + "\n" for i in range(size))
        n += size
    rows = SRC.with_row_index(SRC.read_listings(spark, _folder(**files)))
    assert "SinglePartition" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.row_index, r[K.COL_LINK]) for r in rows.collect()) == [(i, f"x-pr{i}.html") for i in range(n)]


def test_crawl_to_listings(spark):
    text = "\n".join([HEADER, _row(0, "0912345678", ""), _row(1), _row(2, "again", "x-pr1.html"), _row(3, "kept", "")]) + "\n"
    raw = SRC.with_row_index(SRC.read_listings(spark, _folder(a=text)))
    rows = LS.load_listings(raw, "2026-07-27 19:00:00").orderBy("row_index").collect()
    assert [(r.id, r.title, r.days_old) for r in rows] == [
        ("gen0000", K.PHONE_MASK, 0), ("pr1", "t", 0), ("gen0003", "kept", 0)]


def test_junk_rows_do_not_reserve_their_link(spark):
    junk = _row(1).replace("25 m2", "0 m2")
    raw = SRC.with_row_index(SRC.read_listings(spark, _folder(a="\n".join([HEADER, junk, _row(1, "good")]) + "\n")))
    assert [r.title for r in LS.load_listings(raw, "2026-07-27 19:00:00").collect()] == ["good"]


def test_cases_by_id(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    items = [{"id": i, "category": "c", "question": f"q{i}", "expected_behavior": "e"} for i in (1, 2, 12)]
    with open(f"{path}/cases.json", "w", encoding="utf-8") as f:
        json.dump(items, f, indent=1)
    assert cases.read_test_cases(spark, path).count() == 3
    assert [r.question for r in cases.read_test_cases(spark, path, "12").collect()] == ["q12"]


def _crawled(rows, at, area="25 m2"):
    return rows.select(
        F.col("id").alias("row_index"),
        F.lit("Thứ 2, 10:00 26/07/2026").alias(K.COL_POSTED), F.format_string("t%d", F.col("id")).alias(K.COL_TITLE),
        F.lit("2 triệu/tháng").alias(K.COL_PRICE), F.lit(area).alias(K.COL_AREA),
        F.lit("Cầu Giấy").alias(K.COL_ADDRESS), F.lit("khép kín").alias(K.COL_DESCRIPTION),
        F.when(F.col("id") % 3 > 0, "x-pr1.html").when(F.col("id") % 2 == 0, "").otherwise(
            F.format_string("x-pr%d.html", F.col("id"))).alias(K.COL_LINK),
        F.lit(at).cast("timestamp").alias("crawled_at"))


def test_listing_stream_gives_the_first_row_of_each_link_and_tells_late_ones(spark):
    base, ids = scratch_dir(spark, "stream"), spark.range(600)
    # one link has most of the rows; the first row of it comes second and from an earlier crawl
    first, second = _crawled(ids.where("id % 2 = 0"), "2026-07-27 12:00:00"), _crawled(ids.where("id % 2 = 1"), "2026-07-27 09:00:00")
    close = _crawled(spark.range(1000, 1001), "2026-07-30 12:00:00", area="")
    late, again = _crawled(spark.range(700, 701), "2026-07-28 12:00:00"), _crawled(spark.range(800, 801), "2026-07-30 13:00:00")
    end = _crawled(spark.range(1000, 1001), "2026-08-03 12:00:00", area="")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        for portion in (first, second.unionByName(close), late.unionByName(again).unionByName(end)):
            portion.repartition(3).write.mode("append").parquet(f"{base}/in")
            with _keyed_state(spark):
                clean = stream_listings(spark.readStream.schema(portion.schema).parquet(f"{base}/in"))
                _run(clean.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/cp")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = spark.read.parquet(f"{base}/out")
    in_time = first.unionByName(second)
    batch = LS.dedup_by_link(LS.normalize(in_time, F.col("crawled_at").cast("timestamp_ntz"), keep=["crawled_at"]))
    columns = batch.columns
    want = sorted([*(str(r) for r in batch.collect()), *(str(r) for r in LS.normalize(again, F.col("crawled_at").cast("timestamp_ntz"), keep=["crawled_at"]).collect())])
    assert sorted(str(r) for r in out.where("kind = 'listing'").select(columns).collect()) == want
    assert [(r.row_index, r.days_old) for r in out.where("kind = 'late'").collect()] == [(700, 2)]
    # ages are counted from the event
    assert {r.days_old for r in out.where("row_index = 800").collect()} == {4}


def test_links_of_the_listing_stream_share_state(spark):
    base = scratch_dir(spark, "stream")
    own = lambda rows: rows.withColumn(K.COL_LINK, F.format_string("x-pr%d.html", F.col("row_index") % 5000))
    portions = [
        own(_crawled(spark.range(5000, 10000), "2026-07-27 12:00:00")), own(_crawled(spark.range(2000), "2026-07-27 13:00:00")),
        _crawled(spark.range(10000, 10001), "2026-08-03 12:00:00", area=""),
    ]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        for n, portion in enumerate(portions):
            portion.repartition(3).write.mode("append").parquet(f"{base}/in")
            with _keyed_state(spark):
                clean = stream_listings(spark.readStream.schema(portion.schema).parquet(f"{base}/in"), buckets=16)
                _run(clean.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/cp")
            if n == 1:
                keys = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/cp").select("key.*")
                assert keys.columns == ["bucket"] and keys.distinct().count() <= 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = spark.read.parquet(f"{base}/out")
    assert sorted((r.row_index, r.kind) for r in out.collect()) == [(i, "listing") for i in [*range(2000), *range(7000, 10000)]]


def test_a_larger_crawl_has_more_files(spark, sf_dir, monkeypatch):
    from catalog import queries as Q

    monkeypatch.setattr(Q, "CRAWL_ROWS", 100, raising=False)
    path = Q._write_crawl(spark, sf_dir)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // 100)
    indexed = Q.a2_with_row_index(spark, sf_dir).select("row_index", "link").collect()
    raw = Q.X.raw_listings(spark, sf_dir).select("row_index", F.coalesce(K.COL_LINK, F.lit("")).alias("link")).collect()
    assert sorted(map(tuple, indexed)) == sorted(map(tuple, raw))
