"""Input views derived from the given tables.

Each view is SQL text that Spark and DuckDB both accept, so the two engines
start from the same rows.  ``{name}`` stands for a given table.
"""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.operators.bookings import adjudicate
from roomtrace.operators.listings import load_listings
from roomtrace.plans.scratch import materialize, scratch_dir
from roomtrace.sources.by_id import ListingsById, write_by_id
from roomtrace.sources.ledger import empty_ledger

NOW = "2026-07-27 12:00:00"
TODAY = "2026-07-27"

_TITLES = "|".join([
    "Phòng khép kín giá rẻ", "Phong khep kin gan cho", "Có ban công thoáng", "Phong co ban cong",
    "Điều hòa, nóng lạnh", "Dieu hoa nong lanh", "Thang máy, để xe", "Thang may, de xe",
    "Cửa sổ, máy giặt", "Cua so, may giat", "Tủ lạnh, bếp từ", "TU LANH, BEP TU",
    "An ninh, giờ giấc tự do", "An ninh, gio giac tu do", "Full đồ, đầy đủ nội thất", "Phòng trọ sinh viên",
])
_PRICES = "|".join([
    "1.6 triệu/tháng", "2 triệu/tháng", "2,9 triệu/tháng", "3.5 triệu/tháng", "3.9 triệu/tháng",
    "800.000 đồng/tháng", "4.1 triệu/tháng", "5,2 triệu/tháng", "8.2 triệu/tháng",
    "120.000 đồng/m2/tháng", "Thỏa thuận", "12 triệu/tháng", "4.8 triệu / tháng",
])
_DISTRICTS = "|".join([
    "Cầu Giấy", "Thanh Xuân", "Nam Từ Liêm", "Bắc Từ Liêm", "Đống Đa", "Ba Đình",
    "Hoàng Mai", "Hà Đông", "CAU GIAY", "Hai Bà Trưng", "Hoàn Kiếm",
])

RAW_LISTINGS = f"""
SELECT k AS row_index,
  CASE WHEN k % 97 = 0 THEN 'không rõ'
       WHEN k % 101 = 0 THEN '10:00 30/02/2026'
       WHEN k % 103 = 0 THEN '24:00 01/07/2026'
       ELSE concat('Thứ ', cast(2 + k % 6 AS string), ', ', cast(k % 24 AS string), ':',
                   lpad(cast(k * 7 % 60 AS string), 2, '0'), ' ',
                   cast(day(d) AS string), '/', cast(month(d) AS string), '/', cast(year(d) AS string))
  END AS posted_raw,
  concat(split_part('{_TITLES}', '|', cast(k % 16 AS int) + 1),
         CASE WHEN k % 7 = 0 THEN concat(' LH 09', lpad(cast(k AS string), 8, '0')) ELSE '' END,
         CASE WHEN k % 19 = 0 THEN ' ma 012345678901' ELSE '' END) AS title_raw,
  CASE WHEN k % 107 = 0 THEN '2 đồng/tháng'
       WHEN k % 109 = 0 THEN '1.2.3 triệu/tháng'
       ELSE split_part('{_PRICES}', '|', cast(k % 13 AS int) + 1) END AS price_raw,
  CASE WHEN k % 41 = 0 THEN '0 m2'
       WHEN k % 43 = 0 THEN '16.18 M2'
       WHEN k % 47 = 0 THEN '16,18 m2'
       WHEN k % 53 = 0 THEN '1.234,5 m2'
       WHEN k % 59 = 0 THEN 'không rõ'
       ELSE concat(cast(10 + k % 37 AS string), ' m2') END AS area_raw,
  CASE WHEN k % 61 = 0 THEN ''
       WHEN k % 67 = 0 THEN ', Hà Nội'
       ELSE concat(split_part('{_DISTRICTS}', '|', cast(k % 11 AS int) + 1), ', Hà Nội') END AS address_raw,
  CASE k % 5 WHEN 0 THEN NULL
       WHEN 1 THEN concat('Dòng một', chr(10), 'dòng hai, nóng lạnh')
       WHEN 2 THEN 'Chủ nhà nói "vào ở ngay" nhé'
       WHEN 3 THEN 'Gọi 0912345678,0987654321 nhé'
       ELSE concat(chr(160), 'Gần chợ, an ninh', chr(160)) END AS descr_raw,
  CASE WHEN k % 73 = 0 THEN ''
       WHEN k % 71 = 0 AND k > 0
         THEN concat('https://rent.example/phong-pr', cast(700000 + k - 1 AS string), '.html')
       WHEN k % 79 = 0 THEN concat('https://rent.example/phong-', cast(k AS string), '.html')
       WHEN k % 83 = 0 AND k > 1
         THEN concat('https://rent.example/b-phong-pr', cast(700000 + k - 2 AS string), '.html')
       ELSE concat('https://rent.example/phong-pr', cast(700000 + k AS string), '.html') END AS link_raw
FROM (SELECT o_orderkey AS k, date '2026-07-27' - cast(o_orderkey % 127 AS int) AS d FROM {{orders}}) AS t
"""

_ASKED = "|".join([
    "Cầu Giấy", "THANH XUÂN", "nam tu liem", "Bắc Từ Liêm", "dong da", "Ba Đình", "HOANG MAI",
    "Hà Đông", "cau giay", "Hai Bà Trưng", "hoan kiem", "Từ Liêm", "Atlantis",
])

SEARCH_REQUESTS = f"""
SELECT c AS request_id,
  CASE WHEN c % 17 = 0 THEN NULL WHEN c % 23 = 0 THEN '!!!'
       ELSE split_part('{_ASKED}', '|', cast(c % 13 AS int) + 1) END AS district,
  CASE c % 6 WHEN 0 THEN cast(1 AS bigint) WHEN 1 THEN 2000000 WHEN 2 THEN 4000000
             WHEN 3 THEN 5000000 WHEN 4 THEN NULL ELSE -1 END AS max_price,
  CASE (c % 3 + c % 5) % 3 WHEN 0 THEN NULL WHEN 1 THEN cast(15 AS double) ELSE 30 END AS min_area,
  CASE c % 4 WHEN 0 THEN cast(NULL AS int) WHEN 1 THEN 0 WHEN 2 THEN 7 ELSE 30 END AS max_days_old,
  cast(1 + c % 22 AS int) AS row_limit
FROM (SELECT c_custkey AS c FROM {{customer}}) AS t
"""

BOOKING_REQUESTS = """
SELECT k AS request_id,
  k * 7919 % 100003 AS wait_seconds,
  CASE WHEN k % 29 = 0 THEN 'pr0'
       WHEN k % 31 = 0 THEN concat('  pr', cast(700000 + k % 200 AS string), ' ')
       ELSE concat('pr', cast(700000 + k % 200 AS string)) END AS listing_id,
  CASE WHEN k % 37 = 0 THEN concat(cast(year(d) AS string), '-', cast(month(d) AS string), '-', cast(day(d) AS string))
       WHEN k % 41 = 0 THEN '2026-07-26'
       WHEN k % 43 = 0 THEN '2026-08-27'
       WHEN k % 47 = 0 THEN '27/07/2026'
       ELSE cast(d AS string) END AS date_raw,
  CASE WHEN k % 53 = 0 THEN '08:00'
       WHEN k % 11 = 0 THEN concat(' ', s, '  ')
       ELSE s END AS slot,
  concat('  Khách ', cast(k AS string), ' ') AS name
FROM (SELECT o_orderkey AS k,
        date '2026-07-27' + cast(o_orderkey % 5 AS int) AS d,
        split_part('09:00|10:30|14:00|15:30|17:00', '|',
                   cast((o_orderkey + floor(o_orderkey / 200)) % 5 AS int) + 1) AS s
      FROM {orders}) AS t
"""

# a user row and the assistant row right after it; four conversations are chained into one
TURNS = """
SELECT u.conv_id - u.conv_id % 4 AS conv_id,
  (u.conv_id % 4) * 1000 + u.turn AS turn,
  CASE (u.conv_id * 31 + u.turn) % 13
    WHEN 0 THEN concat(u.text, ' đặt lịch')
    WHEN 1 THEN concat(u.text, ' Facebook')
    WHEN 2 THEN concat(u.text, ' ĐẶT LỊCH')
    WHEN 3 THEN concat(u.text, ' dat lich')
    WHEN 4 THEN concat(u.text, ' chi phí')
    WHEN 5 THEN ' /quen '
    WHEN 6 THEN '/bot'
    WHEN 7 THEN concat('/bot ', u.text)
    WHEN 8 THEN '/gon'
    ELSE u.text END AS question,
  CASE WHEN u.conv_id % 5 = 0 THEN repeat(a.text, 3) ELSE a.text END AS answer
FROM (SELECT conv_id, turn, text FROM {conversations} WHERE role = 'user') AS u
LEFT JOIN (SELECT conv_id, turn, text FROM {conversations} WHERE role = 'assistant') AS a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
"""

STEPS = """
SELECT trace_id, step, i, e,
  CASE WHEN trace_id % 2 = 0 THEN 'Đặt lịch xem phòng giúp tôi' ELSE 'Tìm phòng ở Nam Từ Liêm' END AS question,
  CASE WHEN i = 0 OR (i = 1 AND trace_id % 3 = 0)
         THEN concat('Thought: tìm phòng.', chr(10), 'Action: search_listings["Nam Từ Liêm", 4000000]')
       WHEN i = 1 THEN concat('Thought: tìm phòng.', chr(10), 'Action: search_listings["Nam Từ Liêm", 4000000, 7]')
       WHEN i = 2 THEN 'Action: search_listings["Cầu Giấy, Hà Nội", 5000000]'
       WHEN i = 3 THEN concat('Action: check_viewing_slots[''', p, ''', ''2026-07-2',
                              CASE WHEN trace_id % 4 = 1 THEN '9' ELSE '8' END, ''']')
       WHEN i = 4 THEN concat('Action: get_listing_details["', p, ']')
       WHEN i = 5 THEN 'Action: search_product["x", , -12, "it''s"]'
       WHEN i = 6 THEN concat('Action: get_listing_details["', p, '", 1, 2]')
       WHEN i = 7 THEN concat('Action: book_viewing["', p, '", "2026-07-28", "14:00", "Minh An"]')
       WHEN i = 8 THEN 'Tôi chưa rõ yêu cầu.'
       WHEN i = 9 THEN concat('Final Answer: chọn ', p, CASE WHEN trace_id % 2 = 1 THEN ' hoặc pr999999.' ELSE '.' END,
                              chr(10), 'Action: get_listing_details["', p, '"]')
       WHEN i = 10 THEN concat('Action: get_listing_details["', p, '"]', chr(10), 'Observation: bịa ra pr1')
       ELSE '[Gemini Exception]: 503 UNAVAILABLE ' END AS raw_output,
  CASE WHEN i <= 2 THEN concat('Tìm thấy 1 tin (mới nhất trước):', chr(10), '  ', p, ' | 3.5 triệu/tháng')
       WHEN i = 3 THEN concat('Ngày 2026-07-28 tin ', p, ' còn trống các khung giờ: 09:00, 14:00')
       ELSE concat('LỖI (404): bước ', cast(step AS string)) END AS observation
FROM (SELECT e, t AS trace_id, 1 + e % 7 AS step, (e * 13 + t) % 12 AS i,
             concat('pr', cast(700000 + t % 50 AS string)) AS p
      FROM (SELECT event_id AS e, cast(floor(event_id / 7) AS bigint) AS t FROM {events}) AS n) AS s
"""

# the place in a conversation where a trace's question was put; every ninth trace has none
ASKED = """
SELECT t AS trace_id, CASE WHEN t % 9 = 0 THEN NULL ELSE 4 * (t % 260) END AS conv_id, CAST(t * 37 % 4000 AS bigint) AS asked_at
FROM (SELECT DISTINCT cast(floor(event_id / 7) AS bigint) AS t FROM {events}) AS d
"""

ATTEMPTS = f"""
SELECT trace_id, step, n AS attempt,
  CASE WHEN n < 1 + e % 4 THEN concat('[API Error]: 429 lần ', cast(n AS string)) ELSE raw_output END AS raw_output
FROM (SELECT *, 1 AS n FROM ({STEPS}) AS a
      UNION ALL SELECT *, 2 AS n FROM ({STEPS}) AS b WHERE e % 5 <> 4
      UNION ALL SELECT *, 3 AS n FROM ({STEPS}) AS c WHERE e % 5 <> 4) AS x
"""

RUNS = """
SELECT cast(floor(event_id / 2) AS bigint) AS run_id,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'tool' ELSE 'model' END AS kind
FROM {events}
"""

TABLES = {
    "orders": [RAW_LISTINGS, BOOKING_REQUESTS], "customer": [SEARCH_REQUESTS],
    "conversations": [TURNS], "events": [STEPS, ATTEMPTS, RUNS, ASKED],
}


def for_duckdb(view: str) -> str:
    return view.format(**{name: name for name in TABLES})


#: Tables whose rows views widen one by one, and their key.
SPREAD = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}
_ROWS_PER_FILE = 500_000


def _spread(table: DataFrame, key: str) -> DataFrame:
    """The rows dealt over several tasks by their key: a tiny source is one file and would stay one task.

    This comes before a view widens its rows, so only the few columns it reads are moved, unsorted, and the partitions grow with the rows.
    """
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // _ROWS_PER_FILE)), key)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name, views in TABLES.items() if sql in views}
    return spark.sql(sql, **{name: _spread(table, SPREAD[name]) if name in SPREAD else table for name, table in tables.items()})


_stored: dict[tuple, DataFrame] = {}


def stored(build):
    """Derive an input table once per session, write it, and read the written table after that."""

    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _stored:
            _stored[key] = materialize(build(spark, sf_dir), build.__name__)
        return _stored[key]

    return read


@stored
def raw_listings(spark, sf_dir) -> DataFrame:
    """Crawl columns under their own header names, and row_index."""
    parts = ["posted_raw", "title_raw", "price_raw", "area_raw", "address_raw", "descr_raw", "link_raw"]
    rows = view(spark, sf_dir, RAW_LISTINGS)
    return rows.select("row_index", *[F.col(p).alias(c) for p, c in zip(parts, K.RAW_COLUMNS)])


@stored
def search_requests(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, SEARCH_REQUESTS).withColumnRenamed("row_limit", "limit")


@stored
def booking_requests(spark, sf_dir) -> DataFrame:
    at = F.timestamp_add("SECOND", F.col("wait_seconds"), F.lit(NOW).cast("timestamp_ntz"))
    rows = view(spark, sf_dir, BOOKING_REQUESTS).withColumn("requested_at", at.cast("timestamp_ntz"))
    return rows.withColumnRenamed("date_raw", "date").drop("wait_seconds")


def slot_requests(spark, sf_dir) -> DataFrame:
    return booking_requests(spark, sf_dir).select("request_id", "listing_id", "date")


@stored
def turns(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, TURNS)


@stored
def steps(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, STEPS).drop("i", "e")


@stored
def asked(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, ASKED)


@stored
def attempts(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, ATTEMPTS)


@stored
def runs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, RUNS)


@stored
def listings(spark, sf_dir) -> DataFrame:
    """The normalised table that lookups and searches read."""
    return load_listings(raw_listings(spark, sf_dir), NOW)


_by_id: dict[tuple, ListingsById] = {}


def listings_by_id(spark, sf_dir) -> ListingsById:
    """The same table laid out by id, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _by_id:
        path = scratch_dir(spark, "by_id")
        write_by_id(listings(spark, sf_dir), path, folders=64)
        _by_id[key] = ListingsById(spark, path, folders=64)
    return _by_id[key]


@stored
def decisions(spark, sf_dir) -> DataFrame:
    """Decisions on all booking requests, starting from an empty ledger."""
    return adjudicate(booking_requests(spark, sf_dir), listings_by_id(spark, sf_dir), empty_ledger(spark), TODAY)
