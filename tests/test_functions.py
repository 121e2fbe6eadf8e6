"""Golden values and random checks of the column functions."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions import agent as A
from roomtrace.functions import listing as L
from roomtrace.functions import render as R
from roomtrace.functions import text as TX
from roomtrace.operators.bookings import slots_for
from roomtrace.operators.listings import as_date, as_timestamp, dedup_by_link
from roomtrace.operators.search import validate_search


def apply(spark, values, f, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.r for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_strip_accents_every_single_letter(spark):
    chars = [
        chr(c) for c in range(0x21, 0x2FA20)
        if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")
        and not 0xAC00 <= c <= 0xD7A3  # syllables that decompose into several letters
    ]

    def expected(c):
        c = {"đ": "d", "Đ": "D"}.get(c, c)
        return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")

    got = apply(spark, chars, TX.strip_accents)
    wrong = [(c, g, expected(c)) for c, g in zip(chars, got) if g != expected(c) and len(expected(c)) <= 1]
    assert wrong == []


def test_keys_and_accents(spark):
    assert apply(spark, ["Cầu Giấy", "ĐỐNG ĐA", "Cầu"], TX.strip_accents) == ["Cau Giay", "DONG DA", "Cau"]
    assert apply(spark, ["Cầu Giấy", "cau giay", " CAU-GIAY!", "!!!", "Đống Đa"], TX.district_key) == [
        "caugiay", "caugiay", "caugiay", "", "dongda"]


def test_py_strip(spark):
    values = [None, "", "  a b ", "\xa0x　", "\x1c\x1fy\x85", "​z"]
    assert apply(spark, values, TX.py_strip) == [(v or "").strip() for v in values]


@pytest.mark.parametrize("price,area,expected", [
    ("4.8 triệu/tháng", 25.0, 4_800_000), ("800.000 đồng/tháng", 25.0, 800_000),
    ("20.000 đồng/m2/tháng", 25.0, 500_000), ("Thỏa thuận", 25.0, None), ("4.1 triệu/tháng", 1.0, 4_099_999),
    ("5,2 triệu/tháng", 1.0, 5_200_000), ("1.2.3 triệu/tháng", 1.0, None), ("4.8 triệu / tháng", 1.0, None),
    ("  2 đồng/tháng ", 1.0, 2), ("120.000 đồng/m2/tháng", 16.18, 1_941_600), (".,. đồng/tháng", 1.0, None),
])
def test_parse_price(spark, price, area, expected):
    assert apply(spark, [price], lambda c: L.parse_price(c, F.lit(area))) == [expected]


def test_parse_area(spark):
    values = ["25 m2", "16.18 M2", "16,18m2", "1.234,5 m2", "0 m2", "không rõ", None, "25 m2 x", " 7 m2 "]
    assert apply(spark, values, L.parse_area) == [25.0, 16.18, 16.18, None, 0.0, None, None, None, 7.0]


def test_parse_posted_at(spark):
    values = ["Thứ 2, 18:16 27/07/2026", "7:05 1/2/2024", "24:00 01/07/2026", "10:00 30/02/2026", "10:60 01/01/2026",
              "không rõ", None, "10:00 01/01/0000"]
    assert apply(spark, values, L.parse_posted_at) == [
        dt.datetime(2026, 7, 27, 18, 16), dt.datetime(2024, 2, 1, 7, 5), None, None, None, None, None, None]


def test_days_old_is_floor_of_full_days(spark):
    now = dt.datetime(2026, 7, 27, 12, 0)
    rng = random.Random(3)
    posted = [now - dt.timedelta(minutes=rng.randint(-5000, 50000)) for _ in range(300)] + [now, None]
    got = apply(spark, posted, lambda c: L.days_old(c, as_timestamp(now)), "v timestamp_ntz")
    assert got == [None if p is None else (now - p).days for p in posted]


def test_amenities_in_vocabulary_order_without_repeats(spark):
    values = ["TỦ LẠNH, đầy đủ nội thất, Full đồ, khép kín", "gio giac tu do", "", "cửa sổ ban công"]
    assert apply(spark, values, L.extract_amenities) == [
        ["khép kín", "full đồ", "tủ lạnh"], ["giờ giấc tự do"], [], ["ban công", "cửa sổ"]]


def test_scrub_phones(spark):
    values = ["0912345678,0987654321", "a0123456789012", "1912345678", "LH:09123456789.", "09123 45678", "0123456789x"]
    m = K.PHONE_MASK
    assert apply(spark, values, TX.scrub_phones) == [
        f"{m},{m}", "a0123456789012", "1912345678", f"LH:{m}.", "09123 45678", f"{m}x"]


def test_listing_id_and_district(spark):
    rows = spark.createDataFrame([("a/b-pr12.html", 3), ("x-pr.html", 7), ("", 12345)], "link string, i bigint")
    got = [r[0] for r in rows.select(L.listing_id(F.col("link"), F.col("i"))).collect()]
    assert got == ["pr12", "gen0007", "gen12345"]
    assert apply(spark, ["Cầu Giấy , Hà Nội", "", ", Hà Nội", "Ba Đình"], L.district_of) == [
        "Cầu Giấy", "Không rõ", "", "Ba Đình"]


def test_validate_date(spark):
    values = ["2026-07-27", " 2026-7-28 ", "2026-08-26", "2026-08-27", "2026-07-26", "2026-02-30", "27/07/2026",
              "02026-07-27", "2026-07", "", None]
    got = apply(spark, values, lambda c: L.validate_date(c, as_date("2026-07-27")))
    assert [g.date for g in got[:3]] == [dt.date(2026, 7, 27), dt.date(2026, 7, 28), dt.date(2026, 8, 26)]
    assert all(g.error is None for g in got[:3]) and all(g.date is None for g in got[3:])
    assert got[3].error == "Ngày 2026-08-27 quá xa, chỉ đặt lịch trong 30 ngày tới."
    assert got[4].error == "Ngày 2026-07-26 đã ở quá khứ, không đặt lịch xem được."
    assert all("sai định dạng" in g.error for g in got[5:])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=20, max_size=40))
def test_general_number_like_six_significant_digits(spark, numbers):
    # two decimals: no ties at the sixth digit below 10^4
    values = [n / 100 for n in numbers if n < 10**6] + [1e6, 2.5e6, 123456.0, 0.0001, 0.5, 25.0, 16.18]
    assert apply(spark, values, TX.general_number, "v double") == [f"{v:g}" for v in values]


def test_truncate_at_observation(spark):
    values = ["a\nObservation: b", "Observation: x", " a\nObservation b\nQuan sát: c ", "a\nObservations", "x\nQuan sát:"]
    assert apply(spark, values, A.truncate_at_observation) == ["a", "Observation: x", "a", "a\nObservations", "x"]


def test_parse_action(spark):
    values = [
        'Thought: a\nAction: search_listings["Nam Từ Liêm", 4000000, 7]', "Action: f[a\nb]", "no action",
        "Action: f[1]\nAction: g[2]", "  Action:  f  [x]  ", "Action: f[x] trailing", "Action: đặt[1]"]
    got = [(g.tool, g.raw_args) for g in apply(spark, values, A.parse_action)]
    assert got == [
        ("search_listings", '"Nam Từ Liêm", 4000000, 7'), ("f", "a\nb"), (None, None),
        ("f", "1]\nAction: g[2"), ("f", "x"), (None, None), ("đặt", "1")]


@pytest.mark.parametrize("raw,expected", [
    ('"Nam Từ Liêm", 4000000, 7', ["Nam Từ Liêm", 4000000, 7]),
    ('"Cầu Giấy, Hà Nội", 5000000', ["Cầu Giấy, Hà Nội", 5000000]),
    ("'a', \"b\"", ["a", "b"]), ('"open, still open', ["open, still open"]), ("", []), (", ,a,", ["a"]),
    ("-12, +3, 4.5, 007", [-12, "+3", "4.5", 7]), ('"it\'s", \'say "x"\'', ["it's", 'say "x']),
    ('"12"', [12]), ("ab\"c,d\"e, f", ["abc,de", "f"]), ('"  padded  "', ["padded"]), ("a b , c", ["a b", "c"]),
    ("''", []), ('"\'quoted\'"', ["quoted"]), ("x\n,\ny", ["x", "y"]),
])
def test_split_arguments(spark, raw, expected):
    got = apply(spark, [raw], A.split_arguments)[0]
    assert [g.int_value if g.int_value is not None else g.text for g in got] == expected


def test_split_arguments_of_a_long_text(spark):
    raw = "x" * 200_000 + ',"' + "y," * 100_000 + '"'
    got = apply(spark, [raw], A.split_arguments)[0]
    assert [len(g.text) for g in got] == [200_000, 200_000]


def test_final_answer_and_errors(spark):
    assert apply(spark, ["a Final Answer: b Final Answer: c ", "none"], A.final_answer) == ["b Final Answer: c", None]
    texts = [" [Gemini Exception]: 503", "[API error] x]: y", "[x Error]: t", "text [Error]: no", "[Error] no"]
    assert apply(spark, texts, A.is_provider_error) == [True, False, True, False, False]
    assert apply(spark, ["x Unavailable", "Timeout", "fine", "code 429"], A.is_transient) == [True, True, False, True]


def test_intent_and_routes(spark):
    texts = ["Đặt lịch giúp tôi", "ĐẶT HẸN", "Facebook", "dat phong", "chốt nhé", "dat lich"]
    assert apply(spark, texts, A.has_booking_intent) == [True, True, True, False, True, True]
    texts = ["Chào bạn", "chi phí", "Giá vé?", "THỜI TIẾT", "hotline", "abc"]
    assert apply(spark, texts, A.route_by_rules) == ["greeting", "greeting", "price", "weather", "contact", "unknown"]


def test_date_context(spark):
    days = [dt.date(2026, 7, 27) + dt.timedelta(days=i) for i in range(10)]
    got = apply(spark, days, A.date_context, "v date")
    assert [g.weekday for g in got] == [K.WEEKDAYS[d.weekday()] for d in days]
    assert (got[4].today, got[4].tomorrow) == ("2026-07-31", "2026-08-01")


def test_listing_line_golden(spark):
    item = spark.createDataFrame(
        [("pr710215", "3.9 triệu/tháng", 25.0, "Nam Từ Liêm", 3, ["khép kín"]),
         ("pr1", "Thỏa thuận", 16.18, "Ba Đình", None, [])],
        "id string, price_label string, area_m2 double, district string, days_old int, amenities array<string>")
    assert [r[0] for r in item.select(R.listing_line()).collect()] == [
        "pr710215 | 3.9 triệu/tháng | 25m2 | Nam Từ Liêm | đăng 3 ngày trước | khép kín",
        "pr1 | Thỏa thuận | 16.18m2 | Ba Đình | không rõ ngày đăng | không rõ tiện ích"]


def test_error_text(spark):
    rows = spark.createDataFrame([(404, ["a"], None), (422, ["a", "b"], "x"), (500, [], "y" * 300), (500, None, "z")],
                                 "s int, d array<string>, b string")
    got = [r[0] for r in rows.select(R.error_text(F.col("s"), F.col("d"), F.col("b"))).collect()]
    assert got == ["LỖI (404): a", "LỖI (422): a; b", "LỖI (500): " + "y" * 200, "LỖI (500): z"]


def test_slots_contract(spark):
    ids = [f"pr{i}" for i in range(500)]
    slots = apply(spark, ids, lambda c: slots_for(c, F.lit("2026-07-28")))
    assert {len(s) for s in slots} == {2, 3, 4}
    assert all(s == sorted(set(s)) and set(s) <= set(K.SLOT_POOL) for s in slots)
    assert slots == apply(spark, ids, lambda c: slots_for(c, F.lit("2026-07-28")))
    assert not re.search("x", "".join(sum(slots, [])))


def test_blanks_and_digits_of_any_script(spark):
    """A non-breaking space or a full-width digit must not lose a price, an area or a date."""
    rows = [("3,5\u00a0triệu/tháng", "25\u00a0m2", "9:05\u00a01/2/2026"), ("３,５ triệu/tháng", "２５ m2", "９:０５ １/２/２０２６")]
    df = spark.createDataFrame(rows, "price string, area string, posted string")
    area = L.parse_area(F.col("area"))
    for r in df.select(L.parse_price(F.col("price"), area).alias("p"), area.alias("a"), L.parse_posted_at(F.col("posted")).cast("string").alias("t")).collect():
        assert (r.p, r.a, r.t) == (3_500_000, 25.0, "2026-02-01 09:05:00")


def test_links_that_look_like_row_numbers(spark):
    rows = [(0, ""), (1, "row 0"), (2, None), (3, "row 0")]
    found = dedup_by_link(spark.createDataFrame(rows, "row_index long, url string"))
    assert sorted(r.row_index for r in found.collect()) == [0, 1, 2]


def test_an_area_that_is_no_number_is_refused(spark):
    rows = [(None, None, float("nan"), None), (None, None, 10.0, None)]
    df = spark.createDataFrame(rows, "limit int, max_price long, min_area double, max_days_old int")
    assert [r.status for r in validate_search(df).collect()] == [422, 200]
