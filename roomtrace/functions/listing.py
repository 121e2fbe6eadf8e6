"""Expressions that turn raw listing text into typed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions.text import ascii_digits, contains_any, py_strip, strip_accents

#: Makes ``\\s`` and ``\\d`` of the patterns mean white space and digits of any script.
ANY_SCRIPT = "(?U)"


def _digits_only(c: Column) -> Column:
    return ascii_digits(F.translate(c, ".,", "")).try_cast("bigint")


def _decimal_number(c: Column) -> Column:
    return ascii_digits(F.translate(c, ",", ".")).try_cast("double")


def price_number(label: Column) -> Column:
    """The number of a trimmed price text in one of the known units, else the empty string."""
    return F.regexp_extract(label, ANY_SCRIPT + K.PRICE_PATTERN, 1)


def price_amount(label: Column, number: Column, area: Column) -> Column:
    """VND per month from a trimmed price text, its number and the area."""
    # double arithmetic and truncation on purpose: 4.1 million is 4,099,999
    return (
        F.when(number == "", F.lit(None).cast("bigint"))
        .when(F.endswith(label, F.lit(K.PRICE_MILLION)), (_decimal_number(number) * F.lit(1e6)).try_cast("bigint"))
        .when(F.endswith(label, F.lit(K.PRICE_PER_M2)), (_digits_only(number).cast("double") * area).try_cast("bigint"))
        .otherwise(_digits_only(number))
    )


def parse_price(c: Column, area: Column) -> Column:
    """Monthly rent in VND, or null.  Unreadable numbers give null, never an error."""
    label = py_strip(c)
    return price_amount(label, price_number(label), area)


def parse_area(c: Column) -> Column:
    """Area in square metres as double, or null."""
    return _decimal_number(F.nullif(F.regexp_extract(py_strip(c), ANY_SCRIPT + K.AREA_PATTERN, 1), F.lit("")))


def parse_posted_at(c: Column) -> Column:
    """First ``H:MM D/M/YYYY`` in the text as a timestamp without zone, or null."""
    found = ascii_digits(F.regexp_extract(c, ANY_SCRIPT + K.POSTED_PATTERN, 0))
    part = F.split(found, ANY_SCRIPT + r"[:/\s]+")  # a single empty part when nothing was found
    hour, minute, day, month, year = (F.get(part, F.lit(i)).try_cast("int") for i in range(5))
    return F.try_make_timestamp_ntz(F.nullif(year, F.lit(0)), month, day, hour, minute, F.lit(0))


def extract_amenities(*texts: Column) -> Column:
    """Distinct amenity labels in vocabulary order, found by unaccented substring."""
    haystack = F.lower(strip_accents(F.concat_ws(" ", *texts)))
    words_of: dict[str, list[str]] = {}
    for word, label in K.AMENITIES:
        words_of.setdefault(label, []).append(word)
    found = [F.when(contains_any(haystack, words), F.lit(label)) for label, words in words_of.items()]
    # removes the nulls; stays in generated code, so the haystack is computed once
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))


def listing_id(link: Column, row_index: Column) -> Column:
    """Id in the link's slug, else one generated from the row's place in the crawl."""
    return F.coalesce(
        F.nullif(F.regexp_extract(link, K.LINK_ID_PATTERN, 1), F.lit("")),
        F.format_string(K.GENERATED_ID_FORMAT, row_index),
    )


def district_of(address: Column) -> Column:
    """Text before the first comma; a fixed label when there is no address."""
    return F.when(address == "", F.lit(K.UNKNOWN_DISTRICT)).otherwise(
        py_strip(F.substring_index(address, ",", 1))
    )


def _second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def days_old(posted: Column, now: Column) -> Column:
    """Whole 24-hour days since posting, rounded down (negative for future posts)."""
    unfinished_day = _second_of_day(now) < _second_of_day(posted)
    return F.datediff(now.cast("date"), posted.cast("date")) - unfinished_day.cast("int")


def iso_timestamp(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))


def validate_date(c: Column, today: Column) -> Column:
    """Check a viewing date: struct(date, error), exactly one of them non-null."""
    text = py_strip(c)
    shaped = F.when(text.rlike(r"^\d{4}-\d{1,2}-( ?\d|\d\d)$"), F.translate(text, " ", ""))
    day = F.try_to_date(shaped, "yyyy-M-d")
    iso = day.cast("string")
    error = (
        F.when(day.isNull(), F.format_string(K.MSG_DATE_FORMAT, F.coalesce(c, F.lit(""))))
        .when(day < today, F.format_string(K.MSG_DATE_PAST, iso))
        .when(day > F.date_add(today, K.BOOKING_HORIZON_DAYS), F.format_string(K.MSG_DATE_FAR, iso))
    )
    return F.struct(F.when(error.isNull(), day).alias("date"), error.alias("error"))
