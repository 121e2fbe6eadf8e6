"""Answer texts as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions.text import general_number


def age_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit(K.AGE_UNKNOWN))
        .when(days == 0, F.lit(K.AGE_TODAY))
        .when(days == 1, F.lit(K.AGE_YESTERDAY))
        .otherwise(F.format_string(K.AGE_DAYS, days))
    )


def _joined(array: Column, empty: str) -> Column:
    return F.when(F.size(array) > 0, F.array_join(array, ", ")).otherwise(F.lit(empty))


def listing_line(item=F.col) -> Column:
    """One-line summary; ``item`` maps a listing field name to its column."""
    return F.concat_ws(
        " | ",
        item("id"),
        item("price_label"),
        F.concat(general_number(item("area_m2")), F.lit("m2")),
        item("district"),
        age_label(item("days_old")),
        _joined(item("amenities"), K.NO_AMENITY_LINE),
    )


def listing_details(item=F.col) -> Column:
    """Nine-line detail text."""
    values = [
        item("id"),
        item("title"),
        item("price_label"),
        F.concat(general_number(item("area_m2")), F.lit(" m2")),
        item("address"),
        _joined(item("amenities"), K.NO_AMENITY_DETAIL),
        age_label(item("days_old")),
        item("description"),
        item("url"),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in zip(K.DETAIL_LABELS, values)])


def search_text(lines: Column, district: Column, max_price: Column, max_days_old: Column) -> Column:
    """Header and indented lines, or a "nothing found" text that repeats the filters."""
    # a request made without these two parameters shows them as the caller's None
    asked = F.concat(
        F.format_string(
            K.SEARCH_EMPTY_FILTER,
            F.coalesce(district, F.lit("None")),
            F.coalesce(F.format_number(max_price, 0), F.lit("None")),
        ),
        F.when(max_days_old.isNotNull(), F.format_string(K.SEARCH_EMPTY_AGE, max_days_old)).otherwise(""),
    )
    found = F.concat(
        F.format_string(K.SEARCH_HEADER, F.size(lines)),
        F.lit("\n  "),
        F.array_join(lines, "\n  "),
    )
    return F.when(F.size(lines) > 0, found).otherwise(F.format_string(K.SEARCH_EMPTY, asked))


def slots_text(listing_id: Column, raw_date: Column, slots: Column) -> Column:
    return F.when(F.size(slots) == 0, F.format_string(K.SLOTS_FULL, raw_date, listing_id)).otherwise(
        F.format_string(K.SLOTS_FREE, raw_date, listing_id, F.array_join(slots, ", "))
    )


def booking_text(ref: Column, listing_id: Column, title: Column, address: Column,
                 date: Column, slot: Column, name: Column) -> Column:
    head, what, where, when, who = K.BOOKING_LINES
    return F.concat_ws(
        "\n",
        F.format_string(head, ref),
        F.format_string(what, listing_id, title),
        F.format_string(where, address),
        F.format_string(when, date, slot),
        F.format_string(who, name),
    )


def error_text(status: Column, details: Column, body: Column) -> Column:
    """``details`` is an array of messages; without any, the start of the body is shown."""
    message = F.when(F.size(details) > 0, F.nullif(F.array_join(details, "; "), F.lit("")))
    return F.format_string(
        K.ERROR_TEXT,
        status,
        F.coalesce(message, F.substring(body, 1, K.ERROR_BODY_CHARS), F.lit("")),
    )
