"""Viewing slots and booking requests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions import render as R
from roomtrace.functions.listing import validate_date
from roomtrace.functions.text import py_strip
from roomtrace.operators.listings import as_date
from roomtrace.plans.scratch import materialize
from roomtrace.plans.skew import lookup
from roomtrace.sources.by_id import ListingsById, known_listings

NO_SLOTS = "array<string>"


def _hash_number(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def slots_for(listing_id: Column, date: Column) -> Column:
    """Two to four of the fixed viewing times, ascending, fixed by listing and ISO date."""
    draw = F.concat_ws(":", listing_id, date)
    shuffled = F.array_sort(
        F.array(
            *[
                F.struct(F.sha2(F.concat_ws(":", draw, F.lit(s)), 256).alias("h"), F.lit(s).alias("s"))
                for s in K.SLOT_POOL
            ]
        )
    )
    size = F.pmod(_hash_number(draw), F.lit(K.MAX_SLOTS - K.MIN_SLOTS + 1)) + K.MIN_SLOTS
    return F.array_sort(F.transform(F.slice(shuffled, 1, size.cast("int")), lambda x: x["s"]))


def booking_ref(listing_id: Column, date: Column, slot: Column) -> Column:
    """Four-digit reference fixed by the booking's key; not unique by design."""
    number = F.pmod(
        _hash_number(F.concat_ws(":", F.lit("booking"), listing_id, date, slot)),
        F.lit(K.BOOKING_REF_HIGH - K.BOOKING_REF_LOW + 1),
    )
    return F.concat(F.lit(K.BOOKING_REF_PREFIX), (number + K.BOOKING_REF_LOW).cast("string"))


def free_slots_array(slots: Column, taken: Column) -> Column:
    """Slots without the taken ones, order kept."""
    return F.array_except(slots, F.coalesce(taken, F.array().cast(NO_SLOTS)))


def free_slots(offers: DataFrame, bookings: DataFrame) -> DataFrame:
    """Free slots per distinct (listing_id, date) of ``offers``, which has a ``slots`` array."""
    days = offers.select("listing_id", "date", "slots").dropDuplicates(["listing_id", "date"])
    free = (
        days.select("listing_id", "date", F.explode("slots").alias("slot"))
        .join(bookings.select("listing_id", "date", "slot"), ["listing_id", "date", "slot"], "left_anti")
        .groupBy("listing_id", "date")
        .agg(F.array_sort(F.collect_list("slot")).alias("free"))
    )
    return days.join(free, ["listing_id", "date"], "left").select(
        "listing_id", "date", F.coalesce("free", F.array().cast(NO_SLOTS)).alias("free")
    )


def _checked(requests: DataFrame, listings: DataFrame | ListingsById, today) -> DataFrame:
    """Requests with the listing they name and a checked date.

    Adds id (null: unknown listing), title, address, day (ISO, null: refused),
    date_error.  The listing is looked up in its narrow form.
    """
    asked = requests.withColumn("_id", py_strip(F.col("listing_id")))
    ids = asked.select(F.col("_id").alias("id"))
    known = known_listings(listings, ids, ["id", "title", "address"]).withColumn("_id", F.col("id"))
    checked = validate_date(F.col("date"), as_date(today))
    return (
        lookup(asked, known, ["_id"], spread=["request_id"])
        .withColumn("_check", checked)
        .withColumn("day", F.col("_check.date").cast("string"))
        .withColumn("date_error", F.col("_check.error"))
        .drop("_check", "_id")
    )


def _on_asked_days(ledger: DataFrame, checked: DataFrame) -> DataFrame:
    """Ledger entries of the (id, day) pairs that are asked for."""
    booked = ledger.select(F.col("listing_id").alias("id"), F.col("date").alias("day"), "slot")
    return booked.join(checked.select("id", "day").distinct(), ["id", "day"], "left_semi")


def slots_batch(requests: DataFrame, listings: DataFrame | ListingsById, ledger: DataFrame, today) -> DataFrame:
    """Free slots per request: status 200 with ``slots``, or 404/422 with ``error``.

    The answer repeats the caller's listing id and date as written.  Slots are
    worked out once per listing and day, not per request.
    """
    checked = materialize(_checked(requests, listings, today), "checked")
    days = checked.select("id", "day").where(F.col("id").isNotNull() & F.col("day").isNotNull()).distinct()
    # a handful of slots per day, combined before the shuffle
    taken = _on_asked_days(ledger, checked).groupBy("id", "day").agg(F.collect_set("slot").alias("taken"))
    free = days.join(taken, ["id", "day"], "left").select(
        "id", "day", free_slots_array(slots_for(F.col("id"), F.col("day")), F.col("taken")).alias("slots")
    )
    answered = lookup(checked, free, ["id", "day"], spread=["request_id"])
    status = (
        F.when(F.col("id").isNull(), F.lit(404)).when(F.col("day").isNull(), F.lit(422)).otherwise(F.lit(200))
    )
    return answered.select(
        "request_id",
        "listing_id",
        "date",
        status.alias("status"),
        F.when(status == 404, F.format_string(K.MSG_LISTING_NOT_FOUND, F.col("listing_id")))
        .when(status == 422, F.col("date_error"))
        .alias("error"),
        F.when(status == 200, F.col("slots")).alias("slots"),
    )


#: When a request was made: order among requests.
MOMENT = "struct<requested_at:timestamp_ntz,request_id:bigint>"


def moment() -> Column:
    return F.struct(F.col("requested_at").cast("timestamp_ntz").alias("requested_at"), F.col("request_id").cast("bigint").alias("request_id"))


def before_all() -> Column:
    """A moment before every request: nulls sort first."""
    none = F.lit(None).cast(MOMENT)
    return F.struct(none["requested_at"].alias("requested_at"), none["request_id"].alias("request_id"))


def takers_by_day(first_takers: DataFrame) -> DataFrame:
    """(id, day, _takers): the first taker of each slot, from (id, day, slot, at); at most five a day."""
    first = F.when(F.col("slot").isNotNull(), F.struct("slot", "at"))
    return first_takers.groupBy("id", "day").agg(F.collect_list(first).alias("_takers"))


def decide(checked: DataFrame, days: DataFrame) -> DataFrame:
    """Answer checked requests, given the first takers of each day's slots.

    ``days`` may have a column ``closed``: nothing is left on such a day.
    """
    pools = days.withColumn("_pool", slots_for(F.col("id"), F.col("day")))
    decided = lookup(checked, pools, ["id", "day"], spread=["request_id"])
    here = moment()
    gone = F.transform(F.filter("_takers", lambda t: t["at"] < here), lambda t: t["slot"])
    left = free_slots_array(F.col("_pool"), gone)
    if "closed" in days.columns:
        left = F.when(F.col("closed"), F.array().cast(NO_SLOTS)).otherwise(left)
    rows = decided.withColumn("_left", left).withColumn(
        "status",
        F.when(F.col("id").isNull(), F.lit(404))
        .when(F.col("day").isNull(), F.lit(422))
        .when(F.array_contains("_left", F.col("slot")), F.lit(201))
        .otherwise(F.lit(409)),
    )
    left_text = F.when(F.size("_left") > 0, F.array_join("_left", ", ")).otherwise(F.lit(K.MSG_NO_SLOT_LEFT))
    error = (
        F.when(F.col("status") == 404, F.format_string(K.MSG_LISTING_NOT_FOUND, F.col("listing_id")))
        .when(F.col("status") == 422, F.col("date_error"))
        .when(F.col("status") == 409, F.format_string(K.MSG_SLOT_REFUSED, F.col("slot"), left_text))
    )
    booked = F.col("status") == 201
    record = {
        "booking_ref": booking_ref(F.col("id"), F.col("day"), F.col("slot")),
        "listing_id": F.col("id"),
        "title": F.col("title"),
        "address": F.col("address"),
        "date": F.col("day"),
        "slot": F.col("slot"),
        "name": py_strip(F.col("name")),
    }
    return rows.select(
        "request_id",
        "status",
        error.alias("error"),
        *[F.when(booked, value).alias(name) for name, value in record.items()],
    )


def clock(today) -> Column:
    """The day that dates are checked against: a fixed one, or without one the day each request was made."""
    return F.col("requested_at").cast("date") if today is None else as_date(today)


def checked_requests(requests: DataFrame, listings: DataFrame | ListingsById, today) -> DataFrame:
    """Requests with listing, checked date and trimmed slot, written once: what follows reads them several times."""
    return materialize(_checked(requests, listings, clock(today)).withColumn("slot", py_strip(F.col("slot"))), "checked")


def adjudicate(requests: DataFrame, listings: DataFrame | ListingsById, ledger: DataFrame, today=None) -> DataFrame:
    """Decide booking requests in the order (requested_at, request_id).

    404 unknown listing, 422 bad date, 409 slot not offered or taken (with the
    slots left at that moment), 201 booked.  Dates are checked against ``today``,
    without it against the day each request was made.  Per (listing, day) only the first
    taker of each slot matters, at most five rows; they are found by a combining
    minimum and handed to all requests of that day, so a day that everyone wants
    is not sorted in one task.
    """
    checked = checked_requests(requests, listings, today)
    known_slot = F.when(F.col("slot").isin(K.SLOT_POOL), F.col("slot"))
    new = checked.where(F.col("id").isNotNull() & F.col("day").isNotNull()).select(
        "id", "day", known_slot.alias("slot"), moment().alias("at")
    )
    # a slot booked in the ledger is taken before every new request
    earlier = _on_asked_days(ledger, checked).withColumn("at", before_all())
    first = new.unionByName(earlier).groupBy("id", "day", "slot").agg(F.min("at").alias("at"))
    return decide(checked, takers_by_day(first))


def accepted(decisions: DataFrame) -> DataFrame:
    """Ledger rows of the booked requests."""
    return decisions.where(F.col("status") == 201).drop("request_id", "status", "error")


def render_slots(answers: DataFrame) -> DataFrame:
    text = F.when(
        F.col("status") == 200, R.slots_text(F.col("listing_id"), F.col("date"), F.col("slots"))
    ).otherwise(R.error_text(F.col("status"), F.array("error"), F.lit(None).cast("string")))
    return answers.select("request_id", "status", text.alias("answer"))


def render_bookings(decisions: DataFrame) -> DataFrame:
    done = R.booking_text(*[F.col(c) for c in ["booking_ref", "listing_id", "title", "address", "date", "slot", "name"]])
    text = F.when(F.col("status") == 201, done).otherwise(
        R.error_text(F.col("status"), F.array("error"), F.lit(None).cast("string"))
    )
    return decisions.select("request_id", "status", text.alias("answer"))
