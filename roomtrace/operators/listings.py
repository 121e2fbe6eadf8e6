"""Cleaning, deduplication, profile and single-request search over listings."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions import listing as L
from roomtrace.functions.text import district_key, py_strip, scrub_phones
from roomtrace.plans.scratch import materialize


def as_timestamp(now: Column | dt.datetime | str) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def as_date(day: Column | dt.date | str) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def has_area(area: Column) -> Column:
    return area > 0


def credible_price(price: Column) -> Column:
    """Unknown prices pass."""
    return F.coalesce(price, F.lit(K.MIN_CREDIBLE_PRICE)) >= K.MIN_CREDIBLE_PRICE


def normalize(df: DataFrame, now, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Typed listing per credible raw row; rows without area or with a junk price are dropped.

    ``df`` has the crawl columns and ``row_index``; ``keep`` names further
    columns to carry along.  One narrow stage: the junk tests need only the
    cheap columns and come before the text work.
    """
    now = as_timestamp(now)
    rest = [c for c in K.RAW_COLUMNS if c not in (K.COL_AREA, K.COL_PRICE)]
    # the one-row inlines keep the optimizer from copying these expressions into the filters
    # below and evaluating them again for the result
    area = F.inline(F.array(F.struct(L.parse_area(F.col(K.COL_AREA)).alias("area_m2"))))
    amount = L.price_amount(F.col("price_label"), F.col("_number"), F.col("area_m2"))
    priced = (
        df.select(*keep, "row_index", *rest, K.COL_PRICE, area)
        .where(has_area(F.col("area_m2")))
        .select(*keep, "row_index", *rest, "area_m2", py_strip(F.col(K.COL_PRICE)).alias("price_label"))
        .withColumn("_number", L.price_number(F.col("price_label")))
        .select("*", F.inline(F.array(F.struct(amount.alias("price_vnd")))))
        .where(credible_price(F.col("price_vnd")))
        .select(
            *keep,
            "row_index",
            py_strip(F.col(K.COL_LINK)).alias("url"),
            py_strip(F.col(K.COL_TITLE)).alias("_title"),
            py_strip(F.col(K.COL_ADDRESS)).alias("address"),
            "price_label",
            py_strip(F.col(K.COL_DESCRIPTION)).alias("_description"),
            "area_m2",
            "price_vnd",
            L.parse_posted_at(F.col(K.COL_POSTED)).alias("posted_at"),
        )
    )
    named = priced.withColumn("district", L.district_of(F.col("address")))
    return named.select(
        *keep,
        "row_index",
        L.listing_id(F.col("url"), F.col("row_index")).alias("id"),
        scrub_phones(F.col("_title")).alias("title"),
        "price_vnd",
        "price_label",
        "area_m2",
        "district",
        district_key(F.col("district")).alias("district_key"),
        "address",
        L.extract_amenities(F.col("_title"), F.col("_description")).alias("amenities"),
        scrub_phones(F.col("_description")).alias("description"),
        "posted_at",
        L.days_old(F.col("posted_at"), now).alias("days_old"),
        "url",
    )


#: Rows of repeated keys among which the losers are sent to all tasks.
FEW_ROWS = 1_000_000


def _keep(df: DataFrame, key: Column, best) -> DataFrame:
    """One row per non-null key, the one with the ``best`` row index, and all rows without a key.

    Only numbers and keys are grouped, by a combining hash aggregation; the rows of the keys that occur more than once are
    written, and those that lose are taken out by their row index, which must be unique.  They are few as a rule,
    and then whole rows are not moved at all; if they are many, whole rows are dealt by row index, but not sorted.
    The keys are written when the plan is built.
    """
    narrow = materialize(df.select(key.alias("_key"), "row_index").where(F.col("_key").isNotNull()), "keys")
    counted = narrow.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    repeated = materialize(narrow.join(counted, "_key", "left_semi"), "repeated")
    winners = repeated.groupBy("_key").agg(best("row_index").alias("_best"))
    losers = repeated.join(winners, "_key").where(F.col("row_index") != F.col("_best")).select("row_index")
    losers = losers.hint("broadcast" if repeated.count() <= FEW_ROWS else "shuffle_hash")
    return df.join(losers, "row_index", "left_anti").select(df.columns)


def dedup_by_link(df: DataFrame) -> DataFrame:
    """First row per non-empty link; rows without a link are all kept."""
    return _keep(df, F.nullif(F.col("url"), F.lit("")), F.min)


def latest_by_id(df: DataFrame) -> DataFrame:
    """Last row per id: what a lookup by id sees."""
    return _keep(df, F.col("id"), F.max)


def load_listings(df: DataFrame, now) -> DataFrame:
    """Raw rows to clean, deduplicated listings (junk rows do not reserve their link)."""
    return dedup_by_link(normalize(df, now))


def listing_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("listings"))


def profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("price_vnd").isNull()).alias("without_price"),
        F.count_distinct("district").alias("districts"),
    )


def filter_listings(
    df: DataFrame,
    district: str | None = None,
    max_price: int | None = None,
    min_area: float | None = None,
    max_days_old: int | None = None,
) -> DataFrame:
    """Conjunctive filter; absent parameters and districts without letters or digits filter nothing."""
    if district:
        key = district_key(F.lit(district))
        df = df.where(F.contains(F.col("district_key"), key))
    if max_price is not None:
        df = df.where(F.col("price_vnd") <= max_price)
    if min_area is not None:
        df = df.where(F.col("area_m2") >= min_area)
    if max_days_old is not None:
        df = df.where(F.col("days_old") <= max_days_old)
    return df


def recency() -> list[Column]:
    """Newest first, unknown age last, then crawl order."""
    return [F.col("days_old").asc_nulls_last(), F.col("row_index").asc()]


def order_by_recency(df: DataFrame) -> DataFrame:
    return df.orderBy(*recency())


def search(df: DataFrame, district=None, max_price=None, min_area=None, max_days_old=None,
           limit: int = K.DEFAULT_LIMIT) -> DataFrame:
    """One search request: planned as a distributed top-k, not a full sort."""
    found = filter_listings(df, district, max_price, min_area, max_days_old)
    return order_by_recency(found).limit(limit)


def get_listing(df: DataFrame, listing_id: str) -> DataFrame:
    """The listing a trimmed id refers to; empty when there is none."""
    return df.where(F.col("id") == py_strip(F.lit(listing_id))).orderBy(F.desc("row_index")).limit(1)
