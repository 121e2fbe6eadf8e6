"""Batches of search and detail requests against the listing table."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions import render as R
from roomtrace.functions.text import district_key, py_strip
from roomtrace.operators.listings import recency
from roomtrace.plans.prefix import placed, running_sum
from roomtrace.plans.ranges import blocks_below, blocks_of_rank, levels_for
from roomtrace.plans.scratch import materialize
from roomtrace.plans.skew import lookup, top_k
from roomtrace.sources.by_id import ListingsById, known_listings
from roomtrace.sources.listings import LISTING_SCHEMA

def validate_search(requests: DataFrame) -> DataFrame:
    """Add ``limit`` default and ``status``: 200, or 422 for a value out of range."""
    limit = F.coalesce(F.col("limit"), F.lit(K.DEFAULT_LIMIT))
    negative = (
        (F.coalesce(F.col("max_price"), F.lit(0)) < 0)
        | (F.coalesce(F.col("min_area"), F.lit(0.0)) < 0)
        | F.isnan(F.coalesce(F.col("min_area").cast("double"), F.lit(0.0)))
        | (F.coalesce(F.col("max_days_old"), F.lit(0)) < 0)
    )
    out_of_range = negative | ~limit.between(K.MIN_LIMIT, K.MAX_LIMIT)
    return requests.withColumn("limit", limit).withColumn(
        "status", F.when(out_of_range, F.lit(422)).otherwise(F.lit(200))
    )


def _ranked(thresholds: list[DataFrame], values: list[DataFrame]) -> list[tuple[DataFrame, DataFrame, int]]:
    """For each kind of threshold ((v, rank) of thresholds, (v, rank) of values, levels of blocks for them).

    All tables have one column ``v``.  A value's rank is the number of distinct thresholds of its kind below it, a
    threshold's the number of ranks that it accepts.  Thresholds and values are sorted together and counted along the
    order, so any number of thresholds is served without gathering them anywhere.
    """
    kinds = range(len(thresholds))

    def told(df: DataFrame, kind: int, asked: int) -> DataFrame:
        # each kind has a column of its own, so that values keep their type
        own = [(F.col("v") if k == kind else F.lit(None).cast(thresholds[k].schema["v"].dataType)).alias(f"v{k}") for k in kinds]
        return df.where(F.col("v").isNotNull()).distinct().select(F.lit(kind).alias("_kind"), *own, F.lit(asked).alias("_asked"))

    rows = [told(df, k, asked) for asked, frames in ((1, thresholds), (0, values)) for k, df in enumerate(frames)]
    # at equal values the listing comes first: it is not above the threshold
    order = [f"v{k}" for k in kinds] + ["_asked"]
    ordered = placed(reduce(DataFrame.unionByName, rows), ["_kind"], order)
    counted = materialize(running_sum(ordered, ["_kind"], F.col("_asked"), "rank").drop("_part", "_place"), "ranks")
    counts = {r["_kind"]: r["n"] for r in counted.where("_asked = 1").groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    out = []
    for k in kinds:
        of_kind = [counted.where((F.col("_kind") == k) & (F.col("_asked") == asked)).select(F.col(f"v{k}").alias("v"), "rank") for asked in (1, 0)]
        out.append((*of_kind, levels_for(counts.get(k, 0))))
    return out


def _with_rank(rows: DataFrame, value: Column, ranks: DataFrame, name: str) -> DataFrame:
    """Rows with the rank of a value, null where the value is null."""
    keyed = ranks.select(F.col("v").alias("_v"), F.col("rank").alias(name))
    return rows.withColumn("_v", value).join(keyed, "_v", "left").drop("_v")


def _resolve_keys(filters: DataFrame, listings: DataFrame) -> DataFrame:
    """Pairs (asked key, listing key) where the asked key is a substring of the listing key.

    Works on distinct keys only: every listing key gives its substrings, of the
    lengths that are asked for, and these are matched by equality.
    """
    asked = filters.select(F.col("key").alias("asked_key")).distinct()
    lengths = asked.select(F.length("asked_key").alias("_n")).distinct()
    known = listings.select(F.col("district_key").alias("listing_key")).distinct()
    size = F.length("listing_key")
    substrings = (
        known.withColumn("_n", F.explode(F.sequence(F.lit(0), size)))
        .join(lengths, "_n", "left_semi")
        .withColumn("_from", F.explode(F.sequence(F.lit(1), size - F.col("_n") + 1)))
        .select("listing_key", F.expr("substring(listing_key, _from, _n)").alias("asked_key"))
        .distinct()
    )
    return substrings.join(asked, "asked_key", "left_semi")


def top_per_filter(filters: DataFrame, listings: DataFrame) -> DataFrame:
    """The first MAX_LIMIT listings for every distinct filter (key, max_price, min_area).

    Thresholds cut price and area into ranks; a filter accepts or refuses a
    whole rank.  So a listing outside the MAX_LIMIT newest of its (district,
    price rank, area rank) cell can never be in an answer, and the only pass over
    the listings keeps a few rows per cell, pruned before its shuffle.  The
    survivors are indexed by blocks of ranks (see plans.ranges) and filters look
    up a logarithmic number of blocks by equality.

    The age limit is not needed here: answers are newest first, so it only cuts
    an answer's tail.
    """
    # larger areas come first: "at least" becomes "at most"
    upside_down = lambda c: F.lit(0.0) - F.col(c)
    narrow = listings.select("district_key", "price_vnd", upside_down("area_m2").alias("_area"), "days_old", "row_index")
    (asked_prices, prices, price_levels), (asked_areas, areas, area_levels) = _ranked(
        [filters.select(F.col("max_price").cast("bigint").alias("v")), filters.select(upside_down("min_area").alias("v"))],
        [narrow.select(F.col("price_vnd").alias("v")), narrow.select(F.col("_area").alias("v"))],
    )
    cells = _with_rank(narrow, F.col("price_vnd"), prices, "_price_rank")
    cells = _with_rank(cells, F.col("_area"), areas, "_area_rank").drop("price_vnd", "_area")
    # a few rows per cell, written once: everything below reads only this small table
    cells = materialize(
        top_k(cells, ["district_key", "_price_rank", "_area_rank"], recency(), K.MAX_LIMIT).drop("rank"), "cells"
    )

    keys = _resolve_keys(filters, cells)
    # blocks of area ranks first, pruned, then blocks of price ranks: the copies stay few
    by_area = top_k(
        cells.join(keys, F.col("district_key") == F.col("listing_key"))
        .withColumnRenamed("asked_key", "key")
        .withColumn("_area_block", F.explode(blocks_of_rank(F.col("_area_rank"), area_levels))),
        ["key", "_price_rank", "_area_block"], recency(), K.MAX_LIMIT, rank="_n",
    )
    block = ["key", "_price_block", "_area_block"]
    by_block = top_k(
        by_area.withColumn("_price_block", F.explode(blocks_of_rank(F.col("_price_rank"), price_levels))),
        block, recency(), K.MAX_LIMIT, rank="_n",
    )
    # at most MAX_LIMIT rows per block, so an array of them is bounded
    blocks = by_block.groupBy(*block).agg(F.collect_list(F.struct("days_old", "row_index")).alias("_newest"))

    wanted = _with_rank(filters, F.col("max_price").cast("bigint"), asked_prices, "_prices")
    wanted = (
        _with_rank(wanted, upside_down("min_area"), asked_areas, "_areas")
        .withColumn("_price_block", F.explode(blocks_below(F.col("_prices"), price_levels)))
        .withColumn("_area_block", F.explode(blocks_below(F.col("_areas"), area_levels)))
        .select("filter", *block)
    )
    found = lookup(wanted, blocks, block, spread=["filter"], how="inner").select("filter", F.inline("_newest"))
    return top_k(found, ["filter"], recency(), K.MAX_LIMIT)


def search_batch(requests: DataFrame, listings: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Answers of many search requests: (request_id, rank, listing fields).

    Requests with equal filters share one answer; refused requests give no rows.
    Building the plan runs jobs, which write the requests in short form, the ranks of
    thresholds, the surviving listing keys, the answer per filter and the hits to the scratch folder.
    ``columns`` are the listing fields wanted, all by default.
    """
    columns = columns or [c for c in listings.columns if c != "row_index"]
    price = F.coalesce(F.col("max_price").cast("string"), F.lit("-"))
    area = F.coalesce(F.col("min_area").cast("string"), F.lit("-"))
    # no district and a district without letters or digits both become the empty key: no filter
    asked = (
        validate_search(requests)
        .where(F.col("status") == 200)
        .select(
            "request_id",
            district_key(F.coalesce(F.col("district"), F.lit(""))).alias("key"),
            "max_price", (F.col("min_area") + F.lit(0.0)).alias("min_area"), "max_days_old", "limit",
        )
        # null parameters are part of a filter's identity, so filters are joined by a text form
        .withColumn("filter", F.concat_ws("|", "key", price, area))
    )
    asked = materialize(asked, "asked")
    parts = ["filter", "key", "max_price", "min_area"]
    answers = (
        top_per_filter(asked.select(*parts).distinct(), listings)
        .groupBy("filter")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "days_old", "row_index"))).alias("_answer"))
    )
    matched = lookup(asked, materialize(answers, "answers"), ["filter"], spread=["request_id"], how="inner")
    hits = materialize(
        matched.select("request_id", "max_days_old", "limit", F.explode("_answer").alias("_hit"))
        .select("request_id", "max_days_old", "limit", "_hit.*")
        .where(F.col("rank") <= F.col("limit"))
        .where(F.col("max_days_old").isNull() | (F.col("days_old") <= F.col("max_days_old")))
        .select("request_id", "rank", "row_index"),
        "hits",
    )
    # wide columns only for listings that are in some answer
    shown = listings.select("row_index", *columns).join(
        hits.select("row_index").distinct(), "row_index", "left_semi"
    )
    return lookup(hits, shown, ["row_index"], spread=["request_id"], how="inner").select(
        "request_id", "rank", *columns
    )


def render_search(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One answer text per valid request; ``results`` come from search_batch."""
    lines = results.groupBy("request_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", R.listing_line().alias("line")))), lambda r: r["line"]
        ).alias("_lines")
    )
    valid = validate_search(requests).where(F.col("status") == 200)
    none = F.array().cast("array<string>")
    return valid.join(lines, "request_id", "left").select(
        "request_id",
        R.search_text(
            F.coalesce("_lines", none), F.col("district"), F.col("max_price"), F.col("max_days_old")
        ).alias("answer"),
    )


def details_batch(requests: DataFrame, listings: DataFrame | ListingsById) -> DataFrame:
    """Listing per (request_id, listing_id): status 200, or 404 with an error text."""
    asked = requests.withColumn("id", py_strip(F.col("listing_id")))
    found = known_listings(listings, asked, LISTING_SCHEMA.names if isinstance(listings, ListingsById) else listings.columns)
    found = found.withColumn("_found", F.lit(True))
    missing = F.col("_found").isNull()
    return (
        lookup(asked, found, ["id"], spread=["request_id"])
        .withColumn("status", F.when(missing, F.lit(404)).otherwise(F.lit(200)))
        .withColumn("error", F.when(missing, F.format_string(K.MSG_LISTING_NOT_FOUND, F.col("listing_id"))))
        .drop("_found")
    )


def render_details(details: DataFrame) -> DataFrame:
    """Detail text or error text per request of details_batch."""
    text = F.when(F.col("status") == 200, R.listing_details()).otherwise(
        R.error_text(F.col("status"), F.array("error"), F.lit(None).cast("string"))
    )
    return details.select("request_id", "status", text.alias("answer"))
