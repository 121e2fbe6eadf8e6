"""One query per operator over the given tables (see catalog.fixtures for the inputs)."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import fixtures as X
from roomtrace import constants as K
from roomtrace.functions import agent as A
from roomtrace.functions import listing as L
from roomtrace.functions import render as R
from roomtrace.functions import text as TX
from roomtrace.operators import bookings as BK
from roomtrace.operators import conversation as CV
from roomtrace.operators import evaluate as EV
from roomtrace.operators import listings as LS
from roomtrace.operators import search as SE
from roomtrace.operators import traces as TR
from roomtrace.operators.registry import OPERATORS
from roomtrace.plans.scratch import scratch_dir
from roomtrace.sources import cases, ledger
from roomtrace.sources import listings as SRC
from roomtrace.streaming.bookings import STATE_STORE, stream_bookings
from roomtrace.streaming.listings import stream_listings

col = F.col
#: Rows of a crawl file.
CRAWL_ROWS = 500_000
PROMPT_TEMPLATE = "Hôm nay là {today} ({weekday}). Ngày mai là {tomorrow}."


def joined(c, sep="; "):
    return F.array_join(c, sep)


def flat_listing(df: DataFrame, *extra: str) -> DataFrame:
    """All listing fields with types that compare alike in both engines."""
    return df.select(
        *extra, "row_index", "id", "title", "price_vnd", "price_label", "area_m2", "district", "district_key",
        "address", joined("amenities").alias("amenities"), "description",
        L.iso_timestamp(col("posted_at")).alias("posted_at"), "days_old", "url",
    )


# --- sources and sinks --------------------------------------------------------

def _write_crawl(spark: SparkSession, sf_dir: str) -> str:
    """The raw listings as CSV files with byte-order mark, in row order: four files, or more for many rows."""
    path = scratch_dir(spark, "crawl")
    raw = X.raw_listings(spark, sf_dir)
    n_files = max(4, -(-raw.count() // CRAWL_ROWS))
    raw = raw.repartitionByRange(n_files, "row_index").sortWithinPartitions("row_index")
    files = raw.drop("row_index").withColumnRenamed(K.COL_POSTED, "﻿" + K.COL_POSTED)
    files.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def _crawl_texts(df: DataFrame, *extra: str) -> DataFrame:
    names = ["posted", "title", "price", "area", "address", "descr", "link"]
    return df.select(*extra, *[F.coalesce(col(c), F.lit("")).alias(n) for c, n in zip(K.RAW_COLUMNS, names)])


def a1_read_listings(spark, sf_dir):
    return _crawl_texts(SRC.read_listings(spark, _write_crawl(spark, sf_dir)))


def a2_with_row_index(spark, sf_dir):
    rows = SRC.with_row_index(SRC.read_listings(spark, _write_crawl(spark, sf_dir)))
    return _crawl_texts(rows, "row_index")


def a3_read_test_cases(spark, sf_dir):
    path = scratch_dir(spark, "cases")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    record = F.struct(
        col("item_id").alias("id"), F.concat(F.lit("group "), (col("item_id") % 7).cast("string")).alias("category"),
        col("text").alias("question"), F.length("text").cast("string").alias("expected_behavior"),
    )
    arrays = (
        items.withColumn("part", F.floor(col("item_id") / 100))  # one file per hundred cases
        .groupBy("part")
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(record)), ","), F.lit("]")).alias("value"))
    )
    arrays.write.partitionBy("part").text(path)
    return cases.read_test_cases(spark, path)


def a4_write_read_normalized(spark, sf_dir):
    path = scratch_dir(spark, "listings")
    SRC.write_listings(X.listings(spark, sf_dir), path)
    return flat_listing(SRC.read_normalized(spark, path))


def _ledger_table(spark, sf_dir) -> str:
    path = scratch_dir(spark, "ledger")
    ledger.append_bookings(BK.accepted(X.decisions(spark, sf_dir)), path)
    return path


def a5_append_bookings(spark, sf_dir):
    return ledger.read_bookings(spark, _ledger_table(spark, sf_dir))


def a6_reset_bookings(spark, sf_dir):
    path = _ledger_table(spark, sf_dir)
    before = ledger.read_bookings(spark, path).agg(F.count("*").alias("n_before"))
    n_before = before.first().n_before
    ledger.reset_bookings(spark, path)
    return ledger.read_bookings(spark, path).agg(F.count("*").alias("n_after")).withColumn(
        "n_before", F.lit(n_before).cast("bigint")
    )


# --- scalar functions ---------------------------------------------------------

def _raw(spark, sf_dir, **columns):
    return X.raw_listings(spark, sf_dir).select("row_index", *[c.alias(n) for n, c in columns.items()])


def _area():
    return L.parse_area(col(K.COL_AREA))


def _price():
    return L.parse_price(col(K.COL_PRICE), _area())


def _posted():
    return L.parse_posted_at(col(K.COL_POSTED))


def b1_strip_accents(spark, sf_dir):
    return _raw(spark, sf_dir, title=TX.strip_accents(col(K.COL_TITLE)))


def b2_district_key(spark, sf_dir):
    return _raw(spark, sf_dir, key=TX.district_key(col(K.COL_ADDRESS)))


def b3_parse_price(spark, sf_dir):
    return _raw(spark, sf_dir, price_vnd=_price())


def b4_parse_area(spark, sf_dir):
    return _raw(spark, sf_dir, area_m2=_area())


def b5_parse_posted_at(spark, sf_dir):
    return _raw(spark, sf_dir, posted=F.date_format(_posted(), "yyyy-MM-dd HH:mm"))


def b6_extract_amenities(spark, sf_dir):
    return _raw(spark, sf_dir, amenities=joined(L.extract_amenities(col(K.COL_TITLE), TX.py_strip(col(K.COL_DESCRIPTION)))))


def b7_scrub_phones(spark, sf_dir):
    return _raw(spark, sf_dir, title=TX.scrub_phones(col(K.COL_TITLE)), descr=TX.scrub_phones(col(K.COL_DESCRIPTION)))


def b8_listing_id(spark, sf_dir):
    return _raw(spark, sf_dir, id=L.listing_id(TX.py_strip(col(K.COL_LINK)), col("row_index")))


def b9_district_of(spark, sf_dir):
    return _raw(spark, sf_dir, district=L.district_of(TX.py_strip(col(K.COL_ADDRESS))))


def b10_days_old(spark, sf_dir):
    return _raw(spark, sf_dir, days_old=L.days_old(_posted(), LS.as_timestamp(X.NOW)))


def b11_py_strip(spark, sf_dir):
    return _raw(spark, sf_dir, descr=TX.py_strip(col(K.COL_DESCRIPTION)))


def b12_iso_timestamp(spark, sf_dir):
    return _raw(spark, sf_dir, posted_at=L.iso_timestamp(_posted()))


def b13_normalize(spark, sf_dir):
    return flat_listing(LS.normalize(X.raw_listings(spark, sf_dir), X.NOW))


def b14_validate_date(spark, sf_dir):
    check = L.validate_date(col("date"), LS.as_date(X.TODAY))
    return X.booking_requests(spark, sf_dir).select("request_id", check.alias("c")).select(
        "request_id", col("c.date").cast("string").alias("day"), col("c.error").alias("error")
    )


# --- filters --------------------------------------------------------------------

def c1_drop_without_area(spark, sf_dir):
    return _raw(spark, sf_dir, area_m2=_area()).where(LS.has_area(col("area_m2")))


def c2_drop_junk_price(spark, sf_dir):
    return _raw(spark, sf_dir, price_vnd=_price()).where(LS.credible_price(col("price_vnd")))


def _filtered(spark, sf_dir, **asked):
    return LS.filter_listings(X.listings(spark, sf_dir), **asked).select(
        "row_index", "district_key", "price_vnd", "area_m2", "days_old"
    )


def c3_filter_district(spark, sf_dir):
    return _filtered(spark, sf_dir, district="TỪ LIÊM")


def c4_filter_max_price(spark, sf_dir):
    return _filtered(spark, sf_dir, max_price=3_500_000)


def c5_filter_min_area(spark, sf_dir):
    return _filtered(spark, sf_dir, min_area=16.18)


def c6_filter_max_days_old(spark, sf_dir):
    return _filtered(spark, sf_dir, max_days_old=7)


def c7_get_listing(spark, sf_dir):
    return flat_listing(LS.get_listing(X.listings(spark, sf_dir), "  pr700081 "))


def c8_validate_search(spark, sf_dir):
    return SE.validate_search(X.search_requests(spark, sf_dir)).select(
        "request_id", col("limit").alias("row_limit"), "status"
    )


# --- keyed state, joins, aggregates ----------------------------------------------

def d1_dedup_by_link(spark, sf_dir):
    return flat_listing(LS.dedup_by_link(LS.normalize(X.raw_listings(spark, sf_dir), X.NOW)))


def d2_latest_by_id(spark, sf_dir):
    return flat_listing(LS.latest_by_id(X.listings(spark, sf_dir)))


def _offers(spark, sf_dir) -> DataFrame:
    """Offered slots of every listing and valid day asked for."""
    asked = X.booking_requests(spark, sf_dir).select(
        TX.py_strip(col("listing_id")).alias("listing_id"),
        L.validate_date(col("date"), LS.as_date(X.TODAY))["date"].cast("string").alias("date"),
    )
    return asked.where(col("date").isNotNull()).distinct().withColumn(
        "slots", BK.slots_for(col("listing_id"), col("date"))
    )


def e1_free_slots(spark, sf_dir):
    booked = BK.accepted(X.decisions(spark, sf_dir))
    return BK.free_slots(_offers(spark, sf_dir), booked).withColumn("free", joined("free"))


def _search(spark, sf_dir, columns=None):
    return SE.search_batch(X.search_requests(spark, sf_dir), X.listings(spark, sf_dir), columns)


def e2_search_batch(spark, sf_dir):
    return _search(spark, sf_dir, ["id", "price_vnd", "area_m2", "district", "days_old", "description"])


def _detail_requests(spark, sf_dir):
    return X.booking_requests(spark, sf_dir).select("request_id", "listing_id")


def e3_details_batch(spark, sf_dir):
    return SE.details_batch(_detail_requests(spark, sf_dir), X.listings_by_id(spark, sf_dir)).select(
        "request_id", "status", "title", "price_vnd", "url", "error"
    )


def e4_booking_enrichment(spark, sf_dir):
    return X.decisions(spark, sf_dir).where(col("status") == 201).select(
        "request_id", "listing_id", "title", "address"
    )


def f1_listing_count(spark, sf_dir):
    return LS.listing_count(X.listings(spark, sf_dir))


def f2_profile(spark, sf_dir):
    return LS.profile(X.listings(spark, sf_dir))


def f3_answer_lines(spark, sf_dir):
    answers = SE.render_search(X.search_requests(spark, sf_dir), _search(spark, sf_dir))
    return answers.where(F.startswith(col("answer"), F.lit("Tìm thấy"))).withColumn(
        "n_lines", F.size(F.split("answer", "\n"))
    )


# --- windows -----------------------------------------------------------------------

def _segments(spark, sf_dir):
    return CV.session_segments(X.turns(spark, sf_dir))


def g1_intent_lookback(spark, sf_dir):
    return CV.intent_in_context(_segments(spark, sf_dir)).select("conv_id", "turn", "intent_in_context")


def g2_history_block(spark, sf_dir):
    return CV.history_block(_segments(spark, sf_dir)).select("conv_id", "turn", "history")


def g3_booking_conflicts(spark, sf_dir):
    return X.decisions(spark, sf_dir).where(col("status").isin(201, 409)).select("request_id", "status", "slot")


def g4_session_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select(
        "conv_id", "turn", "query", "mode", "remembered", "segment_id", "position"
    )


def _classified(spark, sf_dir):
    return TR.classify_steps(X.steps(spark, sf_dir))


def g5_transcript_at(spark, sf_dir):
    header = F.concat(F.lit(K.QUESTION_PREFIX), col("question"), F.lit("\n"))
    return TR.transcript_at(_classified(spark, sf_dir), header).select("trace_id", "step", "transcript")


def g5_transcript_in_conversation(spark, sf_dir):
    """Transcripts that begin with the prompt of the conversation: system prompt, history, question."""
    steps = X.steps(spark, sf_dir).join(X.asked(spark, sf_dir), "trace_id")
    prompts = CV.assemble_prompts(CV.history_block(_segments(spark, sf_dir)), PROMPT_TEMPLATE, X.TODAY)
    prompted = CV.prompt_of_steps(steps, prompts, PROMPT_TEMPLATE, X.TODAY)
    return TR.transcript_at(TR.classify_steps(prompted), col("prompt")).select("trace_id", "step", "transcript")


def g6_resolve_attempts(spark, sf_dir):
    return TR.resolve_attempts(X.attempts(spark, sf_dir))


# --- order and top-k ----------------------------------------------------------------

def h1_order_by_recency(spark, sf_dir):
    return LS.order_by_recency(X.listings(spark, sf_dir)).select("row_index", "days_old")


def h2_search(spark, sf_dir):
    found = LS.search(X.listings(spark, sf_dir), district="cau giay", min_area=15, limit=20)
    return flat_listing(found)


def h3_top_k_per_request(spark, sf_dir):
    return _search(spark, sf_dir, ["id"])


def case5_search(spark, sf_dir):
    """Raw crawl to answer: rooms in one district, below 4 million, at most 7 days old."""
    found = LS.search(
        LS.load_listings(X.raw_listings(spark, sf_dir), X.NOW),
        district="Nam Từ Liêm", max_price=4_000_000, max_days_old=7,
    )
    return found.select("row_index", R.listing_line().alias("line"))


# --- sets, slots, bookings ------------------------------------------------------------

def i1_distinct_labels(spark, sf_dir):
    twice = L.extract_amenities(col(K.COL_TITLE), col(K.COL_TITLE))
    return _raw(spark, sf_dir, amenities=joined(twice), n=F.size(twice))


def i2_free_slots_array(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    taken = F.array(F.lit("09:00"), F.lit("14:00"))
    return offers.select("listing_id", "date", joined(BK.free_slots_array(col("slots"), taken)).alias("free"))


def l1_slots_for(spark, sf_dir):
    return _offers(spark, sf_dir).withColumn("slots", joined("slots"))


def _slot_answers(spark, sf_dir):
    booked = BK.accepted(X.decisions(spark, sf_dir))
    return BK.slots_batch(X.slot_requests(spark, sf_dir), X.listings_by_id(spark, sf_dir), booked, X.TODAY)


def l2_slots_batch(spark, sf_dir):
    return _slot_answers(spark, sf_dir).withColumn("slots", joined("slots"))


def l3_booking_ref(spark, sf_dir):
    return X.booking_requests(spark, sf_dir).select(
        "request_id", BK.booking_ref(col("listing_id"), col("date"), col("slot")).alias("booking_ref")
    )


def l4_adjudicate(spark, sf_dir):
    return BK.adjudicate(
        X.booking_requests(spark, sf_dir), X.listings_by_id(spark, sf_dir), ledger.empty_ledger(spark), X.TODAY
    )


# --- text functions over agent output ----------------------------------------------------

def _steps(spark, sf_dir, **columns):
    return X.steps(spark, sf_dir).select("trace_id", "step", *[c.alias(n) for n, c in columns.items()])


def _output():
    return A.truncate_at_observation(col("raw_output"))


def j1_truncate_at_observation(spark, sf_dir):
    return _steps(spark, sf_dir, output=_output())


def j2_parse_action(spark, sf_dir):
    return _steps(spark, sf_dir, c=A.parse_action(_output())).select("trace_id", "step", "c.*")


def j3_split_arguments(spark, sf_dir):
    rows = _steps(spark, sf_dir, a=A.split_arguments(A.parse_action(_output())["raw_args"]))
    return rows.select(
        "trace_id", "step",
        F.size("a").alias("n_args"),
        F.array_join(F.transform("a", lambda x: x["text"]), "|").alias("texts"),
        F.array_join(F.transform("a", lambda x: F.coalesce(x["int_value"].cast("string"), F.lit("-"))), "|").alias("ints"),
    ).where(col("n_args") >= 0)


def j4_final_answer(spark, sf_dir):
    return _steps(spark, sf_dir, answer=A.final_answer(_output()))


def j5_is_provider_error(spark, sf_dir):
    return X.attempts(spark, sf_dir).select(
        "trace_id", "step", "attempt", A.is_provider_error(col("raw_output")).alias("is_error")
    )


def j6_is_transient(spark, sf_dir):
    return X.attempts(spark, sf_dir).select(
        "trace_id", "step", "attempt", A.is_transient(col("raw_output")).alias("transient")
    )


def j7_has_booking_intent(spark, sf_dir):
    return X.turns(spark, sf_dir).select("conv_id", "turn", A.has_booking_intent(col("question")).alias("intent"))


def j8_classify_call(spark, sf_dir):
    return TR.classify_calls(TR.parse_steps(X.steps(spark, sf_dir))).select(
        "trace_id", "step", "tool", "call_outcome", "refusal"
    )


def j8_guard_in_conversation(spark, sf_dir):
    """Calls judged by the booking intent of the conversation they belong to."""
    steps = X.steps(spark, sf_dir).join(X.asked(spark, sf_dir), "trace_id")
    known = CV.intent_of_steps(steps, CV.intent_in_context(_segments(spark, sf_dir)))
    return TR.classify_calls(TR.parse_steps(known), col("intent")).select(
        "trace_id", "step", "tool", "intent", "call_outcome", "refusal"
    )


def j9_classify_steps(spark, sf_dir):
    return _classified(spark, sf_dir).select("trace_id", "step", "outcome", "answer")


def j10_summarize_traces(spark, sf_dir):
    return TR.summarize_traces(_classified(spark, sf_dir))


def j11_route_by_rules(spark, sf_dir):
    return X.turns(spark, sf_dir).select("conv_id", "turn", A.route_by_rules(col("question")).alias("route"))


def j12_date_context(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    context = A.date_context(col("o_orderdate").cast("date"))
    return orders.select("o_orderkey", context.alias("c")).select("o_orderkey", "c.*")


def j13_assemble_prompts(spark, sf_dir):
    history = CV.history_block(_segments(spark, sf_dir))
    return CV.assemble_prompts(history, PROMPT_TEMPLATE, X.TODAY).select("conv_id", "turn", "mode", "prompt")


# --- answer texts ----------------------------------------------------------------------------

def k1_age_label(spark, sf_dir):
    return X.listings(spark, sf_dir).select("row_index", R.age_label(col("days_old")).alias("age"))


def k2_listing_line(spark, sf_dir):
    return X.listings(spark, sf_dir).select("row_index", R.listing_line().alias("line"))


def k3_render_search(spark, sf_dir):
    return SE.render_search(X.search_requests(spark, sf_dir), _search(spark, sf_dir))


def k4_render_details(spark, sf_dir):
    return SE.render_details(SE.details_batch(_detail_requests(spark, sf_dir), X.listings(spark, sf_dir)))


def k5_render_slots(spark, sf_dir):
    return BK.render_slots(_slot_answers(spark, sf_dir))


def k6_render_booking(spark, sf_dir):
    return BK.render_bookings(X.decisions(spark, sf_dir)).where(col("status") == 201)


def k7_render_error(spark, sf_dir):
    """Refusals with one message, several messages, and none but a response body."""
    refused = X.decisions(spark, sf_dir).where(col("status") != 201)
    none = F.array().cast("array<string>")
    details = (
        F.when(col("request_id") % 3 == 0, F.array("error"))
        .when(col("request_id") % 3 == 1, F.array(col("error"), F.lit("x")))
        .otherwise(none)
    )
    return refused.select(
        "request_id", R.error_text(col("status"), details, F.repeat(col("error"), 5)).alias("answer")
    )


def k8_fixed_texts(spark, sf_dir):
    classified = _classified(spark, sf_dir)
    refused = classified.where(col("outcome") == "write_refused").select("trace_id", col("refusal").alias("text"))
    capped = TR.summarize_traces(classified).where(col("outcome") == "max_iterations")
    return refused.unionByName(capped.select("trace_id", col("answer").alias("text")))


# --- streams -----------------------------------------------------------------------------------

def _run(writer, checkpoint: str | None = None) -> None:
    """Start a writer, work off what is there and stop."""
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


@contextmanager
def _keyed_state(spark):
    """The state store that keyed state with timers needs."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def m1_stream_listings(spark, sf_dir):
    base = scratch_dir(spark, "m1")
    raw = X.raw_listings(spark, sf_dir)
    at, k = F.lit(X.NOW).cast("timestamp"), col("row_index")
    late = k % 89 == 0
    # three crawls six hours apart, and a junk row days later that moves the watermark past them; then rows from before
    hours = F.make_dt_interval(hours=((k % 3) * 6).cast("int"))
    in_time = raw.where(~late).withColumn("crawled_at", at + hours)
    junk = raw.limit(1).withColumn(K.COL_AREA, F.lit("")).withColumn("crawled_at", at + F.expr("INTERVAL 5 DAYS"))
    behind = raw.where(late).withColumn("crawled_at", at - F.expr("INTERVAL 2 DAYS"))
    for portion in (in_time.unionByName(junk), behind):
        portion.write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(portion.schema).parquet(f"{base}/in")
        with _keyed_state(spark):
            clean = stream_listings(arriving)
            _run(clean.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    out = spark.read.schema(clean.schema).parquet(f"{base}/out")
    crawled = L.iso_timestamp(col("crawled_at").cast("timestamp_ntz"))
    return flat_listing(out.withColumn("crawled", crawled), "kind", "crawled")


def m2_stream_bookings(spark, sf_dir):
    base = scratch_dir(spark, "m2")
    requests = X.booking_requests(spark, sf_dir)
    # requests arrive in three portions, one after the other in time; the stream restarts for each
    hour = F.floor(F.timestamp_diff("SECOND", F.lit(X.NOW).cast("timestamp_ntz"), col("requested_at")) / 36_000)
    for portion in range(3):
        requests.where(hour == portion).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(requests.schema).parquet(f"{base}/in")
        with _keyed_state(spark):
            _run(stream_bookings(arriving, X.listings_by_id(spark, sf_dir), X.TODAY, f"{base}/ledger", f"{base}/decisions", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/decisions").drop("run", "batch")


# --- registry and checks ---------------------------------------------------------------------------

def n1_tool_registry(spark, sf_dir):
    """Registered tools with their bounds and how often recorded steps call them."""
    calls = TR.parse_steps(X.steps(spark, sf_dir)).groupBy("tool").agg(F.count("*").alias("calls"))
    return TR.tool_registry(spark).join(calls, "tool", "left").select(
        "tool", "min_args", "max_args", "is_write", F.coalesce("calls", F.lit(0)).alias("calls")
    )


def n1_operators(spark, sf_dir):
    """A table operation picked by name."""
    return OPERATORS["profile"](OPERATORS["load_listings"](X.raw_listings(spark, sf_dir), X.NOW))


def _expectations(spark, sf_dir):
    path = ["search_listings", "get_listing_details", "check_viewing_slots", "book_viewing"]
    parts = [F.array(*[F.lit(p) for p in chosen]) for chosen in (path[:2], path, path[2:])]
    expected = F.when(col("trace_id") % 3 == 0, parts[0]).when(col("trace_id") % 3 == 1, parts[1]).otherwise(parts[2])
    return X.steps(spark, sf_dir).select("trace_id").distinct().withColumn("expected", expected)


def o1_check_tool_path(spark, sf_dir):
    return EV.check_tool_path(_classified(spark, sf_dir), _expectations(spark, sf_dir)).select(
        "trace_id", joined("called", ",").alias("called"), "follows_path"
    )


def o2_check_grounding(spark, sf_dir):
    return EV.check_grounding(_classified(spark, sf_dir)).select(
        "trace_id", joined("ungrounded", ",").alias("ungrounded"), "grounded"
    )


def o3_repeated_actions(spark, sf_dir):
    return EV.find_repeated_actions(_classified(spark, sf_dir)).withColumn("arguments", joined("arguments", "|"))


def o4_slot_before_book(spark, sf_dir):
    return EV.check_slot_before_book(_classified(spark, sf_dir))


def o5_flag_fabricated(spark, sf_dir):
    return EV.flag_fabricated(X.steps(spark, sf_dir)).select("trace_id", "step", "fabricated")


def o6_check_baseline(spark, sf_dir):
    return EV.check_baseline(X.runs(spark, sf_dir))


QUERIES = {
    name: f for name, f in list(globals().items())
    if callable(f) and name[0] in "abcdefghijklmno" and name.split("_")[0][1:].isdigit()
} | {"case5_search": case5_search}
