"""Adjudication against a one-request-at-a-time loop; ledger; streams."""

import datetime as dt
import random
import shutil

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog.queries import _keyed_state, _run
from roomtrace.functions import listing as L
from roomtrace.operators import bookings as BK
from roomtrace.operators.listings import as_date
from roomtrace.plans import skew
from roomtrace.plans.scratch import scratch_dir
from roomtrace.sources import ledger
from roomtrace.streaming.bookings import stream_bookings

TODAY = "2026-07-27"
SCHEMA = "request_id bigint, requested_at timestamp_ntz, listing_id string, date string, slot string, name string"


def _listings(spark):
    rows = [(i, f"pr{i}", f"t{i}", f"a{i}") for i in range(6)] + [(9, "pr3", "newer", "a")]
    return spark.createDataFrame(rows, "row_index bigint, id string, title string, address string")


def _requests(spark, n=400):
    rng = random.Random(5)
    slots = ["09:00", " 10:30", "14:00 ", "15:30", "17:00", "08:00"]
    days = ["2026-07-27", "2026-7-28", " 2026-07-29", "2026-07-01", "2026-12-01", "soon"]
    at = lambda: dt.datetime(2026, 7, 27, 8) + dt.timedelta(seconds=rng.randint(0, 60))
    rows = [
        (i, at(), rng.choice(["pr1", " pr2 ", "pr3", "pr4", "prX"] + ["pr0"] * 5), rng.choice(days),
         rng.choice(slots), f" n{i} ") for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _simulate(spark, rows):
    """Handle requests one by one with a growing ledger; slots and dates come from the engine."""
    frame = spark.createDataFrame(rows, SCHEMA)
    checked = L.validate_date(F.col("date"), as_date(TODAY))["date"]
    day = F.date_format(checked, "yyyy-MM-dd")
    pools = {
        r.request_id: (r.day, r.pool)
        for r in frame.select("request_id", day.alias("day"), BK.slots_for(F.trim("listing_id"), day).alias("pool")).collect()
    }
    taken, out = set(), {}
    for rid, at, listing, _, slot, name in sorted(rows, key=lambda r: (r[1], r[0])):
        day, pool = pools[rid]
        lid, slot = listing.strip(), slot.strip()
        if lid == "prX":
            out[rid] = (404, None)
        elif day is None:
            out[rid] = (422, None)
        else:
            left = [s for s in pool if (lid, day, s) not in taken]
            if slot in left:
                taken.add((lid, day, slot))
                out[rid] = (201, (lid, day, slot, name.strip()))
            else:
                out[rid] = (409, ", ".join(left) or "không còn khung nào")
    return out


def _outcomes(decisions):
    out = {}
    for r in decisions.collect():
        if r.status == 201:
            out[r.request_id] = (201, (r.listing_id, r.date, r.slot, r.name))
        elif r.status == 409:
            out[r.request_id] = (409, r.error.split("Còn trống: ")[1][:-1])
        else:
            out[r.request_id] = (r.status, None)
    return out


def test_adjudicate_equals_one_by_one(spark):
    rows, requests = _requests(spark)
    got = BK.adjudicate(requests, _listings(spark), ledger.empty_ledger(spark), TODAY)
    want = _simulate(spark, rows)
    assert _outcomes(got) == want
    assert {s for s, _ in want.values()} == {201, 404, 409, 422}


def test_adjudicate_with_a_hot_day(spark, monkeypatch):
    monkeypatch.setattr(skew.lookup, "__defaults__", ("left", 5))
    rows, requests = _requests(spark)
    got = BK.adjudicate(requests, _listings(spark), ledger.empty_ledger(spark), TODAY)
    assert _outcomes(got) == _simulate(spark, rows)


def test_title_comes_from_the_last_listing_with_the_id(spark):
    _, requests = _requests(spark)
    got = BK.adjudicate(requests, _listings(spark), ledger.empty_ledger(spark), TODAY)
    titles = {r.title for r in got.where("listing_id = 'pr3'").collect()}
    assert titles == {"newer"}


def test_batches_with_a_ledger_agree_with_one_pass(spark):
    rows, requests = _requests(spark)
    listings, path = _listings(spark), scratch_dir(spark, "ledger")
    ledger.reset_bookings(spark, path)
    out = {}
    for part in (F.second("requested_at") < 20, F.second("requested_at") >= 20):
        early = F.minute("requested_at") == 0
        batch = requests.where(part & early if part is not None else early)
        decisions = BK.adjudicate(batch, listings, ledger.read_bookings(spark, path), TODAY)
        out |= _outcomes(decisions)
        ledger.append_bookings(BK.accepted(decisions), path)
    in_time = [r for r in rows if r[1].minute == 0]
    assert out == _simulate(spark, in_time)
    stored = ledger.read_bookings(spark, path)
    assert stored.count() == stored.select("listing_id", "date", "slot").distinct().count() > 0
    ledger.reset_bookings(spark, path)
    assert ledger.read_bookings(spark, path).count() == 0


def test_free_slots_and_slot_answers(spark):
    offers = spark.createDataFrame([("a", "d", ["09:00", "14:00"]), ("b", "d", ["09:00"])],
                                   "listing_id string, date string, slots array<string>")
    booked = spark.createDataFrame([("r", "a", "t", "x", "d", "09:00", "n"), ("r", "b", "t", "x", "d", "09:00", "n")],
                                   ledger.LEDGER_SCHEMA)
    free = {r.listing_id: r.free for r in BK.free_slots(offers, booked).collect()}
    assert free == {"a": ["14:00"], "b": []}
    asked = spark.createDataFrame([(1, " pr0", "2026-7-28"), (2, "no", "2026-7-28"), (3, "pr0", "x")],
                                  "request_id bigint, listing_id string, date string")
    answers = BK.slots_batch(asked, _listings(spark), ledger.empty_ledger(spark), TODAY)
    rows = {r.request_id: r for r in answers.collect()}
    assert [rows[i].status for i in (1, 2, 3)] == [200, 404, 422]
    assert (rows[1].listing_id, rows[1].date) == (" pr0", "2026-7-28")
    assert rows[2].error == "Không tìm thấy tin đăng có mã 'no'."


def _portion(requests, portion):
    return requests.where((F.minute("requested_at") * 60 + F.second("requested_at")).between(portion * 21, portion * 21 + 20))


def _stream(spark, base, listings, today=TODAY, checkpoint="cp", source="in", out="out", **more):
    arriving = spark.readStream.schema(SCHEMA).parquet(f"{base}/{source}")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)  # a worker for each, at every start
    try:
        with _keyed_state(spark):
            _run(stream_bookings(arriving, listings, today, f"{base}/ledger", f"{base}/{out}", f"{base}/{checkpoint}", **more))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def _booked(spark, base):
    return sorted((r.listing_id, str(r.date), r.slot) for r in spark.read.parquet(f"{base}/ledger").collect())


def test_stream_agrees_with_batch_and_a_fresh_checkpoint_books_nothing_twice(spark):
    rows, requests = _requests(spark)
    listings, base = _listings(spark), scratch_dir(spark, "stream")
    for portion in range(3):
        _portion(requests, portion).write.mode("append").parquet(f"{base}/in")
        _stream(spark, base, listings)
    want = _simulate(spark, rows)
    assert _outcomes(spark.read.parquet(f"{base}/out")) == want
    held = _booked(spark, base)
    assert len(held) == len(set(held)) == sum(s == 201 for s, _ in want.values())
    # the same requests through a fresh checkpoint find their slots taken
    _stream(spark, base, listings, checkpoint="cp2", out="out2")
    again = _outcomes(spark.read.parquet(f"{base}/out2"))
    assert _booked(spark, base) == held and not any(s == 201 for s, _ in again.values())
    assert {k: s for k, (s, _) in again.items() if s != 409} == {k: s for k, (s, _) in want.items() if s in (404, 422)}
    # the ledger keeps one folder a run
    assert spark.read.parquet(f"{base}/ledger").select("run").distinct().count() == 1


def test_a_batch_that_dies_between_its_writes_is_decided_the_same_again(spark, monkeypatch):
    rows, requests = _requests(spark)
    listings, base = _listings(spark), scratch_dir(spark, "stream")
    plain, calls = BK.accepted, []

    def die(decisions):
        calls.append(1)
        if len(calls) in (1, 3):  # the first try of the first and of the second batch
            plain(decisions).withColumn("run", F.lit("x")).limit(0).count()
            raise RuntimeError("killed")
        return plain(decisions)

    monkeypatch.setattr(BK, "accepted", die)
    for portion in range(3):
        _portion(requests, portion).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            try:
                _stream(spark, base, listings)
                break
            except StreamingQueryException as error:
                assert "killed" in str(error)
    want = _simulate(spark, rows)
    assert len(calls) >= 5 and _outcomes(spark.read.parquet(f"{base}/out")) == want
    held = _booked(spark, base)
    assert len(held) == len(set(held)) == sum(s == 201 for s, _ in want.values())


def test_a_first_batch_that_dies_behind_its_ledger_write_does_not_meet_itself(spark, monkeypatch):
    rows, requests = _requests(spark)
    listings, base = _listings(spark), scratch_dir(spark, "stream")
    requests.write.parquet(f"{base}/in")
    _stream(spark, base, listings)
    # the checkpoint as it was before the first batch was committed: Spark decides that batch again
    shutil.copytree(f"{base}/cp", f"{base}/before", ignore=shutil.ignore_patterns("commits"))
    _stream(spark, base, listings, checkpoint="before")
    assert _outcomes(spark.read.parquet(f"{base}/out")) == _simulate(spark, rows)
    held = _booked(spark, base)
    assert len(held) == len(set(held)) and spark.read.parquet(f"{base}/ledger").select("run").distinct().count() == 1


def test_stream_whose_first_batch_books_nothing(spark):
    listings, base = _listings(spark), scratch_dir(spark, "stream")
    at = dt.datetime(2026, 7, 27, 8)
    slot = spark.range(1).select(BK.slots_for(F.lit("pr1"), F.lit("2026-07-28"))[0].alias("s")).first().s
    for i, listing in enumerate(["nowhere", "pr1", "pr1"]):
        rows = [(i, at, listing, "2026-07-28", slot, "n")]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
        _stream(spark, base, listings)
    got = {r.request_id: r.status for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {0: 404, 1: 201, 2: 409}


def test_stream_starts_from_earlier_bookings(spark):
    listings, base = _listings(spark), scratch_dir(spark, "stream")
    at = dt.datetime(2026, 7, 27, 8)
    offered = spark.range(1).select(BK.slots_for(F.lit("pr1"), F.lit("2026-07-28")).alias("s")).first().s
    held = spark.createDataFrame([("r", "pr1", "t", "x", "2026-07-28", offered[0], "n")], ledger.LEDGER_SCHEMA)
    for i, slot in enumerate([offered[0], offered[1], offered[0]]):
        spark.createDataFrame([(i, at, "pr1", "2026-07-28", slot, "n")], SCHEMA).write.mode("append").parquet(f"{base}/in")
        _stream(spark, base, listings, booked=held)
    assert {r.request_id: r.status for r in spark.read.parquet(f"{base}/out").collect()} == {0: 409, 1: 201, 2: 409}


def test_state_of_past_days_expires_and_late_requests_find_nothing_left(spark):
    listings, base = _listings(spark), scratch_dir(spark, "stream")
    offered = spark.range(1).select(BK.slots_for(F.lit("pr1"), F.lit("2026-07-28")).alias("s")).first().s
    far = spark.range(1).select(BK.slots_for(F.lit("pr1"), F.lit("2026-08-02")).alias("s")).first().s
    at = lambda day, hour: dt.datetime(2026, 7, day, hour)
    portions = [
        [(1, at(27, 8), "pr1", "2026-07-28", offered[0], "n")],
        [(2, at(28, 9), "pr1", "2026-07-28", offered[0], "n"), (3, at(28, 9), "pr1", "2026-07-28", "08:00", "n")],
        [(4, at(31, 9), "pr1", "2026-08-02", far[0], "n")],
        # its day was open when it was made, but the watermark has passed it; another late one asks for a day still open
        [(5, at(27, 9), "pr1", "2026-07-28", offered[1], "n"), (6, at(27, 9), "pr1", "2026-08-02", far[0], "n"), (7, at(27, 9), "pr1", "2026-08-02", far[1], "n")],
        [(8, at(31, 10), "pr1", "2026-07-28", offered[1], "n")],
    ]
    for rows in portions:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
        _stream(spark, base, listings, today=None)
    got = {r.request_id: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert {k: r.status for k, r in got.items()} == {1: 201, 2: 409, 3: 409, 4: 201, 5: 409, 6: 409, 7: 201, 8: 422}
    assert offered[0] not in got[3].error.split("trống")[1] and offered[1] in got[3].error and "không còn khung nào" in got[5].error
    keys = spark.read.format("statestore").option("stateVarName", "held").load(f"{base}/cp").select("key.day").distinct().collect()
    assert [r.day for r in keys] == ["2026-08-02"]


def test_each_request_has_its_own_clock(spark):
    rows, requests = _requests(spark)
    later = requests.withColumn("requested_at", F.expr("requested_at + make_dt_interval(cast(request_id % 3 as int))"))
    listings, none = _listings(spark), ledger.empty_ledger(spark)
    got = {r.request_id: r for r in BK.adjudicate(later, listings, none).collect()}
    days = {r.request_id: r.d for r in later.select("request_id", F.to_date("requested_at").alias("d")).collect()}
    fixed = {d: {r.request_id: r for r in BK.adjudicate(later, listings, none, d).collect()} for d in set(days.values())}
    assert len(fixed) == 3
    refused = lambda r: r.error if r.status in (404, 422) else None
    assert {k: refused(r) for k, r in got.items()} == {k: refused(fixed[days[k]][k]) for k in got}
