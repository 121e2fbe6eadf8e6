"""Continuous booking arbitration with keyed state and event-time timers."""

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from roomtrace.functions.listing import validate_date
from roomtrace.functions.text import py_strip
from roomtrace.operators import bookings as BK
from roomtrace.plans.scratch import materialize
from roomtrace.sources.by_id import ListingsById
from roomtrace.sources.ledger import LEDGER_SCHEMA

STORED_SCHEMA = T.StructType(
    [*LEDGER_SCHEMA.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
)
#: Keyed state with timers lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CONTENDERS = "id string, day string, slot string, at long, request_id long, closes long"
_TAKERS = "id string, day string, slot string, at long, request_id long, closed boolean"


class SlotKeeper(StatefulProcessor):
    """Who holds each slot of one (listing, day).

    The state is a map from slot to its holder.  It is dropped by a timer once no
    request that is in time can ask for the day: when the watermark has passed
    its end.  Every call tells the holders as they are after the batch: those of earlier
    batches without a moment, new ones with theirs.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot string", "request_id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names that Spark calls by
        first, closes = {}, None
        for chunk in rows:
            for slot, at, request_id, ends in zip(chunk["slot"], chunk["at"], chunk["request_id"], chunk["closes"]):
                closes = int(ends)
                if slot is not None and (slot not in first or (at, request_id) < first[slot]):
                    first[slot] = (int(at), int(request_id))
        closed = timerValues.getCurrentWatermarkInMs() >= closes
        takers = [] if closed else [(k[0], None, v[0]) for k, v in self.held.iterator()]
        earlier = {slot for slot, _, _ in takers}
        if not closed:
            for slot, (at, request_id) in first.items():
                if slot not in earlier:
                    self.held.updateValue((slot,), (request_id,))
                    takers.append((slot, at, request_id))
            if takers:
                self.handle.registerTimer(closes)
        # a day that is touched is told of even if all its slots are free
        yield self._rows(key, takers or [(None, None, None)], closed)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for slot, closes in zip(initialState["slot"], initialState["closes"]):
            self.held.updateValue((slot,), (None,))
        self.handle.registerTimer(int(closes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, takers, closed) -> pd.DataFrame:
        n = len(takers)
        slots, moments, requests = zip(*takers) if takers else ((), (), ())
        return pd.DataFrame(
            {
                "id": [key[0]] * n, "day": [key[1]] * n, "slot": pd.Series(slots, dtype=object),
                "at": pd.array(moments, dtype="Int64"), "request_id": pd.array(requests, dtype="Int64"), "closed": [closed] * n,
            }
        )


def _first_contenders(batches):
    """Of each slot of a day the first request of an Arrow batch, so that a day that everyone wants reaches its state as a few rows."""
    keys = ["id", "day", "slot", "closes"]
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("at", "ascending"), ("request_id", "ascending")])
        first = rows.group_by(keys, use_threads=False).aggregate([("at", "first"), ("request_id", "first")])
        named = first.rename_columns([c.removesuffix("_first") for c in first.column_names])
        yield from named.select(batch.schema.names).cast(batch.schema).to_batches()


def _closes(day: Column) -> Column:
    """When a day has ended, in milliseconds."""
    return F.unix_millis(F.date_add(day.cast("date"), 1).cast("timestamp"))


def _contenders(requests: DataFrame, today) -> DataFrame:
    """One row per request with a valid date; the slot is null where the day does not offer it."""
    asked = requests.select(
        py_strip(F.col("listing_id")).alias("id"),
        validate_date(F.col("date"), BK.clock(today))["date"].cast("string").alias("day"),
        py_strip(F.col("slot")).alias("slot"),
        # a plain copy: late requests are decided too, as long as their day is open
        F.unix_micros(F.col("_event") + F.expr("INTERVAL 0 SECONDS")).alias("at"),
        F.col("request_id").cast("bigint").alias("request_id"),
    ).where(F.col("day").isNotNull() & F.col("id").isNotNull())
    offered = F.array_contains(BK.slots_for(F.col("id"), F.col("day")), F.col("slot"))
    return asked.select(
        "id", "day", F.when(offered, F.col("slot")).alias("slot"), "at", "request_id", _closes(F.col("day")).alias("closes")
    )


def _run_of(spark: SparkSession, checkpoint: str) -> str | None:
    """Name of the run a checkpoint belongs to; None before its first start."""
    try:
        row = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row.id if row else None


def _holders(spark: SparkSession, ledger_path: str, own_run: str | None, booked: DataFrame | None, today) -> DataFrame:
    """Bookings that other runs, or callers, made before: the state to begin with."""
    columns = ["listing_id", "date", "slot"]
    held = spark.createDataFrame([], "listing_id string, date string, slot string")
    try:
        stored = spark.read.schema(STORED_SCHEMA).parquet(ledger_path)
        held = stored.where(~F.col("run").eqNullSafe(F.lit(own_run))).select(*columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if booked is not None:
        held = held.unionByName(booked.select(*columns))
    if today is not None:  # a condition on a partition column: only open dates are read
        held = held.where(F.col("date") >= BK.clock(today).cast("string"))
    return held.select(
        F.col("listing_id").alias("id"), F.col("date").alias("day"), "slot", _closes(F.col("date")).alias("closes")
    )


def stream_bookings(
    requests: DataFrame, listings: DataFrame | ListingsById, today, ledger_path: str, decisions_path: str, checkpoint: str,
    booked: DataFrame | None = None, delay: str = "1 hour",
) -> DataStreamWriter:
    """Writer that decides each micro-batch against keyed state and extends the ledger table.

    A slot belongs to the earliest batch that asked for it and, inside a batch, to
    the first request.  Holders are state per (listing, day, slot), dropped when the
    watermark (``delay`` behind the latest request) has passed the day; a request that comes
    later still finds nothing left on it.  Dates are checked against ``today``, or without
    it against the day of each request.

    Each start with a fresh ``checkpoint`` is a run of its own, named by the stream's
    id.  It begins with what other runs have written to ``ledger_path`` and with
    ``booked`` (the ledger's columns), so nothing is booked twice.  A batch writes only its own
    ``run=R/batch=N`` folders and overwrites them when it is run again after a
    failure.  With ``listings`` laid out by id a micro-batch reads only the folders of
    its ids.  The session's state store must be RocksDB (``STATE_STORE``).  The caller adds the trigger and
    starts it.
    """
    spark = requests.sparkSession
    timed = requests.withColumn("_event", F.col("requested_at").cast("timestamp")).withWatermark("_event", delay)
    fields = requests.columns
    contenders = _contenders(timed, today)
    few = contenders.mapInArrow(_first_contenders, _CONTENDERS)
    holders = _holders(spark, ledger_path, _run_of(spark, checkpoint), booked, today)
    takers = few.groupBy("id", "day").transformWithStateInPandas(
        SlotKeeper(), _TAKERS, "append", "eventTime", initialState=holders.groupBy("id", "day")
    )
    # requests pass beside the state; both kinds of rows meet again in the batch
    both = timed.select(F.struct(*fields).alias("request"), F.lit(None).cast(f"struct<{_typed(_TAKERS)}>").alias("taker")).unionByName(
        takers.select(F.lit(None).cast(timed.select(F.struct(*fields).alias("r")).schema["r"].dataType).alias("request"), F.struct(*takers.columns).alias("taker"))
    )

    def settle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = materialize(batch, "micro_batch")  # one pass through the state
        asked = rows.where("request IS NOT NULL").select("request.*")
        told = rows.where("taker IS NOT NULL").select("taker.*")
        at = F.when(F.col("at").isNull(), BK.before_all()).otherwise(
            F.struct(F.timestamp_micros("at").cast("timestamp_ntz").alias("requested_at"), F.col("request_id"))
        )
        closed = told.groupBy("id", "day").agg(F.bool_or("closed").alias("closed"))
        days = BK.takers_by_day(told.select("id", "day", "slot", at.alias("at"))).join(closed, ["id", "day"])
        decisions = BK.decide(BK.checked_requests(asked, listings, today), days)
        target = f"{decisions_path}/run={run}/batch={batch_id}"
        decisions.write.mode("overwrite").parquet(target)
        stored = session.read.schema(decisions.schema).parquet(target)
        accepted = BK.accepted(stored).withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch_id))
        accepted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run", "batch", "date"
        ).parquet(ledger_path)

    return both.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint)


def _typed(ddl: str) -> str:
    return ", ".join(":".join(part.split()) for part in ddl.split(","))
