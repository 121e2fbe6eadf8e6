"""Continuous crawl ingest: cleaning, and one row per link by keyed state with event-time timers."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from roomtrace.operators.listings import normalize

_COPIES = "url string, row_index long, at long, closes long, row string"
#: Groups of links that share a piece of state, fixed for the life of a checkpoint.
BUCKETS = 1024
#: Copies in one packed chunk of state.
_CHUNK = 4096
_HELD = pa.schema([("url", pa.string()), ("row_index", pa.int64()), ("closes", pa.int64()), ("row", pa.string())])


def _packed(copies: pd.DataFrame) -> bytes:
    """Copies as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(copies, _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(chunk).read_all().to_pandas()


def _first_copies(copies: pd.DataFrame, closes: str) -> pd.DataFrame:
    """The first copy of each link by row index; its window closes at the ``closes`` ("first", "min") of its copies."""
    closing = copies.assign(closes=copies.groupby("url", sort=False)["closes"].transform(closes))
    return closing.sort_values(["row_index", "row"]).drop_duplicates("url")[_HELD.names]


class FirstCopy(StatefulProcessor):
    """The first row, by row index, among the copies of one link that come in time.

    The first copy to arrive opens a window of the allowed delay; when the watermark has passed it, the row
    with the smallest index is given out and the link forgotten.  A copy behind the watermark is
    given out at once, marked as late.

    The links of a bucket share their state: each micro-batch appends its first copies as packed chunks, in the order
    of arrival, and the chunks are read and written anew only when a window of the bucket closes.  One timer a bucket
    stands at the window that closes next.  So the calls to the state store grow with buckets and micro-batches, not with links.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "chunk binary")
        self.next = handle.getValueState("next", "closes long")

    def _append(self, copies: pd.DataFrame) -> None:
        for start in range(0, len(copies), _CHUNK):
            self.open.appendValue((_packed(copies.iloc[start : start + _CHUNK]),))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names that Spark calls by
        arrived = pd.concat(list(rows), ignore_index=True)
        behind = arrived["at"] < timerValues.getCurrentWatermarkInMs() * 1000
        first = _first_copies(arrived[~behind], "min")
        if len(first):
            self._append(first)
            closes, known = int(first["closes"].min()), self.next.get()
            if known is None or closes < known[0]:
                if known is not None:
                    self.handle.deleteTimer(known[0])
                self.handle.registerTimer(closes)
                self.next.update((closes,))
        if behind.any():
            yield self._told(arrived.loc[behind, "row"], "late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        # a link's earliest chunk opened its window; later ones can only bring a smaller row index
        held = pd.concat([_unpacked(chunk) for (chunk,) in self.open.get()], ignore_index=True)
        first = _first_copies(held, "first")
        closed = first["closes"] <= passed
        self.open.clear()
        self.next.clear()
        if not closed.all():
            left = first[~closed]
            closes = int(left["closes"].min())
            self._append(left)
            self.handle.registerTimer(closes)
            self.next.update((closes,))
        yield self._told(first.loc[closed, "row"], "listing")

    def close(self) -> None:
        pass

    @staticmethod
    def _told(rows: pd.Series, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"row": rows.to_numpy(), "kind": kind})


def _first_of_batch(batches):
    """Of the copies of a link with one event time the first of an Arrow batch, so that a link that floods a crawl reaches its state as a few rows."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by("row_index")
        first = rows.group_by(["url", "at", "closes"], use_threads=False).aggregate([("row_index", "first"), ("row", "first")])
        named = first.rename_columns([c.removesuffix("_first") for c in first.column_names])
        yield from named.select(batch.schema.names).cast(batch.schema).to_batches()


def stream_listings(raw: DataFrame, now=None, event_time: str = "crawled_at", delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Clean listings from a stream of raw rows, with ``kind``: one ``listing`` per non-empty link, and the ``late`` copies.

    ``raw`` has the crawl columns, ``row_index`` and a timestamp column; junk rows move the
    watermark too.  Ages are counted from ``now``, without it from each row's own event time.
    Against the batch form: the first copy by row index is the first of those
    whose event times are at most ``delay`` after the one that arrives first, and it is given out when the watermark
    has passed that; copies further apart are listings again.  Copies with an event time
    behind the watermark are given out as late, one for each link, event time and Arrow batch.  Rows without a
    link pass at once.  The session's state store must be RocksDB.  The links are dealt to ``buckets`` pieces of state by a
    hash; a task holds the open links of one bucket at a time, so larger crawls take more buckets, as they take more partitions.
    """
    timed = raw.withWatermark(event_time, delay)
    clock = F.col(event_time).cast("timestamp_ntz") if now is None else now
    clean = normalize(timed, clock, keep=[event_time])
    # a plain copy of the event time: late rows must reach the state to be told
    at = F.col(event_time) + F.expr("INTERVAL 0 SECONDS")
    plain = clean.withColumn(event_time, at)
    fields = T.StructType([f for f in plain.schema.fields if f.name != event_time])
    copies = plain.where(F.col("url") != "").select(
        "url", "row_index", F.unix_micros(event_time).alias("at"),
        F.unix_millis(F.col(event_time) + F.expr(f"INTERVAL {delay}")).alias("closes"),
        F.to_json(F.struct(F.struct(*fields.names).alias("fields"), F.unix_micros(event_time).alias("at"))).alias("row"),
    )
    few = copies.mapInArrow(_first_of_batch, _COPIES)
    dealt = few.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    told = dealt.groupBy("bucket").transformWithStateInPandas(FirstCopy(), "row string, kind string", "append", "eventTime")
    held = T.StructType([T.StructField("fields", fields), T.StructField("at", T.LongType())])
    linked = told.select(F.from_json("row", held).alias("r"), "kind").select(
        F.timestamp_micros("r.at").alias(event_time), "r.fields.*", "kind"
    )
    return linked.unionByName(plain.where(F.col("url") == "").withColumn("kind", F.lit("listing")))
