"""Checks over classified steps: tool order, grounding, repetition, write discipline."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomtrace.functions.agent import truncate_at_observation
from roomtrace.functions.text import py_strip
from roomtrace.operators.traces import live_steps

LISTING_ID = r"\b(?:pr\d+|gen\d{4,})"


def _is_subsequence(expected: Column, called: Column) -> Column:
    """Every expected name occurs in ``called``, in order."""
    matched = F.aggregate(
        called,
        F.lit(0),
        lambda n, tool: F.when(F.get(expected, n) == tool, n + 1).otherwise(n),
    )
    return matched == F.size(expected)


def check_tool_path(classified: DataFrame, expectations: DataFrame) -> DataFrame:
    """Does each trace call the expected tools in order.

    ``expectations`` has (trace_id, expected array<string>).  A trace has at most
    six steps, so its list of calls is bounded.
    """
    called = (
        live_steps(classified)
        .where(F.col("outcome") == "runnable")
        .groupBy("trace_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "tool"))), lambda c: c["tool"]).alias("called"))
    )
    none = F.array().cast("array<string>")
    return (
        expectations.join(called, "trace_id", "left")
        .withColumn("called", F.coalesce("called", none))
        .withColumn("follows_path", _is_subsequence(F.col("expected"), F.col("called")))
    )


def check_grounding(classified: DataFrame) -> DataFrame:
    """Listing ids in final answers that no earlier observation of the trace showed."""
    rows = live_steps(classified)
    ids = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LISTING_ID), F.lit(0))
    final = F.col("outcome") == "final"
    seen = F.array_distinct(F.flatten(F.collect_list(F.when(~final, ids(F.col("observation"))))))
    traces = rows.groupBy("trace_id").agg(
        seen.alias("_seen"), F.max(F.when(final, F.col("answer"))).alias("answer")
    )
    return (
        traces.where(F.col("answer").isNotNull())
        .withColumn("ungrounded", F.array_sort(F.array_except(F.array_distinct(ids(F.col("answer"))), F.col("_seen"))))
        .withColumn("grounded", F.size("ungrounded") == 0)
        .drop("_seen")
    )


def find_repeated_actions(classified: DataFrame) -> DataFrame:
    """Calls of one tool with the same arguments more than once in a trace."""
    return (
        live_steps(classified)
        .where(F.col("tool").isNotNull() & ~F.col("outcome").isin("final", "provider_error"))
        .groupBy("trace_id", "tool", F.transform("args", lambda a: a["text"]).alias("arguments"))
        .agg(F.count("*").cast("int").alias("times"))
        .where(F.col("times") > 1)
    )


def check_slot_before_book(classified: DataFrame) -> DataFrame:
    """Runnable bookings, and whether the same listing and date were checked earlier in the trace."""
    arg = lambda i: py_strip(F.get("args", F.lit(i))["text"])
    rows = (
        live_steps(classified)
        .where((F.col("outcome") == "runnable") & F.col("tool").isin("check_viewing_slots", "book_viewing"))
        .withColumn("listing_id", arg(0))
        .withColumn("date", arg(1))
    )
    earlier = W.partitionBy("trace_id", "listing_id", "date").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    checked = F.max(F.col("tool") == "check_viewing_slots").over(earlier)
    return (
        rows.withColumn("checked_first", F.coalesce(checked, F.lit(False)))
        .where(F.col("tool") == "book_viewing")
        .select("trace_id", "step", "listing_id", "date", "checked_first")
    )


def flag_fabricated(steps: DataFrame) -> DataFrame:
    """Steps whose raw output went on to invent a tool result, which was cut off."""
    raw = F.coalesce("raw_output", F.lit(""))
    return steps.withColumn("fabricated", truncate_at_observation(raw) != py_strip(raw))


def check_baseline(runs: DataFrame) -> DataFrame:
    """Baseline runs: exactly one model call and no tool call.

    ``runs`` has (run_id, kind) with kind ``model`` or ``tool`` per call.
    """
    calls = runs.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "model").alias("model_calls"),
        F.count_if(F.col("kind") == "tool").alias("tool_calls"),
    )
    return calls.withColumn("clean", (F.col("model_calls") == 1) & (F.col("tool_calls") == 0))
