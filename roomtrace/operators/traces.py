"""Recorded agent steps: attempts, outcomes, guards, transcripts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions import agent as A
from roomtrace.functions.text import py_strip

TERMINAL = ["final", "provider_error"]


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """The model output each step went on with, one row per (trace_id, step).

    An attempt counts when it is not a transient provider error, or when it is
    the last one allowed; ``needs_retry`` marks steps whose log ends before that.
    """
    passing = A.is_provider_error(F.col("raw_output")) & A.is_transient(F.col("raw_output"))
    settled = F.when(~passing | (F.col("attempt") >= K.RETRY_ATTEMPTS), F.col("attempt"))
    return (
        attempts.withColumn("raw_output", F.coalesce("raw_output", F.lit("")))
        .withColumn("_settled", settled)
        .groupBy("trace_id", "step")
        .agg(
            F.min_by(F.when(F.col("_settled").isNotNull(), F.col("raw_output")), F.col("_settled")).alias("raw_output"),
            F.min("_settled").alias("attempt"),
        )
        .withColumn("needs_retry", F.col("attempt").isNull())
    )


def tool_registry(spark: SparkSession) -> DataFrame:
    """Registered tools: name, argument bounds, write flag, signature."""
    rows = [(n, len(req), len(req) + len(opt), write, sig) for n, req, opt, write, sig in K.TOOLS]
    return spark.createDataFrame(
        rows, "tool string, min_args int, max_args int, is_write boolean, signature string"
    )


def parse_steps(steps: DataFrame) -> DataFrame:
    """Steps within the loop's cap with the kept output and the parsed call."""
    return (
        steps.where(F.col("step").between(1, K.MAX_ITERATIONS))
        .withColumn("output", A.truncate_at_observation(F.coalesce("raw_output", F.lit(""))))
        .withColumn("_call", A.parse_action(F.col("output")))
        .withColumn("tool", F.col("_call.tool"))
        .withColumn("args", F.when(F.col("tool").isNotNull(), A.split_arguments(F.col("_call.raw_args"))))
        .drop("_call")
    )


def _argument_fault(tool: str, required: list[str], optional: list[str], given: Column) -> Column:
    """What a call with the wrong number of arguments is told, as Python words it."""
    low, high = len(required), len(required) + len(optional)
    fault = F.lit(None).cast("string")
    for n in range(low):
        names = [f"'{r}'" for r in required[n:]]
        listed = names[0] if len(names) == 1 else (
            " and ".join(names) if len(names) == 2 else ", ".join(names[:-1]) + ", and " + names[-1]
        )
        plural = "" if len(names) == 1 else "s"
        text = f"{tool}() missing {len(names)} required positional argument{plural}: {listed}"
        fault = F.when(given == n, F.lit(text)).otherwise(fault)
    takes = f"{high} positional argument{'' if high == 1 else 's'}" if low == high else (
        f"from {low} to {high} positional arguments"
    )
    over = F.concat(F.lit(f"{tool}() takes {takes} but "), given.cast("string"), F.lit(" were given"))
    return F.when(given > high, over).otherwise(fault)


def classify_calls(parsed: DataFrame, intent: Column | None = None) -> DataFrame:
    """Add ``call_outcome`` and ``refusal`` to parsed steps.

    Tests in this order: unknown tool, write without booking intent, wrong
    number of arguments, otherwise runnable.  ``intent`` is the conversation's
    booking intent; by default only the step's own question is read.  The
    registry is a handful of fixed tools, so it is part of the expression.
    """
    intent = F.coalesce(A.has_booking_intent(F.col("question")) if intent is None else intent, F.lit(False))
    tool, given = F.col("tool"), F.size("args")
    known = tool.isin([name for name, *_ in K.TOOLS])
    writes = tool.isin([name for name, _, _, write, _ in K.TOOLS if write])
    fault, signature = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, required, optional, _, text in K.TOOLS:
        fault = F.when(tool == name, _argument_fault(name, required, optional, given)).otherwise(fault)
        signature = F.when(tool == name, F.lit(name + text)).otherwise(signature)
    outcome = (
        F.when(tool.isNull(), F.lit(None).cast("string"))
        .when(~known, "unknown_tool")
        .when(writes & ~intent, "write_refused")
        .when(F.col("_fault").isNotNull(), "wrong_arguments")
        .otherwise("runnable")
    )
    refusal = (
        F.when(F.col("call_outcome") == "unknown_tool",
               F.format_string(K.OBS_UNKNOWN_TOOL, tool, F.lit(", ".join(n for n, *_ in K.TOOLS))))
        .when(F.col("call_outcome") == "write_refused", F.lit(K.OBS_WRITE_REFUSED))
        .when(F.col("call_outcome") == "wrong_arguments",
              F.format_string(K.OBS_WRONG_ARGUMENTS, tool, F.col("_fault"), signature))
    )
    return (
        parsed.withColumn("_fault", fault)
        .withColumn("call_outcome", outcome)
        .withColumn("refusal", refusal)
        .drop("_fault")
    )


def classify_steps(steps: DataFrame, intent: Column | None = None) -> DataFrame:
    """Add ``outcome`` per step: provider_error, final, malformed_action or the call's outcome.

    ``answer`` is what a terminal step returns; ``refusal`` the text a step gets
    back when its call is not run.
    """
    called = classify_calls(parse_steps(steps), intent)
    final = A.final_answer(F.col("output"))
    failed = A.is_provider_error(F.coalesce("raw_output", F.lit("")))
    outcome = (
        F.when(failed, "provider_error")
        .when(final.isNotNull(), "final")
        .otherwise(F.coalesce("call_outcome", F.lit("malformed_action")))
    )
    return (
        called.withColumn("outcome", outcome)
        .withColumn(
            "answer",
            F.when(F.col("outcome") == "provider_error", py_strip(F.col("raw_output")))
            .when(F.col("outcome") == "final", final),
        )
        .withColumn(
            "refusal",
            F.when(F.col("outcome") == "malformed_action", F.lit(K.OBS_MALFORMED_ACTION))
            .when(~F.col("outcome").isin(TERMINAL), F.col("refusal")),
        )
        .drop("call_outcome")
    )


def live_steps(classified: DataFrame) -> DataFrame:
    """Steps up to and including a trace's first terminal one (at most six per trace)."""
    per_trace = W.partitionBy("trace_id")
    end = F.min(F.when(F.col("outcome").isin(TERMINAL), F.col("step"))).over(per_trace)
    return (
        classified.withColumn("_end", end)
        .where(F.col("_end").isNull() | (F.col("step") <= F.col("_end")))
        .drop("_end")
    )


def summarize_traces(classified: DataFrame) -> DataFrame:
    """One row per trace: outcome, number of steps and of runnable calls, returned text.

    A combining aggregation; later steps than the first terminal one are not
    counted.  Calls per step number are kept as a small bitmap, so one pass is enough.
    """
    terminal = F.col("outcome").isin(TERMINAL)
    end = F.when(terminal, F.col("step"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("step").cast("int"))
    seen = classified.groupBy("trace_id").agg(
        F.min(end).alias("_end"),
        F.min_by(F.when(terminal, F.struct("outcome", "answer")), end).alias("_last"),
        F.bit_or(bit).alias("_steps"),
        F.bit_or(F.when(F.col("outcome") == "runnable", bit).otherwise(F.lit(0))).alias("_calls"),
    )
    until = F.call_function("shiftleft", F.lit(2), F.coalesce("_end", F.lit(K.MAX_ITERATIONS)).cast("int")) - 1
    n_steps = F.bit_count(F.col("_steps").bitwiseAND(until))
    capped = F.col("_end").isNull() & (n_steps >= K.MAX_ITERATIONS)
    return seen.select(
        "trace_id",
        F.when(F.col("_last").isNotNull(), F.col("_last.outcome"))
        .when(capped, "max_iterations")
        .otherwise("open")
        .alias("outcome"),
        n_steps.cast("int").alias("steps"),
        F.bit_count(F.col("_calls").bitwiseAND(until)).cast("int").alias("calls"),
        F.when(F.col("_last").isNotNull(), F.col("_last.answer"))
        .when(capped, F.lit(K.MAX_ITERATIONS_TEXT % K.MAX_ITERATIONS))
        .alias("answer"),
    )


def transcript_at(classified: DataFrame, header: Column) -> DataFrame:
    """Transcript each step was prompted with: header and all earlier output/result blocks."""
    block = F.concat(F.col("output"), F.lit("\nObservation: "), F.col("observation"), F.lit("\n"))
    # at most six steps per trace
    frame = W.partitionBy("trace_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return live_steps(classified).withColumn(
        "transcript", F.concat(header, F.array_join(F.collect_list(block).over(frame), ""))
    )
