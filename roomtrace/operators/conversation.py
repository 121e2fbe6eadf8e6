"""Chat sessions: memory segments, booking intent, history blocks, prompts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions.agent import date_context, has_booking_intent
from roomtrace.functions.text import py_strip
from roomtrace.operators.listings import as_date
from roomtrace.plans.prefix import last_known, placed, running_sum
from roomtrace.plans.scratch import materialize
from roomtrace.plans.skew import lookup, trailing


def session_segments(turns: DataFrame) -> DataFrame:
    """Interpret what was typed, per conversation in turn order.

    Adds ``query`` (the question proper), ``mode`` (agent or baseline, null for
    commands), ``remembered`` (the turn enters the history: it is a question and
    did not fail), ``segment_id`` (how often the history was emptied so far) and
    ``position`` (how many turns of the segment are remembered before this one).
    A failed turn has a null answer.
    """
    text = py_strip(F.col("question"))
    baseline = F.startswith(text, F.lit(K.BASELINE_COMMAND))
    query = F.when(baseline, py_strip(F.substring(text, len(K.BASELINE_COMMAND) + 1, 1 << 30))).otherwise(text)
    command = text.isin(K.QUIT_COMMANDS + K.RESET_COMMANDS + [K.CONCISE_COMMAND])
    is_turn = ~command & (query != "")
    read = (
        turns.withColumn("query", F.when(is_turn, query))
        .withColumn("mode", F.when(is_turn, F.when(baseline, "baseline").otherwise("agent")))
        .withColumn("remembered", is_turn & F.col("answer").isNotNull())
    )
    # leaving the program also ends its memory
    empties = text.isin(K.RESET_COMMANDS + K.QUIT_COMMANDS)
    # one order serves both counts: the turns of a segment lie together in their conversation
    ordered = placed(read, ["conv_id"], ["turn"])
    segments = running_sum(ordered, ["conv_id"], empties.cast("int"), "segment_id")
    counted = running_sum(segments, ["conv_id", "segment_id"], F.col("remembered").cast("int"), "_seen")
    return counted.withColumn("position", F.col("_seen") - F.col("remembered").cast("bigint")).drop("_seen", "_part", "_place")


def _with_context(segments: DataFrame, lookback: int, name: str, aggregate: Column) -> DataFrame:
    """Every question with ``aggregate`` over the ``lookback`` remembered turns before it.

    Remembered turns have a position of their own, so their context is a window
    over bounded stretches.  Failed turns share the position of the next
    remembered one, possibly very many of them: their contexts are computed once
    per position and looked up.
    """
    keys = ["conv_id", "segment_id"]
    asked = materialize(segments.where(F.col("mode").isNotNull()), "questions")
    kept, failed = asked.where(F.col("remembered")), asked.where(~F.col("remembered"))
    places = (
        failed.select(*keys, "position").distinct()
        .where(F.col("position") > 0)
        .withColumn("_seen", F.explode(F.sequence(F.greatest(F.col("position") - lookback, F.lit(0)), F.col("position") - 1)))
    )
    turns = kept.withColumnRenamed("position", "_seen").drop("turn")
    contexts = places.join(turns, [*keys, "_seen"]).withColumnRenamed("position", "_at").withColumnRenamed(
        "_seen", "position"
    ).groupBy(*keys, "_at").agg(aggregate.alias(name)).withColumnRenamed("_at", "position")
    return trailing(kept, keys, "position", lookback, {name: aggregate}).unionByName(
        lookup(failed, contexts, [*keys, "position"], spread=["turn"])
    )


def intent_in_context(segments: DataFrame) -> DataFrame:
    """Is a booking asked for in this question or one of the three remembered before it."""
    own = segments.withColumn("intent", F.coalesce(has_booking_intent(F.col("query")), F.lit(False)))
    seen = _with_context(own, K.INTENT_LOOKBACK_TURNS, "_recent", F.max("intent"))
    return seen.withColumn("intent_in_context", F.col("intent") | F.coalesce("_recent", F.lit(False))).drop("_recent")


def _last_of_questions(steps: DataFrame, questions: DataFrame, value: Column, name: str) -> DataFrame:
    """Steps with the ``value`` of the last question at or before the place where they were asked, null where there is none.

    An as-of join: questions and steps are sorted together by conversation and place, a question first, and the value is
    carried along.  ``steps`` have conv_id and ``asked_at``, a place in the conversation.
    """
    placeable = F.col("conv_id").isNotNull() & F.col("asked_at").isNotNull()
    step = F.struct(*steps.columns)
    kind = steps.select(step.alias("s")).schema["s"].dataType
    told = questions.select(
        "conv_id", F.col("turn").cast("bigint").alias("_at"), F.lit(0).alias("_kind"), value.alias("_told"), F.lit(None).cast(kind).alias("_step")
    )
    nothing = F.lit(None).cast(told.schema["_told"].dataType)
    asking = steps.where(placeable).select(
        "conv_id", F.col("asked_at").cast("bigint").alias("_at"), F.lit(1).alias("_kind"), nothing.alias("_told"), step.alias("_step")
    )
    rows = placed(told.unionByName(asking), ["conv_id"], ["_at", "_kind"])
    known = last_known(rows, ["conv_id"], F.col("_told"), name).where(F.col("_kind") == 1).select("_step.*", name)
    return known.unionByName(steps.where(~placeable).withColumn(name, nothing))


def intent_of_steps(steps: DataFrame, questions: DataFrame) -> DataFrame:
    """Steps with ``intent``: was a booking asked for when the step's question was put.

    ``questions`` are those of ``intent_in_context``: the last one at or before the step's place counts, with the
    remembered ones before it, and the step's own question.  A step without a
    conversation, or before its first question, has only its own.
    """
    own = F.coalesce(has_booking_intent(F.col("question")), F.lit(False))
    known = _last_of_questions(steps, questions, F.col("intent_in_context"), "_known")
    return known.withColumn("intent", own | F.coalesce("_known", F.lit(False))).drop("_known")


def prompt_of_steps(steps: DataFrame, prompts: DataFrame, template: str | Column, today) -> DataFrame:
    """Steps with ``prompt``: what the loop they belong to began with, system prompt, history and question.

    ``prompts`` are those of ``assemble_prompts``; the last agent question at or before the step's place counts.  Only its
    place is carried along, the text is looked up once.  A step without one is prompted with its own question alone.
    """
    asked = prompts.where(F.col("mode") == "agent")
    placed_steps = _last_of_questions(steps, asked, F.col("turn").cast("bigint"), "_turn")
    texts = asked.select("conv_id", F.col("turn").cast("bigint").alias("_turn"), "prompt")
    alone = F.concat(fill_date_context(template, today), F.lit("\n"), F.lit(K.QUESTION_PREFIX), F.col("question"), F.lit("\n"))
    found = lookup(placed_steps, texts, ["conv_id", "_turn"], spread=["trace_id", "step"])
    return found.withColumn("prompt", F.coalesce("prompt", alone)).drop("_turn")


def _history_text(pairs: Column) -> Column:
    numbered = F.transform(
        pairs,
        lambda p, i: F.format_string(K.HISTORY_TURN, (i + 1).cast("int"), p["question"], p["answer"]),
    )
    block = F.concat(F.lit(K.HISTORY_HEADER + "\n"), F.array_join(numbered, "\n"), F.lit("\n"))
    return F.when(F.size(pairs) > 0, block).otherwise(F.lit(""))


def history_block(segments: DataFrame) -> DataFrame:
    """History text that each question is sent with: the last ten remembered turns."""
    answer = py_strip(F.col("answer"))
    cut = F.when(
        F.length(answer) > K.HISTORY_ANSWER_CHARS,
        F.concat(F.substring(answer, 1, K.HISTORY_ANSWER_CHARS), F.lit(K.HISTORY_CUT)),
    ).otherwise(answer)
    pairs = F.collect_list(F.struct("position", F.col("query").alias("question"), F.col("_cut").alias("answer")))
    seen = _with_context(segments.withColumn("_cut", cut), K.HISTORY_TURNS, "_pairs", pairs)
    ordered = F.array_sort(F.coalesce("_pairs", F.array().cast(seen.schema["_pairs"].dataType)))
    return seen.withColumn("history", _history_text(ordered)).drop("_pairs", "_cut")


def fill_date_context(template: str | Column, day) -> Column:
    """Replace {today}, {weekday} and {tomorrow} in a prompt template."""
    text = template if isinstance(template, Column) else F.lit(template)
    context = date_context(as_date(day))
    for name in ("today", "weekday", "tomorrow"):
        text = F.replace(text, F.lit("{%s}" % name), context[name])
    return text


def assemble_prompts(with_history: DataFrame, template: str | Column, today) -> DataFrame:
    """Prompt text per question of history_block.

    Agent questions: template, history, question.  Baseline questions: the
    question alone, or after the history when there is one.
    """
    question = F.concat(F.lit(K.QUESTION_PREFIX), F.col("query"))
    agent = F.concat(fill_date_context(template, today), F.lit("\n"), F.col("history"), question, F.lit("\n"))
    baseline = F.when(F.col("history") != "", F.concat("history", question)).otherwise(F.col("query"))
    return with_history.withColumn("prompt", F.when(F.col("mode") == "agent", agent).otherwise(baseline))
