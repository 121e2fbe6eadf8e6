"""Expressions over agent output and user questions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtrace import constants as K
from roomtrace.functions.text import contains_any, py_strip


def truncate_at_observation(c: Column) -> Column:
    """Text before the first line that pretends to be a tool result."""
    return py_strip(F.split(c, K.OBSERVATION_MARKERS, 2)[0])


def parse_action(c: Column) -> Column:
    """struct(tool, raw_args); tool is null when no action line is present."""
    tool = F.nullif(F.regexp_extract(c, K.ACTION_PATTERN, 1), F.lit(""))
    raw_args = F.when(tool.isNotNull(), F.regexp_extract(c, K.ACTION_PATTERN, 2))
    return F.struct(tool.alias("tool"), raw_args.alias("raw_args"))


# one argument: quoted stretches (closed by the end of text if need be) and plain stretches
_ARGUMENT = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^,"']++)++"""
_QUOTED = r"""(?s)"([^"]*)(?:"|\z)|'([^']*)(?:'|\z)"""


def split_arguments(c: Column) -> Column:
    """array<struct(text, int_value)>: arguments split at unquoted commas.

    Quotes are removed, empty arguments dropped, bare integers also typed.
    """

    def clean(token: Column) -> Column:
        unquoted = F.regexp_replace(token, _QUOTED, "$1$2")
        return py_strip(F.btrim(py_strip(unquoted), F.lit("\"'")))

    def typed(text: Column) -> Column:
        number = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
        return F.struct(text.alias("text"), number.alias("int_value"))

    tokens = F.regexp_extract_all(c, F.lit(_ARGUMENT), F.lit(0))
    texts = F.filter(F.transform(tokens, clean), lambda t: t != "")
    return F.transform(texts, typed)


def final_answer(c: Column) -> Column:
    """Text after the first final-answer marker, or null."""
    parts = F.split(c, K.FINAL_MARKER, 2)
    return F.when(F.contains(c, F.lit(K.FINAL_MARKER)), py_strip(F.get(parts, F.lit(1))))


def is_provider_error(c: Column) -> Column:
    return py_strip(c).rlike(K.PROVIDER_ERROR_PATTERN)


def is_transient(c: Column) -> Column:
    return contains_any(F.lower(c), [m.lower() for m in K.TRANSIENT_MARKERS])


def has_booking_intent(c: Column) -> Column:
    """Accent-sensitive substring test, as the guard defines it."""
    return contains_any(F.lower(c), K.BOOKING_INTENT_KEYWORDS)


def route_by_rules(c: Column, rules=K.ROUTE_RULES, default: str = K.ROUTE_DEFAULT) -> Column:
    """Name of the first rule with a keyword in the text."""
    text = F.lower(c)
    route = F.when(F.lit(False), F.lit(default))
    for name, words in rules:
        route = route.when(contains_any(text, words), F.lit(name))
    return route.otherwise(F.lit(default))


def date_context(day: Column) -> Column:
    """struct(today, weekday, tomorrow) as the prompt states them."""
    names = F.array(*[F.lit(name) for name in K.WEEKDAYS])
    return F.struct(
        day.cast("string").alias("today"),
        F.element_at(names, F.weekday(day) + 1).alias("weekday"),
        F.date_add(day, 1).cast("string").alias("tomorrow"),
    )
