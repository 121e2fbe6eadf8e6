"""Text expressions: accents, match keys, trimming, masking, number text."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtrace import constants as K


#: Decimal digits of other scripts (those inside the basic plane, which ``translate`` maps one by one).
_DIGITS = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd"]


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Source and target alphabets for ``translate``.

    Built from the Unicode data: every character whose canonical decomposition
    has one base character maps to that base; combining marks come last, past
    the end of the target, and are therefore deleted.
    """
    sources, targets, marks = ["đ", "Đ"], ["d", "D"], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        category = unicodedata.category(char)
        if category in ("Cn", "Co", "Cs"):
            continue
        if category == "Mn":
            marks.append(char)
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            sources.append(char)
            targets.append(base[0])
    return "".join(sources + marks), "".join(targets)


def strip_accents(c: Column) -> Column:
    """Drop accents, keep case: ``Cầu Giấy`` becomes ``Cau Giay``."""
    source, target = _accent_table()
    return F.translate(c, source, target)


def py_strip(c: Column) -> Column:
    """Trim every Unicode blank at both ends; null becomes the empty string."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(K.WHITESPACE))


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    return F.translate(c, "".join(_DIGITS), "".join(str(unicodedata.digit(d)) for d in _DIGITS))


def district_key(c: Column) -> Column:
    """Accent-, case- and punctuation-free match key."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def scrub_phones(c: Column) -> Column:
    """Mask phone numbers that are not part of a longer digit run."""
    return F.regexp_replace(c, K.PHONE_PATTERN, K.PHONE_MASK.replace("[", r"\["))


def contains_any(c: Column, words: list[str]) -> Column:
    """True where any of a fixed list of words is a substring."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def general_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, exponent form outside 1e-4..1e6."""
    scientific = F.format_string("%.5e", c.cast("double"))
    exponent = F.substring_index(scientific, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(scientific, "e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(F.format_string("%.9f", scientific.cast("double")), r"\.?0+$", "")
    return F.when(exponent.between(-4, 5), plain).otherwise(
        F.concat(mantissa, F.lit("e"), F.substring_index(scientific, "e", -1))
    )
