"""Search-text cleaning with built-in expressions over whole texts."""

from __future__ import annotations

from string import punctuation

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagsmith.functions.fixed_values import (
    FILLER_PHRASES, RESPONSE_TIME_SPARK_FORMAT, RUN_DATE_SPARK_FORMAT,
)

_LINE_BLANKS = "\t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.trim(c, F.lit(" \t\n\r\f\x0b"))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def clean_query(text: Column, fillers: list[str] | None = None) -> Column:
    """Lower-case, drop ASCII punctuation, squeeze blanks, drop filler phrases.

    Blanks become spaces and punctuation goes in one `translate` pass. Only texts that contain
    a filler are searched for whole-word fillers; there, words are separated by two spaces so
    that every word owns the spaces around it and neighbouring fillers are all found.
    """
    blanks = " " * len(_LINE_BLANKS)
    words = _squeeze(F.translate(F.lower(text), _LINE_BLANKS + punctuation, blanks))
    phrases = FILLER_PHRASES if fillers is None else fillers
    if not phrases:
        return words
    spaced = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    pattern = " (" + "|".join(p.replace(" ", "  ") for p in phrases) + ") "
    has_filler = F.lit(False)
    for phrase in phrases:
        has_filler = has_filler | words.contains(phrase)
    return F.when(has_filler, _squeeze(F.regexp_replace(spaced, pattern, " "))).otherwise(words)


def run_date_text(moment: Column) -> Column:
    """Moment as run stamps write it."""
    return F.date_format(moment, RUN_DATE_SPARK_FORMAT)


def response_time_text(moment: Column) -> Column:
    """Moment (UTC) as responses write it."""
    return F.date_format(moment, RESPONSE_TIME_SPARK_FORMAT)
