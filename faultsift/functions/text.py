"""Text expressions: cleaning, message extraction and failure patterns.

Everything here is a Column built from Spark's own functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode white space plus the four separators Python also counts as space.
SPACE = r"[\s\x1c-\x1f]"

# The tag that wraps one error message.
MESSAGE_TAG = r'(?s)<MESSAGE RESULT="ERROR">(.*?)</MESSAGE>'

# Failure patterns in order of precedence. Each has alternatives; an
# alternative holds when the message contains all of its texts.
PATTERN_RULES = [
    ("Wall label mismatch: Stationary vs Non-Slip",
     [["Non-Slip Wall (default)", "Stationary Wall (default)"]]),
    ("Condition label is invalid", [["Condition label is invalid"]]),
    ("Node count validation error", [["ValidationError", "NumNodes"]]),
    ("Step validation error", [["Validation error", "step#"]]),
    ("Image validation error", [["Image", "differ"]]),
    ("Count validation error", [["Count validation error"]]),
    ("Tree node label mismatch", [["tree node label"]]),
    ("Parameter value mismatch", [["ParameterValue"], ["ResultsValue"]]),
    ("Expected vs Actual mismatch", [["Expected", "Actual"]]),
]
UNKNOWN_PATTERN = "Unknown error"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_newlines(text: Column) -> Column:
    """Runs of line breaks become one space; ends are stripped."""
    return strip(F.regexp_replace(text, r"[\r\n]+", " "))


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def digits_only(text: Column) -> Column:
    """Keep decimal digits of any script."""
    return F.regexp_replace(text, r"\P{Nd}", "")


def normalize_message(text: Column) -> Column:
    """Lower case without digits; anything that is not a word character is a space."""
    no_digits = F.regexp_replace(F.lower(text), r"\p{Nd}+", "")
    return F.trim(F.regexp_replace(no_digits, r"[^\p{L}\p{N}_]+", " "))


def error_bodies(text: Column) -> Column:
    """Array of the bodies of all error tags, in order."""
    return F.regexp_extract_all(text, F.lit(MESSAGE_TAG), F.lit(1))


def truncate(text: Column, width: int = 150) -> Column:
    """First `width` characters, marked with dots when something was left out."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def classify_pattern(text: Column, rules=PATTERN_RULES) -> Column:
    """Name of the failure pattern; without a rule, the shortened first sentence."""
    message = F.coalesce(text, F.lit(""))
    sentence = truncate(F.substring_index(message, ".", 1), 50)
    pattern = F.when(message == "", F.lit(UNKNOWN_PATTERN))
    for label, alternatives in rules:
        hit = reduce(or_, [
            reduce(and_, [message.contains(part) for part in parts]) for parts in alternatives
        ])
        pattern = pattern.when(hit, F.lit(label))
    return pattern.otherwise(sentence)


def split_names(text: Column) -> Column:
    """`"A, B,,C"` to the array of its trimmed, non-empty names."""
    names = F.transform(F.split(text, ","), strip)
    return F.filter(names, lambda name: name != "")


def int_or(text: Column, default: int) -> Column:
    """Integer value of a text, or the default."""
    return F.coalesce(strip(text).try_cast("int"), F.lit(default))
