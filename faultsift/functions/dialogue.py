"""Expressions over utterances, annotated examples and assistant replies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Keyword routes in order of precedence (plain substrings).
ROUTES = [
    ("menu", ["menu", "back", "options"]),
    ("greeting", ["hello", "hi"]),
    ("fetch", ["json", "download", "fetch"]),
]
DEFAULT_ROUTE = "help"

# How an owner is mentioned, and how an example marks an entity.
OWNER_MENTION = r"(?i)(?:owner|for)\s+(\w+)"
ANNOTATION = r"\[(.*?)\]\((.*?)\)"

# The numbered fields of a reply.
CAUSE = r"(?s)1\.\s*Likely cause.*?:(.*?)(?=2\.|$)"
CONFIDENCE = r"(?s)2\.\s*Confidence level.*?:.*?(\d+)"
SUGGESTION = r"(?s)3\.\s*Suggested actions.*?:(.*?)(?=4\.|$)"

# The request text.
PROMPT_TAIL = (
    "\n\nAnalyze the test failure above and provide:\n"
    "1. Likely cause of the failure:\n"
    "2. Confidence level (0-100):\n"
    "3. Suggested actions to fix:\n"
    "4. Similar previous cases:\n"
)


def keyword_route(text: Column, routes=ROUTES, default: str = DEFAULT_ROUTE) -> Column:
    """First route one of whose keywords occurs anywhere in the text."""
    lowered = F.lower(text)
    route = F
    for name, words in routes:
        route = route.when(reduce(or_, [lowered.contains(word) for word in words]), F.lit(name))
    return route.otherwise(F.lit(default))


def owner_mention(text: Column) -> Column:
    """Owner named after "owner" or "for", null when there is none."""
    return F.nullif(F.regexp_extract(text, OWNER_MENTION, 1), F.lit(""))


def wants_report(text: Column) -> Column:
    """False only when the request says "without"."""
    return ~F.lower(text).contains("without")


def annotations(example: Column) -> Column:
    """Array of {entity_text, entity_type} marked as `[text](type)`."""
    texts = F.regexp_extract_all(example, F.lit(ANNOTATION), F.lit(1))
    types = F.regexp_extract_all(example, F.lit(ANNOTATION), F.lit(2))
    return F.arrays_zip(texts.alias("entity_text"), types.alias("entity_type"))


def triage_prompt(test_id: Column, title: Column, description: Column, error: Column,
                  logs: Column) -> Column:
    """Text that describes one failure and asks for its cause."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("Unknown")))

    head = F.concat_ws(
        "\n", F.lit(""), line("Test ID: ", test_id), line("Test Title: ", title),
        line("Description: ", description), line("Error: ", error), F.lit(""), F.lit("Logs:"),
    )
    body = F.coalesce(F.array_join(logs, "\n"), F.lit(""))
    return F.concat(head, F.lit("\n"), body, F.lit(PROMPT_TAIL))


def parse_triage_reply(reply: Column) -> Column:
    """Struct of cause, confidence, suggestion and (always empty) similar cases."""
    def field(pattern: str, default: str) -> Column:
        found = reply.rlike(pattern)
        return F.when(found, strip(F.regexp_extract(reply, pattern, 1))).otherwise(default)

    confidence = F.regexp_extract(reply, CONFIDENCE, 1).try_cast("bigint")
    return F.struct(
        field(CAUSE, "Unknown").alias("cause"),
        F.coalesce(confidence, F.lit(0).cast("bigint")).alias("confidence"),
        field(SUGGESTION, "No suggestion available").alias("suggestion"),
        F.array().cast("array<string>").alias("similar_cases"),
    )
