"""Edge cases of the text expressions."""

import pytest
from pyspark.sql import functions as F

from faultsift.functions import dialogue, links, text


def value(spark, column, **cells):
    literals = [F.lit(v).alias(k) for k, v in cells.items()]
    return spark.range(1).select(*literals).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("message, pattern", [
    ("Non-Slip Wall (default), Stationary Wall (default)",
     "Wall label mismatch: Stationary vs Non-Slip"),
    ("Non-Slip Wall (default) only. x", "Non-Slip Wall (default) only"),
    ("Condition label is invalid", "Condition label is invalid"),
    ("a ValidationError in NumNodes", "Node count validation error"),
    ("Validation error, step# 3", "Step validation error"),
    ("Images differ", "Image validation error"),
    ("Count validation error", "Count validation error"),
    ("the tree node label", "Tree node label mismatch"),
    ("ResultsValue", "Parameter value mismatch"), ("ParameterValue", "Parameter value mismatch"),
    ("Expected 1 Actual 2", "Expected vs Actual mismatch"),
    ("ParameterValue Expected Actual", "Parameter value mismatch"),
    ("", "Unknown error"), (None, "Unknown error"), (".hidden", ""),
    ("x" * 50 + ".tail", "x" * 50), ("x" * 51, "x" * 50 + "..."),
])
def test_patterns(spark, message, pattern):
    cell = F.lit(message).cast("string")
    assert spark.range(1).select(text.classify_pattern(cell)).first()[0] == pattern


def test_cleaning(spark):
    assert value(spark, text.collapse_newlines(F.col("c")), c="\t a\r\n\nb \n") == "a b"
    assert value(spark, text.collapse_whitespace(F.col("c")), c=" a \x1f\t b ") == "a b"
    assert value(spark, text.digits_only(F.col("c")), c="WI-12 a3") == "123"
    assert value(spark, text.normalize_message(F.col("c")), c="Äb 12-x é_² 7") == "äb x é_²"
    assert value(spark, text.truncate(F.col("c")), c="y" * 150) == "y" * 150
    assert value(spark, text.truncate(F.col("c")), c="y" * 151) == "y" * 150 + "..."
    assert value(spark, text.split_names(F.col("c")), c=" A, B,,C ,") == ["A", "B", "C"]
    for given, number in (("3", 3), (" 4 ", 4), ("3.5", 2), ("many", 2), ("", 2)):
        assert value(spark, text.int_or(F.col("c"), 2), c=given) == number


def test_bodies(spark):
    body = '<MESSAGE RESULT="ERROR">a\nb</MESSAGE><MESSAGE RESULT="OK">c</MESSAGE>' \
           '<MESSAGE RESULT="ERROR"></MESSAGE>'
    assert value(spark, text.error_bodies(F.col("c")), c=body) == ["a\nb", ""]


def test_dialogue(spark):
    route = dialogue.keyword_route(F.col("c"))
    for said, name in (("Back to it", "menu"), ("this one", "greeting"), ("get JSON", "fetch"),
                       ("good day", "help"), ("hi, options", "menu")):
        assert value(spark, route, c=said) == name
    assert value(spark, dialogue.owner_mention(F.col("c")), c="URL FOR  Jane now") == "Jane"
    assert value(spark, dialogue.owner_mention(F.col("c")), c="nothing") is None
    assert value(spark, dialogue.wants_report(F.col("c")), c="Without it") is False
    found = value(spark, dialogue.annotations(F.col("c")), c="get [A,B](products) at [1](release)")
    assert [tuple(row) for row in found] == [("A,B", "products"), ("1", "release")]
    reply = "1. Likely cause: bad\nmesh\n2. Confidence level (0-100): about 80%\n" \
            "3. Suggested actions: run again\n4. Similar"
    assert tuple(value(spark, dialogue.parse_triage_reply(F.col("c")), c=reply)) == (
        "bad\nmesh", 80, "run again", [])
    assert tuple(value(spark, dialogue.parse_triage_reply(F.col("c")), c="?")) == (
        "Unknown", 0, "No suggestion available", [])


def test_links(spark):
    assert value(spark, links.encode_component(F.col("c")), c="a b/ü!'()~*+&") == \
        "a%20b%2F%C3%BC!'()~*%2B%26"


def test_links_of_missing_values(spark):
    page = links.ReportPage("http://r/1", platform="4", release="9")
    none = F.lit(None).cast("string")
    got = value(spark, links.report_link(page, none.cast("boolean"), none, none, none, F.lit("")), c="")
    assert got == ("http://r/1?applicationId=-1&platformId=4&releaseId=9&allPackages=True&filterCollection="
                   "MatchType%3DAll%26Filter0%3DType%3AInvestigationStatus%2COperator%3AEQUAL%2CValue%3A"
                   "HAS_INVESTIGATION&highlighterCollection=MatchType%3DAll")
    assert value(spark, links.test_link(page, none, F.lit(1), none, none), c="").startswith("http://r/11?")
