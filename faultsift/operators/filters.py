"""Row filters. All are plain predicates, so they reach the file scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_names(dim: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of a product, release or platform list whose name is wanted."""
    return dim.where(F.col("Name").isin(list(wanted)))


def by_name_in_text(dim: DataFrame, request: str) -> DataFrame:
    """Rows whose name occurs inside the request text (the form a web page posts)."""
    return dim.where(F.lit(request).contains(F.col("Name")))


def wanted_dim(dim: DataFrame, wanted: list[str] | str) -> DataFrame:
    """A list means membership, a single text means substring."""
    return by_name_in_text(dim, wanted) if isinstance(wanted, str) else by_names(dim, wanted)


def not_passed() -> Column:
    """Drop passes; a missing result is kept."""
    return ~F.col("Result").eqNullSafe(F.lit("PASS"))


def owned_by(owner: str) -> Column:
    """Exact owner, or everything for "all" in any case."""
    if owner.lower() == "all":
        return F.lit(True)
    return F.col("Owner") == owner


def owned_by_any_case(owner: str) -> Column:
    """Owner regardless of case and outer blanks."""
    return F.lower(F.trim(F.col("Owner"))) == owner.lower()


def min_failing_builds(least: int) -> Column:
    """Some entry counts at least this many builds; no entry at all is a miss."""
    some = F.exists(
        "FailureInfo", lambda info: F.coalesce(info["NumFailingBuilds"], F.lit(0)) >= least
    )
    return F.coalesce(some, F.lit(False))


def error_with_message() -> Column:
    """Errors (not mere failures) that carry a message."""
    return (F.col("Result") == "ERROR") & F.col("FailureMessage").isNotNull()


def not_passed_message(message: str = "Message") -> Column:
    """Drop messages that report a pass."""
    return ~F.col(message).contains("PASSED")


def split_investigated(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Investigated messages (anchors) and the others (targets)."""
    investigated = F.coalesce(F.col("HasInvestigation"), F.lit(False))
    return messages.where(investigated), messages.where(~investigated)


def with_unknowns(records: DataFrame) -> DataFrame:
    """Fill in names for absent test, owner, report and work item."""
    names = {"TestName": "Unknown Test", "Owner": "Unknown Owner",
             "InvestigationReport": "N/A", "WorkItemId": "N/A"}
    return records.na.fill({name: text for name, text in names.items() if name in records.columns})


def report_filter(investigated: bool | None = None, owner: str | None = None,
                  name_contains: str | None = None) -> Column:
    """All of the given report conditions."""
    keep = F.lit(True)
    if investigated is not None:
        keep = keep & (F.col("HasInvestigation") == investigated)
    if owner:
        keep = keep & (F.col("Owner") == owner)
    if name_contains:
        keep = keep & F.col("TestName").contains(name_contains)
    return keep


# Column names an uploaded sheet may use; the first found wins.
SHEET_COLUMNS = {
    "Test": ["Test", "TestName", "TestCase", "Test Name", "Name"],
    "Error": ["Test Failure Message", "Error", "ErrorMessage", "Failure Message", "Details"],
    "Owner": ["Owner", "Assignee", "User", "Responsible"],
}


def resolve_columns(sheet: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns Test, Error, Owner from whatever the sheet calls them.

    Blank cells become "Unknown" (test, owner) or the empty text (error).
    """
    chosen = []
    for name, aliases in SHEET_COLUMNS.items():
        found = next((alias for alias in aliases if alias in sheet.columns), None)
        value = F.lit(None).cast("string") if found is None else F.col(f"`{found}`")
        blank = F.lit("" if name == "Error" else "Unknown")
        chosen.append(F.coalesce(F.nullif(value, F.lit("")), blank).alias(name))
    return sheet.select(*keep, *chosen)
