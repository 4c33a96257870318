"""Link columns. Hosts, ids and filter names are parameters; nothing is called."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReportPage:
    """A report page: its address, the names of its filters, and what stands for missing values."""

    base: str
    status_filter: str = "InvestigationStatus"
    owner_filter: str = "Owner"
    name_filter: str = "TestName"
    status_values: tuple[str, str] = ("HAS_INVESTIGATION", "NO_INVESTIGATION")
    highlighters: str = "MatchType%3DAll"
    tail: str = ""
    application: str = "-1"
    platform: str = "1"
    release: str = "1"


def _or(value: Column | None, default: str) -> Column:
    """The value as text, or the default where it is null or empty."""
    if value is None:
        return F.lit(default)
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.lit(default))


def encode_component(text: Column) -> Column:
    """Percent-encoding as browsers do it for one component of a URL."""
    encoded = F.url_encode(text)
    for code, char in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"),
                       ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def _page(page: ReportPage, product: Column | None, application: Column | None, platform: Column | None,
          release: Column | None, filters: Column) -> Column:
    return F.concat(
        F.lit(page.base), F.lit("") if product is None else product.cast("string"),
        F.lit("?applicationId="), _or(application, page.application),
        F.lit("&platformId="), _or(platform, page.platform),
        F.lit("&releaseId="), _or(release, page.release),
        F.lit("&allPackages=True&filterCollection=MatchType%3DAll"), filters,
        F.lit(f"&highlighterCollection={page.highlighters}{page.tail}"),
    )


def _filter(place: int, name: str, operator: str, value: Column) -> Column:
    return F.concat(F.lit(f"%26Filter{place}%3DType%3A{name}%2COperator%3A{operator}%2CValue%3A"), value)


def report_link(page: ReportPage, has_investigation: Column, owner: Column, platform_id: Column,
                release_id: Column, application_id: Column | None = None) -> Column:
    """Report page filtered by investigation status and, if given, by owner.

    A null flag asks for investigated tests; null or empty ids take the page's defaults."""
    status = F.when(F.coalesce(has_investigation, F.lit(True)), page.status_values[0]).otherwise(
        page.status_values[1])
    by_owner = F.when(F.coalesce(owner, F.lit("")) != "", _filter(1, page.owner_filter, "EQUAL", owner)).otherwise("")
    return _page(page, None, application_id, platform_id, release_id,
                 F.concat(_filter(0, page.status_filter, "EQUAL", status), by_owner))


def test_link(page: ReportPage, test_name: Column, product_id: Column, platform_id: Column,
              release_id: Column) -> Column:
    """Report page of the tests whose name contains the given one; of a null name, of all tests.

    The link is null where the product is; null or empty platforms and releases take the defaults."""
    name = _filter(0, page.name_filter, "CONTAINS", encode_component(F.coalesce(test_name, F.lit(""))))
    return _page(page, product_id, None, platform_id, release_id, name)


def workitem_link(base: str, work_item: Column) -> Column:
    """Page of one work item."""
    return F.concat(F.lit(base), work_item.cast("string"))
