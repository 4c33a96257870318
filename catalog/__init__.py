"""Every operator as a query over the driver's tables."""

from . import (  # noqa: F401
    clusters,
    dialogue,
    filters,
    joins,
    reports,
    sources,
    streams,
    texts,
)
from .registry import QUERIES, SQL  # noqa: F401
