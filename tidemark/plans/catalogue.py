"""All queries of the library with their SQL."""

from tidemark.plans import cleaning, reports, trends  # noqa: F401
from tidemark.plans.bindings import QUERIES, SQL  # noqa: F401
