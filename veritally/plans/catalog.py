"""All registered queries."""

from veritally.plans import (  # noqa: F401
    extraction, reshaping, search, structure, tables, verification, streams,
)
from veritally.plans.registry import EXPECTED, QUERIES  # noqa: F401
