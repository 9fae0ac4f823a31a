"""All registered queries."""

from rubrica.plans import (  # noqa: F401
    file_queries,
    human_queries,
    prompt_queries,
    report_queries,
    score_queries,
)
from rubrica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
