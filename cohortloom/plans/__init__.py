"""One query per operator over the given tables, with reference SQL."""

from . import check_queries, cohort_queries, metric_queries, score_queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
