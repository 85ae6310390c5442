"""All registered queries."""

from . import report_queries, rules_matching, rules_relational, source_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
