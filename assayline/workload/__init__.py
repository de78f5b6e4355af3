"""Operators bound to the test tables, each query next to the SQL that must give the same rows."""

from assayline.workload import attempt_queries, plan_queries, shape_queries, text_queries, tone_queries  # noqa: F401
from assayline.workload.registry import ORACLES, QUERIES  # noqa: F401
