"""All registered queries."""

from tideline.plans import q_control, q_intake, q_jobs, q_panels, q_quality, q_streaming, q_timeseries  # noqa: F401
from tideline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
