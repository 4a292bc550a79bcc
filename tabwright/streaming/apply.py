"""Fitted plans on streams.

Cleaning and feature plans are row-wise projections once fitted, so a plan fitted on a batch table
cleans a stream unchanged; large label tables are joined to each micro-batch by shuffle. Steps that compare
rows with each other do not apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.clean import Deduplicate, Plan


def apply_plans(stream: DataFrame, plans: list[Plan]) -> DataFrame:
    """Chain fitted plans over a streaming (or batch) DataFrame."""
    for plan in plans:
        if stream.isStreaming and isinstance(plan, Deduplicate):
            raise ValueError("whole-row deduplication needs unbounded state on a stream; leave it out")
        stream = plan.transform(stream)
    return stream
