"""Queries over the given tables, one per operator, each with its SQL where SQL can say it."""

from . import (  # noqa: F401
    aspect_queries,
    flow_queries,
    report_queries,
    score_queries,
    signal_queries,
    stream_queries,
    table_queries,
    text_queries,
    training_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
