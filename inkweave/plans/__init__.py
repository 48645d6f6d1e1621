"""Named queries over the test tables, with the SQL each must agree with."""

from . import (  # noqa: F401
    edit_queries,
    event_queries,
    graph_queries,
    journal_queries,
    search_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
