"""All registered queries."""

from gristmill.plans import exchange, filters, flows, graphs, joins, judged, ordering, search, shelves, states, summaries, texts, values
from gristmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "exchange", "filters", "flows", "graphs", "joins", "judged", "ordering", "search", "shelves", "states", "summaries", "texts", "values"]
