"""All registered queries; importing a module of this package registers its queries."""

from korpusmill.plans import graph, incremental, log, matching, retrieval, text
from korpusmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "graph", "incremental", "log", "matching", "retrieval", "text"]
