"""Queries over the driver's tables: mappings, plans and the SQL that each must equal."""

from workmap.plans import activity, advice, commands, history, learning, metering, ranking, receipts, recording, reports, resolution, retrieval, sources, store, store_coordination, store_learning, streams, text
from workmap.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "activity", "advice", "commands", "history", "learning", "metering", "ranking", "receipts", "recording", "reports", "resolution", "retrieval", "sources", "store", "store_coordination", "store_learning", "streams", "text"]
