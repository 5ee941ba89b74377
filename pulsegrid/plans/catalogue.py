"""All queries of the engine by name, with SQL that says the same."""

from __future__ import annotations

from pulsegrid.plans import accumulate, claims, feeds, history, ingest, landed, queue, reads, records, rumors, scores, streams, texts

PARTS = (scores, queue, reads, texts, rumors, claims, landed, records, streams, accumulate, ingest, history, feeds)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
