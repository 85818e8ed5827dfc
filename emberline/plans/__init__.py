"""The registered queries, by area."""

from emberline.plans import documents, fixes, ingest, logs, rollups, statistics

QUERIES = {**ingest.QUERIES, **rollups.QUERIES, **documents.QUERIES, **logs.QUERIES,
           **fixes.QUERIES, **statistics.QUERIES}
