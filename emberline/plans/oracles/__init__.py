"""DuckDB oracles of the registered queries, by area."""

from emberline.plans.oracles import documents, fixes, ingest, logs, rollups, statistics

ORACLES = {**ingest.ORACLES, **rollups.ORACLES, **documents.ORACLES, **logs.ORACLES,
           **fixes.ORACLES, **statistics.ORACLES}
