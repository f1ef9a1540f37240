"""Every registered query and its SQL oracle."""

from __future__ import annotations

from spindrift.plans import audit, catalogs, evidence, runs, web

QUERIES: dict = web.QUERIES | runs.QUERIES | audit.QUERIES | catalogs.QUERIES | evidence.QUERIES
ORACLES: dict = web.ORACLES | runs.ORACLES | audit.ORACLES | catalogs.ORACLES | evidence.ORACLES
