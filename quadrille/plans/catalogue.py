"""Every registered query of the detection analytics and its DuckDB equivalent."""

from __future__ import annotations

from quadrille.plans import audits, detection, geography, rasters

QUERIES = {**detection.QUERIES, **geography.QUERIES, **rasters.QUERIES, **audits.QUERIES}
ORACLES = {**detection.ORACLES, **geography.ORACLES, **rasters.ORACLES, **audits.ORACLES}
