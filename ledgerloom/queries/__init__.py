"""The registered queries of statement extraction and reconciliation, and their SQL."""

from __future__ import annotations

from . import extraction, reconciliation, scalar

QUERIES = {**scalar.QUERIES, **extraction.QUERIES, **reconciliation.QUERIES}
ORACLES = {**scalar.ORACLES, **extraction.ORACLES, **reconciliation.ORACLES}
