"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from . import doclog, exchange, fixtures, logs

QUERIES = {**logs.QUERIES, **doclog.QUERIES, **exchange.QUERIES, **fixtures.QUERIES}
ORACLES = {**logs.ORACLES, **doclog.ORACLES, **exchange.ORACLES, **fixtures.ORACLES}
