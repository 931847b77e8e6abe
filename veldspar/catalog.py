"""All queries of the panel engine with their DuckDB counterparts."""

from __future__ import annotations

from veldspar.queries import panel, relational, worksheets

QUERIES: dict = {**panel.QUERIES, **relational.QUERIES, **worksheets.QUERIES}
ORACLES: dict[str, str] = {**panel.ORACLES, **relational.ORACLES, **worksheets.ORACLES}


def flagship(spark, sf_dir: str):
    return QUERIES["rule_engine_band_counts"](spark, sf_dir)
