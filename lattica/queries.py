"""The query catalogue: name -> callable(spark, sf_dir) and name -> DuckDB SQL."""

from __future__ import annotations

from lattica.catalogue import episodes, graphs, ingest, metrics, records, texts, vectors

QUERIES = {}
ORACLES = {}
for _part in (graphs, vectors, texts, metrics, episodes, ingest, records):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
