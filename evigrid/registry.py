"""All queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from .plans import areas, briefings, config, grounding, narratives, rasters, records, register, remote, roundtrips, search, series, spatial, streams, summaries, text

FLAGSHIP = "ranked_register"
_ALL = register.QUERIES | spatial.QUERIES | summaries.QUERIES | series.QUERIES | text.QUERIES | config.QUERIES | records.QUERIES | rasters.QUERIES | narratives.QUERIES | briefings.QUERIES | roundtrips.QUERIES | streams.QUERIES | search.QUERIES | areas.QUERIES | remote.QUERIES | grounding.QUERIES


def queries() -> dict[str, Callable]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
