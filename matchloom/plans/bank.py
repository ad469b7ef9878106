"""Every query of the linkage operators by name, with its SQL for DuckDB."""

from __future__ import annotations

from matchloom.plans import diagnosis, noise, ranking, records, reports, sheets, signals, texts
from matchloom.plans.registry import Query

_BANKS = (ranking.bank, records.bank, reports.bank, signals.bank, diagnosis.bank, texts.bank, noise.bank, sheets.bank)

QUERIES: dict[str, Query] = {name: query for b in _BANKS for name, query in b.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for b in _BANKS for name, sql in b.sql.items()}
