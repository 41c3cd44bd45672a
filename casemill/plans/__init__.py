"""All queries of the core and their SQL."""

from casemill.plans import audits, cleaning, signals

FLAGSHIP = "score"
_MODULES = [cleaning, signals, audits]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
