from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame and the SQL it must agree with."""

    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
