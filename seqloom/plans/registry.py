"""All core queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _name in ("reads_queries", "interval_queries", "pileup_queries", "variant_queries", "overlap_queries", "progress_queries"):
    import_module(f"seqloom.plans.{_name}")
