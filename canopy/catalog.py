"""Registry of the queries over the synthetic document tree and of their SQL oracles."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a callable ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(f):
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict:
    _load()
    return _ORACLES


def _load() -> None:
    from canopy.plans import sync_queries, tree_queries  # noqa: F401
