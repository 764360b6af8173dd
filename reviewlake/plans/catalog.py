"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus, when the
result is expressible in DuckDB SQL on the same tables, its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all():
    """Import every query module so that its ``register`` calls run."""
    from . import q_contracts, q_critic, q_diffs, q_intake, q_privacy, q_reports, q_rules, q_streams  # noqa: F401
    return QUERIES, ORACLES
