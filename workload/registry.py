"""The decorator that files a query under a name, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, oracle: str | None = None):
        def add(fn):
            queries[name] = fn
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return add

    return queries, oracles, query
