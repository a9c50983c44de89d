"""Named queries over the driver tables, each next to the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

from lumbre.queries.registry import ORACLES, QUERIES

_MODULES = ("aggregations", "parsing", "profiling", "joins", "derived", "series", "security", "search", "boards", "streams", "filters")


def load() -> None:
    for m in _MODULES:
        import_module(f"lumbre.queries.{m}")


__all__ = ["ORACLES", "QUERIES", "load"]
