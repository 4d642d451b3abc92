"""Driver queries, grouped by the operators they exercise."""

from __future__ import annotations

import importlib

MODULES = ["framing", "correlation", "state", "views", "streams", "recovery"]


def load():
    """All registered queries and oracles."""
    from tracewright.workload import base

    for name in MODULES:
        importlib.import_module(f"tracewright.workload.{name}")
    return base.QUERIES, base.ORACLES
