"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("totals", "golden", "kernels", "relational", "evaluate", "records", "ruled", "bound", "answering", "filing", "streams", "outputs", "schematic")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"paperloom.plans.{name}")
