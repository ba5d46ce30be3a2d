"""All registered queries."""

from __future__ import annotations

from functools import partial

from newsburst.plans import clustering, lifecycle, relational  # noqa: F401  (they register)
from newsburst.plans.registry import ORACLES, QUERIES, run

__all__ = ["ORACLES", "QUERIES", "callables", "run"]


def callables():
    return {name: partial(run, name) for name in QUERIES}
