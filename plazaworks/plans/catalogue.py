"""All queries of the library: importing the modules below registers them."""

from __future__ import annotations

from plazaworks.plans import community, knowledge, scalars, snapshots  # noqa: F401
from plazaworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
