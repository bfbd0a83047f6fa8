"""All named queries: importing this module registers them."""

from __future__ import annotations

from plumbline.plans import bench, extras, judge, kernels, route, split, synth  # noqa: F401
from plumbline.plans.named import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
