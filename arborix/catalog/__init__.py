"""Registered queries: every operator applied to inputs derived from the standard tables, with SQL beside it."""

from __future__ import annotations

from arborix.catalog import clouds, graphs, meshes, resampling, scores, trees, warps

_ALL = (trees, resampling, graphs, meshes, clouds, scores, warps)


def queries() -> dict:
    return {k: v for m in _ALL for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _ALL for k, v in m.ORACLES.items()}
