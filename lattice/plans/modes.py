"""Choices made while a plan is built: layers by mode, clusterer and search by size."""

from __future__ import annotations

from lattice.operators.retrieve import LAYERS


def layers(mode: str) -> tuple[str, ...]:
    """The layers of a retrieval mode; an unknown one is hybrid."""
    return LAYERS.get(mode, LAYERS["hybrid"])


def clusterer(n: int) -> str:
    return "spectral" if n < 100 else "multi_similarity" if n < 1000 else "neighbour_graph"


def head_weights(history: dict[str, float] | None = None) -> dict[str, float]:
    """Fixed weights; with a performance history, its shares."""
    from lattice.operators.attention import FIXED

    total = sum((history or {}).values())
    return {h: v / total for h, v in history.items()} if total > 0 else dict(FIXED)
