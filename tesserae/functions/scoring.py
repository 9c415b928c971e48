"""Registry of scoring strategies: a name to a builder of a column in 0 to 1; unknown names fail when the plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRATEGIES: dict[str, Callable[..., Column]] = {}


def register(name: str, build: Callable[..., Column]) -> None:
    """Add or replace a strategy."""
    _STRATEGIES[name] = build


def has(name: str) -> bool:
    """Whether there is one of this name."""
    return name in _STRATEGIES


def names() -> list[str]:
    """All names, sorted."""
    return sorted(_STRATEGIES)


def clear() -> None:
    """Forget all."""
    _STRATEGIES.clear()


def score(name: str, text: Column, **params) -> Column:
    """The strategy's column, held within 0 and 1."""
    if name not in _STRATEGIES:
        raise KeyError(f"no scoring strategy {name!r}; known: {names()}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _STRATEGIES[name](text, **params)))


def concept_match(text: Column, concepts: list[str]) -> Column:
    """Share of the concepts that occur in the text."""
    hits = sum((F.contains(F.lower(text), F.lit(c.lower())).cast("int") for c in concepts), F.lit(0))
    return hits / F.lit(float(max(1, len(concepts))))


register("concept_match", concept_match)
