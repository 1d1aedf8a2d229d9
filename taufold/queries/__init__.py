"""Queries over the given tables, each with its Spark form and its oracle SQL."""

from taufold.queries import description, effects, models, preparation  # noqa: F401
from taufold.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
