"""Queries over the driver's tables, family by family; importing this registers them all."""

from . import aggregates, checks, evidence, layout, more, pages, relational, rest, review, scoped, streams, text, windows  # noqa: F401
