"""Registered queries: each module adds its own to the registry."""

from . import catalog, prompts, replies, store_queries  # noqa: F401
