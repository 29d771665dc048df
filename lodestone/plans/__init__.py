"""Registered queries, a module per family."""

from importlib import import_module
from types import ModuleType

FAMILIES = ("text_queries", "report_queries", "parse_queries", "search_queries", "pipeline_queries", "question_queries", "model_queries")


def load_all() -> ModuleType:
    """The registry, once every family has added its queries."""
    for family in FAMILIES:
        import_module(f"lodestone.plans.{family}")
    return import_module("lodestone.plans.registry")
