"""Queries over the test tables, by subject."""

from __future__ import annotations

import importlib

MODULES = ("nested_queries", "text_queries", "eval_queries", "kb_queries", "selection_queries", "more_queries", "annotation_queries", "stage_queries", "source_queries")


def load() -> None:
    """Import the query modules, each of which registers its queries."""
    for m in MODULES:
        importlib.import_module(f"loomqa.plans.{m}")
