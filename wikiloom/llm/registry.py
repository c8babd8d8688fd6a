"""The query modules of this subpackage."""

from __future__ import annotations

import importlib

NAMES = ("encode_queries", "pieces_queries", "setjoin_queries", "splits_queries", "defects_queries", "overlap_queries", "mix_queries", "abuse_queries")


def query_modules():
    return [importlib.import_module(f"wikiloom.llm.{n}") for n in NAMES]
