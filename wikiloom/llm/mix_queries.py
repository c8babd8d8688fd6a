"""Queries of problem 8."""

from __future__ import annotations

from wikiloom.llm import mix as M
from wikiloom.session import table


def p8_shares(spark, sf_dir):
    """The shares reached by source, beside the targets."""
    return M.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_mix(spark, sf_dir):
    """The documents used and how often."""
    return M.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


QUERIES = {f.__name__: f for f in (p8_shares, p8_mix)}
ORACLE: dict[str, str] = {}
