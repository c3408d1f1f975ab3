"""Operators for training-data pipelines. Nothing else in the library imports this."""

from __future__ import annotations


def queries() -> dict:
    from medoidlab.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from medoidlab.llm.registry import ORACLES

    return dict(ORACLES)
