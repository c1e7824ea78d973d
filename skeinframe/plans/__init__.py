"""Registered queries: one callable and one SQL text for each operator."""

from . import asking, events, integration, matching, media, questions, ranks, records, rollups, search, sentences, timetables, tokens, windows  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
