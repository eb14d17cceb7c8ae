"""Queries over the test tables, each beside the SQL it is held against."""

from . import base, events, files, folds, graphs, logs, ranks, streams, traces, trials  # noqa: F401

QUERIES, ORACLES = base.QUERIES, base.ORACLES
