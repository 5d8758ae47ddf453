"""Registered queries by subject; each module has QUERIES and ORACLES by name."""

from . import catalog, clusters, content, feeds, intelligence, lists, scores, texts, trend

ALL = [trend, scores, texts, content, clusters, intelligence, feeds, lists, catalog]
