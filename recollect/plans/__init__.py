"""Registered queries by area; importing the package registers all of them."""

from recollect.plans import answers, catalog, chains, conflicts, dated, extraction, graphs, hybrid, life, lines, mixed, questions, retrieval, rollups, small, streams  # noqa: F401
