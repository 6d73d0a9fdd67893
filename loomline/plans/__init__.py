"""Plans: the fact, its readers, rules, summaries, months and what is served, and the registry of queries."""

from . import audit, catalog, crews, landing, months, retraining, rules, serving, summaries

__all__ = ["audit", "catalog", "crews", "landing", "months", "retraining", "rules", "serving", "summaries"]
