"""Registered queries, one module per topic."""

from importlib import import_module

TOPICS = ("scans", "folds", "ordered", "searches", "surveys", "matching", "stamps", "spectral", "modelling", "record_queries", "audits", "streams")


def load() -> None:
    for topic in TOPICS:
        import_module(f"fluxloom.plans.{topic}")
