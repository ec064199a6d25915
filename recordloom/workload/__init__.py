"""Query catalogue. Importing the modules below fills the registry."""

from importlib import import_module

_MODULES = ["integrity_queries", "signals_queries", "log_queries", "retrieval_queries", "corpus_queries", "streaming_queries", "extension_queries"]


def load():
    for name in _MODULES:
        import_module(f"recordloom.workload.{name}")
    from recordloom.workload.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
