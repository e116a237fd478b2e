"""Named queries with their SQL counterparts."""

from importlib import import_module

MODULES = ("postings", "links", "extraction", "store", "files", "streams", "plans")


def load():
    """All registered queries and SQL texts."""
    from jobsieve.registry import base

    for name in MODULES:
        import_module(f"jobsieve.registry.{name}")
    return base.QUERIES, base.ORACLES
