"""Named queries over the test tables, each next to its SQL check."""

import importlib
import pkgutil


def all_queries():
    """Every registered query; modules named ``q_*`` register theirs on import."""
    from triarm.plans.catalog import CATALOG

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return CATALOG
