"""Derived inputs, registered queries and their SQL twins for the driver tables."""

from importlib import import_module
from importlib.util import find_spec

MODULES = (
    "catalog_queries", "geometry_queries", "raster_queries", "evaluation_queries",
    "contract_queries", "labeling_queries", "review_queries",
)


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        if find_spec(f"workload.{name}"):
            import_module(f"workload.{name}")
