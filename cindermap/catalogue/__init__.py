"""Queries over the driver tables, each with the SQL that states its result independently."""

from cindermap.catalogue.registry import QUERIES, SQL
from cindermap.catalogue import (  # noqa: F401  (importing a module registers its queries)
    areas,
    binning,
    chains,
    counts,
    fitted,
    incidents,
    joins,
    keys,
    sampling,
    scaling,
    storage,
)

__all__ = ["QUERIES", "SQL"]
