"""String similarity matching on Spark."""

from nearmark.operators import JOBS, Options, register_rule, unregister_rule
from nearmark.plans.enrich import enrich
from nearmark.plans.match import match_strings, match_targets, match_values
from nearmark.sources.catalog import Catalog, CatalogError, catalog_from_targets, load_catalog

__all__ = [
    "JOBS", "Catalog", "CatalogError", "Options", "catalog_from_targets", "enrich", "load_catalog",
    "match_strings", "match_targets", "match_values", "register_rule", "unregister_rule",
]
