"""All registered queries; importing a catalog module registers its queries."""

from . import (  # noqa: F401
    catalog_bars,
    catalog_features,
    catalog_feeds,
    catalog_files,
    catalog_history,
    catalog_labels,
    catalog_ledger,
    catalog_models,
    catalog_signals,
    catalog_streams,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
