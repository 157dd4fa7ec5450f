"""All registered queries; importing the modules fills the registry."""

import importlib

from palate.registry.core import QUERIES, SQL

for _module in ("tables", "summaries", "rankings", "matching"):
    importlib.import_module(f"palate.registry.{_module}")

__all__ = ["QUERIES", "SQL"]
