"""Sources: parquet tables, bindings of the test tables to the engine's schemas,
and the seeded synthetic order source."""

from ledgerline.sources.tables import read_table
from ledgerline.sources.generate import synthetic_orders

__all__ = ["read_table", "synthetic_orders"]
