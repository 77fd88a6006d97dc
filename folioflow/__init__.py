"""Financial and inventory reports on Spark: ``Tables`` and parameters in, a DataFrame out."""

from .params import (
    BalanceParams,
    InventoryParams,
    InvoiceParams,
    JournalBookParams,
    LedgerParams,
    PeriodParams,
    StockParams,
)
from .sources import StarTables, Tables

__all__ = [
    "BalanceParams",
    "InventoryParams",
    "InvoiceParams",
    "JournalBookParams",
    "LedgerParams",
    "PeriodParams",
    "StarTables",
    "StockParams",
    "Tables",
]
