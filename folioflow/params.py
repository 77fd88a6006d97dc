"""Report parameters: the fields a user fills in before running a report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame

Ids = tuple[int, ...] | DataFrame
"""A filter on ids: a short tuple, or a one-column DataFrame for long lists. Empty tuple = no filter."""

BOOKS = ("local", "ifrs")
LEDGER_LEVELS = ("account", "account_partner", "partner")


def _check_window(start: date, end: date) -> None:
    if start > end:
        raise ValueError(f"date_from {start} is after date_to {end}")


def _check_choice(name: str, value: str, choices: tuple[str, ...]) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {choices}, got {value!r}")


@dataclass(frozen=True)
class LedgerParams:
    """Auxiliary ledger.

    ``levels`` picks the subtotal rows. The partner level excludes the other two, which may be combined.
    """

    date_from: date
    date_to: date
    companies: tuple[int, ...]
    posted_only: bool = True
    book: str = "local"
    accounts: Ids = ()
    partners: Ids = ()
    analytics: Ids = ()
    omit_zero: bool = True
    with_currency: bool = False
    with_analytic: bool = False
    levels: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _check_window(self.date_from, self.date_to)
        _check_choice("book", self.book, BOOKS)
        for level in self.levels:
            _check_choice("levels", level, LEDGER_LEVELS)
        if "partner" in self.levels and len(self.levels) > 1:
            raise ValueError("level 'partner' cannot be combined with other levels")

    @property
    def debit(self) -> str:
        return "debit" if self.book == "local" else "ifrs_debit"

    @property
    def credit(self) -> str:
        return "credit" if self.book == "local" else "ifrs_credit"

    @property
    def other_book(self) -> str:
        """The ``ifrs_type`` whose lines stay out of this book."""
        return "ifrs" if self.book == "local" else "local"


@dataclass(frozen=True)
class BalanceParams:
    """Trial balance. The partner filter only applies when ``by_partner`` is set."""

    date_from: date
    date_to: date
    companies: tuple[int, ...]
    posted_only: bool = True
    book: str = "local"
    accounts: Ids = ()
    analytics: Ids = ()
    partners: Ids = ()
    omit_zero: bool = True
    by_partner: bool = False
    by_analytic: bool = True

    def __post_init__(self) -> None:
        _check_window(self.date_from, self.date_to)
        _check_choice("book", self.book, BOOKS)

    debit = LedgerParams.debit
    credit = LedgerParams.credit
    other_book = LedgerParams.other_book


@dataclass(frozen=True)
class JournalBookParams:
    """Printed journal book. No journals = all journals."""

    date_from: date
    date_to: date
    journals: Ids = ()
    target_move: str = "all"
    sort_by: str = "date"

    def __post_init__(self) -> None:
        _check_window(self.date_from, self.date_to)
        _check_choice("target_move", self.target_move, ("all", "posted"))
        _check_choice("sort_by", self.sort_by, ("date", "move_name"))


@dataclass(frozen=True)
class PeriodParams:
    """A closed date window with the filters of the line reports (each report uses its own)."""

    date_from: date
    date_to: date
    journals: Ids = ()
    partners: Ids = ()
    products: Ids = ()
    brands: Ids = ()

    def __post_init__(self) -> None:
        _check_window(self.date_from, self.date_to)


@dataclass(frozen=True)
class InvoiceParams:
    """Invoice detail of one document type. An end before the start is moved to the start."""

    date_start: date
    date_end: date
    move_type: str = "out_invoice"
    journal_names: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _check_choice(
            "move_type", self.move_type, ("out_invoice", "out_refund", "in_invoice", "in_refund")
        )
        if self.date_end < self.date_start:
            object.__setattr__(self, "date_end", self.date_start)


@dataclass(frozen=True)
class StockParams:
    """Stock availability filters. ``search`` matches product code or name, ignoring case."""

    locations: Ids = ()
    products: Ids = ()
    categories: Ids = ()
    search: str | None = None


@dataclass(frozen=True)
class InventoryParams:
    """Inventory listings: either bound may be left open; both are inclusive."""

    date_from: datetime | None = None
    date_to: datetime | None = None
