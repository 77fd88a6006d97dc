"""Where the reports get their tables from."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from .balances import BalanceCube


class Tables:
    """Named tables, opened lazily: a report only touches what it asks for."""

    #: Balances of closed months, if any are kept.
    cube: BalanceCube | None = None

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._load(name)
        return self._opened[name]

    def having(self, cube: BalanceCube) -> Tables:
        """The same tables with month balances."""
        other = copy.copy(self)
        other.cube = cube
        return other

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Tables:
        """One Parquet file or folder per table under ``root``."""
        return cls(lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str) -> Tables:
        """Tables of a catalog schema; bucket the ledger lines by ``move_id`` for local joins."""
        return cls(lambda name: spark.table(f"{schema}.{name}"))

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(lambda name: frames[name])
