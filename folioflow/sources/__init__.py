from .star import StarTables
from .tables import Tables

__all__ = ["StarTables", "Tables"]
