"""Labels shown in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels the reports print, in Spanish.
STATE_LABELS = {"draft": "Borrador", "posted": "Publicado", "cancel": "Cancelado"}
PRODUCT_TYPE_LABELS = {"product": "Almacenable", "service": "Servicio", "consu": "Consumible"}
NO_PARTNER = "**"
UNKNOWN_STATE = "N/A"
TOTAL = "Total"
IVA_CODE = "01"
INVENTORY_PREFIX = "1435"
COST_PREFIX = "6135"


def _label(key: Column, labels: dict[str, str], default: Column) -> Column:
    out = None
    for value, text in labels.items():
        out = (F if out is None else out).when(key == value, text)
    return out.otherwise(default)


def state_label(state: Column, default: str | None = UNKNOWN_STATE) -> Column:
    """Label of an entry state; anything else reads as ``default``."""
    return _label(state, STATE_LABELS, F.lit(default).cast("string"))


def audit_state_label(state: Column) -> Column:
    """As ``state_label``, but whatever is neither draft nor posted (NULL too) reads as cancelled."""
    return state_label(state, STATE_LABELS["cancel"])


def sold_type_label(detailed_type: Column) -> Column:
    """Sales lines only know storable products and services."""
    return F.when(detailed_type == "product", PRODUCT_TYPE_LABELS["product"]).otherwise(
        PRODUCT_TYPE_LABELS["service"]
    )


def partner_label(name: Column) -> Column:
    return F.coalesce(name, F.lit(NO_PARTNER))


def entry_label(name: Column, move_id: Column) -> Column:
    """Printed entry name; an entry that has no number yet is named ``/`` and printed as ``*<id>``."""
    return F.when(name != "/", name).otherwise(F.concat(F.lit("*"), move_id.cast("string")))


def code_and_name(code: Column, name: Column) -> Column:
    """``[code] name``, or the name alone."""
    return F.when(
        F.coalesce(code, F.lit("")) != "", F.concat(F.lit("["), code, F.lit("] "), name)
    ).otherwise(name)
