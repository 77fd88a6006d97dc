from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioflow import BalanceParams, InvoiceParams, JournalBookParams, LedgerParams, PeriodParams
from folioflow.functions import labels, money


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in cells.items()], F.lit(1).alias("_")).select(column).first()[0]


def test_labels(spark):
    for state, text in (("draft", "Borrador"), ("posted", "Publicado"), ("cancel", "Cancelado"), ("x", "N/A")):
        assert value(spark, labels.state_label(F.col("s")), s=state) == text
    assert value(spark, labels.audit_state_label(F.col("s")), s="x") == "Cancelado"
    assert value(spark, labels.state_label(F.col("s"), None), s="x") is None
    assert value(spark, labels.sold_type_label(F.col("s")), s="service") == "Servicio"
    assert value(spark, labels.entry_label(F.col("n"), F.col("i")), n="/", i=7) == "*7"
    assert value(spark, labels.code_and_name(F.col("c"), F.col("n")), c="P1", n="Bolt") == "[P1] Bolt"
    assert value(spark, labels.code_and_name(F.col("c"), F.col("n")), c="", n="Bolt") == "Bolt"


def test_number_texts(spark):
    amount = Decimal("-1234567.5")
    assert value(spark, money.european_number(F.col("a")), a=amount) == "-1.234.567,50"
    assert value(spark, money.thousands_text(F.col("a")), a=amount) == "-1,234,567.50"
    assert value(spark, money.two_decimals(F.col("a")), a=-1234567.5) == "-1234567.50"


def test_ratio_of_nothing(spark):
    assert value(spark, money.ratio(F.col("a"), F.col("b")), a=Decimal(1), b=Decimal(0)) is None
    assert value(spark, money.ratio(F.col("a"), F.col("b")), a=Decimal(1), b=Decimal(4)) == 0.25


def test_params_are_checked():
    late, early = date(1998, 2, 1), date(1998, 1, 1)
    for make in (
        lambda: LedgerParams(late, early, (1,)),
        lambda: BalanceParams(late, early, (1,)),
        lambda: BalanceParams(early, late, (1,), book="tax"),
        lambda: JournalBookParams(early, late, target_move="some"),
        lambda: JournalBookParams(early, late, sort_by="amount"),
        lambda: PeriodParams(late, early),
        lambda: InvoiceParams(early, late, move_type="entry"),
    ):
        with pytest.raises(ValueError):
            make()
    assert InvoiceParams(late, early).date_end == late
