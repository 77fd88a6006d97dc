from datetime import date, datetime
from decimal import Decimal

import pytest
from compare import STAR, connect, differences
from erp import erp, money
from pyspark.sql import functions as F
from skewed import write_skewed

from folioflow import BalanceParams, StarTables, Tables
from folioflow.operators import journals, ledger
from folioflow.operators.pivots import month
from folioflow.operators.trial_balance import trial_balance
from folioflow.params import JournalBookParams, LedgerParams, PeriodParams
from folioflow.plans.catalogue import run
from folioflow.plans.oracle import ORACLE
from folioflow.sources import sinks

P = BalanceParams(date(1998, 1, 1), date(1998, 12, 31), (1, 2))


def test_line_ids_are_unique_over_several_files(spark, sf_dir, tmp_path):
    one = StarTables(spark, write_skewed(sf_dir, str(tmp_path)))
    (tmp_path / "some files").mkdir()
    many = StarTables(spark, write_skewed(sf_dir, str(tmp_path / "some files"), files=7))
    for tables in (one, many):
        lines = tables["account_move_line"]
        assert lines.select("id").distinct().count() == lines.count() == 6000
        rel = tables["account_move_line_account_tax_rel"].withColumnRenamed("account_move_line_id", "id")
        assert rel.join(lines, "id", "left_anti").count() == 0
    assert sorted(map(tuple, trial_balance(one, P).collect()), key=str) == sorted(
        map(tuple, trial_balance(many, P).collect()), key=str
    )


def test_ids_are_the_same_on_every_read(spark, sf_dir, tmp_path):
    root = write_skewed(sf_dir, str(tmp_path), files=3)

    def read():
        lines = StarTables(spark, root)["account_move_line"].select("id", "move_id", "product_id", "debit", "credit")
        return sorted(map(tuple, lines.collect()))

    assert read() == read()


def test_tables_open_once_and_only_when_asked(spark):
    opened = []

    def load(name):
        opened.append(name)
        return spark.range(1)

    tables = Tables(load)
    assert tables["a"] is tables["a"]
    assert opened == ["a"]


def test_own_erp_tables_from_parquet_and_catalog(spark, star, tmp_path):
    names = ("account_move_line", "account_account", "account_analytic_account")
    want = sorted(map(tuple, trial_balance(star, P).collect()), key=str)
    spark.sql("CREATE DATABASE IF NOT EXISTS erp_copy")
    try:
        for name in names:
            star[name].write.mode("overwrite").parquet(str(tmp_path / name))
            star[name].write.mode("overwrite").saveAsTable(f"erp_copy.{name}")
        for tables in (Tables.from_parquet(spark, str(tmp_path)), Tables.from_catalog(spark, "erp_copy")):
            assert sorted(map(tuple, trial_balance(tables, P).collect()), key=str) == want
    finally:
        spark.sql("DROP DATABASE erp_copy CASCADE")


def test_refresh_replaces_the_table(spark, star):
    report = star["account_move"].select("id", "date", "amount_total").filter("id < 50")
    moment = datetime(2020, 1, 2, 3, 4, 5)
    try:
        for _ in range(2):
            sinks.refresh_table(sinks.with_load_time(report, moment), "fresh_moves", month_of="date")
        table = spark.table("fresh_moves")
        assert table.count() == 50
        (row,) = table.filter("id = 0").collect()
        assert row.create_date == row.write_date == moment
        assert row.month == row.date.strftime("%Y-%m")
    finally:
        spark.sql("DROP TABLE IF EXISTS fresh_moves")


def test_tables_stored_by_entry_join_without_a_shuffle(spark, star):
    try:
        sinks.store_bucketed(star["account_move_line"].select("id", "move_id"), "stored_lines", "move_id", 8)
        sinks.store_bucketed(star["account_move"].withColumnRenamed("id", "move_id"), "stored_moves", "move_id", 8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("stored_lines").join(spark.table("stored_moves"), "move_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 6000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stored_lines")
        spark.sql("DROP TABLE IF EXISTS stored_moves")


def _files(spark, table):
    return spark.table(table).inputFiles()


def test_partitioned_and_bucketed_tables_have_few_files(spark, star):
    """Not a file for each task and month, or task and bucket."""
    report = star["account_move"].select("id", "date").repartition(40)
    try:
        sinks.refresh_table(report, "fresh_moves", month_of="date")
        months = report.selectExpr("date_format(date, 'yyyy-MM') AS m").distinct().count()
        assert len(_files(spark, "fresh_moves")) <= 2 * months
        sinks.store_bucketed(report, "stored_moves", "id", 8)
        assert len(_files(spark, "stored_moves")) == 8
    finally:
        spark.sql("DROP TABLE IF EXISTS fresh_moves")
        spark.sql("DROP TABLE IF EXISTS stored_moves")


def test_reports_read_the_months_of_their_window(spark, star):
    """A ledger stored by entry month gives the same reports and is read by partition."""
    names = ("account_account", "account_journal", "account_move", "res_partner", "account_analytic_account")
    window, year = LedgerParams(date(1997, 3, 1), date(1997, 4, 30), (1, 2)), PeriodParams(date(1997, 3, 1), date(1997, 4, 30))
    try:
        sinks.store_ledger(star["account_move_line"], star["account_move"], "stored_ledger")
        stored = Tables.from_frames({n: star[n] for n in names} | {"account_move_line": spark.table("stored_ledger")})
        for report in (
            lambda t: ledger.ledger_detail(t, window),
            lambda t: ledger.ledger_by_account_partner(t, window),
            lambda t: ledger.partner_subtotals(t, window),
            lambda t: trial_balance(t, P),
            lambda t: journals.journal_audit(t, year),
            lambda t: journals.journal_book_print_rows(t, JournalBookParams(year.date_from, year.date_to)),
        ):
            found = report(stored)
            assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, report(star).collect()), key=str)
            plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(entry_month" in plan
        read = ledger.ledger_detail(stored, window).select("date").inputFiles()
        assert len(read) < len(_files(spark, "stored_ledger"))
    finally:
        spark.sql("DROP TABLE IF EXISTS stored_ledger")


@pytest.mark.parametrize("name", ["ledger_by_partner", "journal_audit_labelled", "journal_book_print_rows"])
def test_keys_of_the_largest_scale(spark, sf_dir, tmp_path, name):
    """Customer keys above 10^10 don't meet suppliers, entry keys above 10^12 keep their names apart."""
    for table in STAR:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        for key, wide in (("c_custkey", f"c_custkey + {10**10}"), ("o_custkey", f"o_custkey + {10**10}"), ("o_orderkey", f"o_orderkey * 13 + {10**14}"), ("l_orderkey", f"l_orderkey * 13 + {10**14}")):
            if key in df.columns:
                df = df.withColumn(key, F.expr(wide))
        df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    tables = StarTables(spark, str(tmp_path))
    partners = tables["res_partner"]
    assert partners.select("id").distinct().count() == partners.count()
    named = tables["account_move"].filter("name <> '/'")
    assert named.select("name").distinct().count() == named.count()
    assert differences(run(name, spark, str(tmp_path)), connect(str(tmp_path)), ORACLE[name]) is None


def test_a_file_with_too_many_rows_is_refused(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("folioflow.sources.star._ROWS_PER_FILE", 100)
    with pytest.raises(Exception, match="too many rows"):
        StarTables(spark, sf_dir)["account_move_line"].select("id").collect()


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_export(spark, star, tmp_path, file_format):
    report = star["account_journal"]
    sinks.export_files(report, str(tmp_path / "out"), file_format)
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    back = reader.format(file_format).load(str(tmp_path / "out"))
    assert back.columns == report.columns and back.count() == 5


def test_month(spark):
    (row,) = spark.sql("SELECT DATE '1998-05-17' AS d").select(month("d").alias("m")).collect()
    assert row.m == date(1998, 5, 1)


def test_lines_with_another_date_than_their_entry_are_kept(spark):
    """Reports by the line's date and by the entry's give the same over the stored ledger."""
    lines = [
        {"debit": money(1)}, {"move_id": 2, "debit": money(2)}, {"move_id": 3, "debit": money(4)}, {"move_id": 99, "debit": money(8)},
        {"date": None, "debit": money(16)}, {"date": date(1997, 1, 1), "move_id": 2, "debit": money(32)},
    ]
    moves = [{"id": 1}, {"id": 2, "date": date(1997, 1, 5)}, {"id": 3, "date": None}]
    t = erp(spark, lines, moves)
    p = LedgerParams(date(1998, 1, 1), date(1998, 12, 31), (1,))
    spark.sql("CREATE DATABASE IF NOT EXISTS odd_dates")
    try:
        sinks.store_ledger(t["account_move_line"], t["account_move"], "odd_dates.lines")
        stored = erp(spark, lines, moves)
        stored._opened["account_move_line"] = spark.table("odd_dates.lines")
        assert spark.table("odd_dates.lines").count() == 6
        for report in (lambda x: ledger.ledger_by_account(x, p), lambda x: journals.journal_audit(x, PeriodParams(date(1997, 1, 1), date(1997, 12, 31)))):
            assert sorted(map(tuple, report(stored).collect()), key=str) == sorted(map(tuple, report(t).collect()), key=str) != []
    finally:
        spark.sql("DROP DATABASE odd_dates CASCADE")


def test_only_months_that_changed_are_written(spark):
    def report(rows):
        return spark.createDataFrame(rows, "day date, name string, amount decimal(18,2), n bigint")

    def row(y, m, name, amount, n=1):
        return (date(y, m, 3) if y else None, name, Decimal(amount), n)

    first = [row(1998, 1, "a", "1.10"), row(1998, 1, "b", "2"), row(1998, 2, "a", "3"), row(1998, 3, None, "4"), row(0, 1, "x", "9")]
    spark.sql("CREATE DATABASE IF NOT EXISTS monthly")

    def files():
        found = {}
        for path in spark.table("monthly.r").inputFiles():
            found.setdefault(path.split("/")[-2].removeprefix("month="), set()).add(path)
        return found

    try:
        assert sinks.refresh_months(report(first), "monthly.r", "day") == ["1998-01", "1998-02", "1998-03", "none"]
        before = files()
        assert sinks.refresh_months(report(first[::-1]), "monthly.r", "day") == []
        assert files() == before
        # Same sums in one month, another in the next, one gone, a new one.
        second = [row(1998, 1, "a", "2.10"), row(1998, 1, "b", "1"), row(1998, 2, "a", "3"), row(1998, 4, "n", "4"), row(0, 1, "x", "9")]
        assert sinks.refresh_months(report(second), "monthly.r", "day") == ["1998-01", "1998-03", "1998-04"]
        after = files()
        assert set(after) == {"1998-01", "1998-02", "1998-04", "__HIVE_DEFAULT_PARTITION__"}
        assert after["1998-02"] == before["1998-02"] and not after["1998-01"] & before["1998-01"]
        got = spark.table("monthly.r").drop("month").collect()
        assert sorted(map(tuple, got), key=str) == sorted(second, key=str)
        assert sinks.refresh_months(report(second[:4]), "monthly.r", "day") == ["none"]
        assert spark.table("monthly.r").count() == 4
    finally:
        spark.sql("DROP DATABASE monthly CASCADE")
