from dataclasses import replace
from datetime import date, timedelta
from itertools import groupby

import pytest
from erp import erp, money

from folioflow import JournalBookParams, PeriodParams
from folioflow.operators import journals, pivots

DAY = date(1998, 5, 1)
BOOK = JournalBookParams(date(1998, 1, 1), date(1998, 12, 31))
PERIOD = PeriodParams(date(1998, 1, 1), date(1998, 12, 31))


def test_audit_takes_every_state_and_the_date_of_the_entry(spark):
    moves = [{"id": 1, "state": "draft"}, {"id": 2, "date": date(1999, 1, 1)}]
    t = erp(spark, [{"debit": money(1)}, {"debit": money(2)}, {"debit": money(4), "move_id": 2}], moves)
    (row,) = journals.journal_audit(t, PERIOD).collect()
    assert (float(row.debit), row.state, row.partner_vat) == (3, "draft", "A1")
    (row,) = journals.journal_audit_labelled(t, PERIOD).collect()
    assert (float(row.debit), row.state, row.partner, row.account) == (3, "Borrador", "Ana", "143501")


def test_audit_by_label_merges_entries_of_one_name(spark):
    moves = [{"id": 1, "name": "/"}, {"id": 2, "name": "/"}]
    t = erp(spark, [{"debit": money(1)}, {"debit": money(2), "move_id": 2}], moves)
    assert journals.journal_audit(t, PERIOD).count() == 2
    assert journals.journal_audit_labelled(t, PERIOD).count() == 1


def test_audit_of_chosen_journals(spark):
    t = erp(spark, [{"debit": money(1)}, {"debit": money(2), "journal_id": 2}])
    (row,) = journals.journal_audit(t, replace(PERIOD, journals=(2,))).collect()
    assert float(row.debit) == 2


def test_book_goes_by_the_state_and_journal_of_the_entry(spark):
    moves = [{"id": 1, "state": "draft"}, {"id": 2, "journal_id": 2}]
    t = erp(spark, [{"debit": money(1)}, {"debit": money(2), "move_id": 2, "journal_id": 1}], moves)
    assert journals.journal_book_lines(t, BOOK).count() == 2
    posted = replace(BOOK, target_move="posted")
    (row,) = journals.journal_book_totals(t, posted).collect()
    assert (row.journal_id, float(row.debit)) == (2, 2)
    assert journals.journal_book_lines(t, replace(BOOK, journals=(1,))).count() == 1


def test_taxes_are_listed_by_the_lines_bearing_them(spark):
    lines = [
        {"balance": money(-100), "credit": money(100)},
        {"credit": money(19), "tax_line_id": 1},
        {"credit": money(7), "tax_line_id": 2},
    ]
    rel = ("account_move_line_id bigint, account_tax_id bigint", [(1, 1), (1, 20)])
    t = erp(spark, lines, account_move_line_account_tax_rel=rel)
    rows = {r.tax_id: (float(r.base_amount), float(r.tax_amount)) for r in journals.journal_book_taxes(t, BOOK).collect()}
    assert rows == {1: (100, 19), 20: (100, 0)}  # a sales journal turns the signs


def test_taxes_of_a_purchase_journal_keep_their_sign(spark):
    lines = [{"balance": money(100), "debit": money(100)}, {"debit": money(19), "tax_line_id": 1}]
    rel = ("account_move_line_id bigint, account_tax_id bigint", [(1, 1)])
    t = erp(spark, lines, [{"id": 1, "journal_id": 3}], account_move_line_account_tax_rel=rel)
    (row,) = journals.journal_book_taxes(t, BOOK).collect()
    assert (float(row.base_amount), float(row.tax_amount)) == (100, 19)


def printed(rows):
    return [(r.entry, str(r.date) if r.date else None, r.partner) for r in rows]


def test_repeats_are_blank(spark):
    moves = [{"id": 1, "name": "A"}, {"id": 2, "name": "/"}, {"id": 3, "name": "C", "date": DAY}]
    lines = [
        {"move_id": 1, "name": "1", "debit": money(1)},
        {"move_id": 1, "name": "2", "credit": money(1)},
        {"move_id": 1, "name": "3", "partner_id": 2},
        {"move_id": 1, "name": "4", "partner_id": None},
        {"move_id": 2, "name": "5"},
        {"move_id": 3, "name": "6", "date": DAY + timedelta(1)},
    ]
    rows = journals.journal_book_print_rows(erp(spark, lines, moves), BOOK).collect()
    assert printed(rows) == [
        ("A", "1998-05-01", "Ana"), (None, None, None), (None, None, "Bo"), (None, None, None),
        ("*2", "1998-05-01", "Ana"), ("C", "1998-05-02", "Ana"),
    ]
    assert [(r.debit, r.credit) for r in rows][2] == (None, None)
    assert rows[0].account == "143501 Inventory" and rows[0].state == "Publicado"


def test_general_journals_always_show_the_partner(spark):
    lines = [{"name": "1"}, {"name": "2"}]
    t = erp(spark, lines, [{"id": 1, "journal_id": 2}])
    assert [r.partner for r in journals.journal_book_print_rows(t, BOOK).collect()] == ["Ana", "Ana"]


def test_by_entry_an_entry_shows_its_further_dates(spark):
    lines = [{"name": "1"}, {"name": "2", "date": DAY + timedelta(1)}, {"name": "3", "date": DAY + timedelta(1)}]
    rows = journals.journal_book_print_rows(erp(spark, lines), replace(BOOK, sort_by="move_name")).collect()
    assert printed(rows) == [("M1", "1998-05-01", "Ana"), (None, "1998-05-02", None), (None, None, None)]


@pytest.mark.parametrize("sort_by", ["date", "move_name"])
def test_print_rows_against_a_loop(spark, star, sort_by):
    """The page loop of the printed book, over the same sorted lines."""
    p = replace(BOOK, sort_by=sort_by)
    types = {r.id: r.type for r in star["account_journal"].collect()}
    want = []
    for journal, rows in groupby(journals.journal_book_lines(star, p).collect(), key=lambda r: r.journal_id):
        entry = day = partner = ""
        for r in rows:
            name = r.move if r.move != "/" else f"*{r.move_id}"
            shown = [None, None, None]
            if sort_by == "date":
                if not (day == r.date and entry == name):
                    shown[1], day, entry, partner = r.date, r.date, "", ""
                if entry != name:
                    shown[0], entry, partner = name, name, ""
            else:
                if entry != name:
                    shown[0], entry, day, partner = name, name, "", ""
                if day != r.date:
                    shown[1], day = r.date, r.date
            who = r.partner or ""
            if partner != who or types[journal] == "general":
                shown[2], partner = who or None, who
            want.append(tuple(shown))
    got = [(r.entry, r.date, r.partner) for r in journals.journal_book_print_rows(star, p).collect()]
    assert got == want


def test_pivot_leaves_the_first_day_out(spark):
    moves = [{"id": 1, "date": PERIOD.date_from}, {"id": 2}, {"id": 3}, {"id": 4, "date": PERIOD.date_to}]
    t = erp(spark, [{"move_id": m} for m in (1, 2, 2, 4)], moves)
    rows = {str(r.date): r.entries for r in pivots.journal_pivot(t, PERIOD).collect()}
    assert rows == {"1998-05-01": 1, "1998-12-31": 1}
