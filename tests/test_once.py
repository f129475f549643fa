"""What is evaluated once per row, and how often files are parsed."""

from __future__ import annotations

import pytest

from tallyloom import jobs
from tallyloom.operators import stitch as ST
from tallyloom.sources import lines as LN

STATEMENTS = {
    "bankwest": "Date Description Debit Credit\n03 Feb 24 SHOP  $12.50\n",
    "hsbc": "03 Feb 2024 SHOP\nRef no  12.50\n",
    "coles": "Transaction Date Post Date Description Amount\n03/02/2024 04/02 SHOP\n$12.50\n",
}


@pytest.mark.parametrize("bank", STATEMENTS)
def test_fields_of_an_entry_are_evaluated_once(spark, tmp_path, bank):
    """A filter on the records isn't moved below their fields, where it would repeat all that they are made of."""
    (tmp_path / "a.txt").write_text(STATEMENTS[bank])
    records = ST.STITCHERS[bank](LN.read_lines(spark, str(tmp_path)))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MMM d yyyy") == 1
    assert [(str(r["txn_date"]), float(r["amount"])) for r in records.collect()] == [("2024-02-03", -12.5)]


def test_dry_run_parses_files_once(spark, tmp_path, settings):
    """What is made of the records reads the parsed batch, not the files."""
    folder = tmp_path / "staging" / "amex"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("Date,Description,Amount\n01/02/2025,SHOP,10.00\n31/02/2025,BAD,1.00\n")
    preview = jobs.dry_run(spark, str(tmp_path / "staging"), str(tmp_path / "store"), settings)
    assert not [f for f in preview.inputFiles() if f.endswith(".csv")]
    assert [r["description"] for r in preview.collect()] == ["SHOP"]
    assert not (tmp_path / "store").exists()
