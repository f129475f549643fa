"""How CSV rows meet what is known of their file, and what a row costs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import cells as C
from tallyloom.sources import csv_sources as CSV

FILES = {
    CSV.parse_airbnb: "Date,Type,Amount,Confirmation code\n01/02/2024,Payout,\"1,000.50\",HM1\n",
    CSV.parse_paypal: "Date,Name,Status,Currency,Gross,Fee,Transaction ID,Description\n1/02/2024,Shop,Completed,AUD,\"1,000.50\",0,T1,Payment\n",
    CSV.parse_amex: "Date,Description,Amount\n01/02/2024,Shop,-1000.50\n",
}


@pytest.mark.parametrize("parse", FILES, ids=lambda f: f.__name__)
def test_rows_are_not_shuffled_by_file(spark, tmp_path, parse):
    """Files are few, so what is known of them goes to the rows. Rows shuffled by file meet in as many tasks as there are files."""
    (tmp_path / "a.csv").write_text(FILES[parse])
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, -1)
    try:
        records = parse(C.read_cells(spark, str(tmp_path)))
        plan = records._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "[file#" in line and ", Inner" in line]
        assert not joins
        assert [float(r["amount"]) for r in records.collect()] == [1000.5]
    finally:
        spark.conf.unset(threshold)


ODD = ['a,b', 'a,"b,c",d', '"a""b",c', 'ab"c,d"e,f', '"abc"def,g', '"abc" ,d', 'd,"abc" ', 'd,"abc"\t', '"",x,', ' a , "b,c" ,d', 'a,"b"c",d', '"a,b"', ',,"x"']


def test_cells_are_those_of_the_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(["", *ODD, "\t", ""]))
    own = C.read_cells(spark, str(tmp_path)).orderBy("seq").select("cells").collect()
    reader = spark.read.schema(C.CELLS).options(header=False, **C.PARSER).csv(str(tmp_path))
    whole = [[c or "" for c in r][: C.WIDTH] for r in reader.collect()]
    assert [([c or "" for c in r["cells"]] + [""] * C.WIDTH)[: C.WIDTH] for r in own] == whole
    assert len(whole) == len(ODD)
