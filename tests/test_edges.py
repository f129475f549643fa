"""Wide exports, chunk borders, unreadable rows and re-delivered files."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import running
from tallyloom.operators import stitch as ST
from tallyloom.session import scratch_root
from tallyloom.sources import csv_sources as CSV
from tallyloom.sources import lines as LN
from tallyloom.sources import openbanking as OB
from tests.test_sources import put, rows


def test_wide_rows_keep_every_cell(spark, tmp_path):
    more = [f"X{i}" for i in range(60)]
    path = put(tmp_path, "a.csv", "﻿" + ",".join([*more, "Date", "Description", "Credit", "Debit"]) + "\n" + ",".join([f'"a, ""{i}"""' for i in range(60)] + ["01/02/2025", '"two\nlines"', "5.00", ""]) + "\n")
    got = CSV.read_ing_csv(spark, path).first()
    assert got["description"] == "two\nlines" and str(got["amount"]) == "5.00"
    assert [got["raw"][n] for n in more] == [f'a, "{i}"' for i in range(60)]


def test_paypal_reference_past_the_readers_width(spark, tmp_path):
    fill = [f"F{i}" for i in range(28)]
    head = ["Date", "Name", "Type", "Status", "Currency", "Gross", "Fee", "Transaction ID", *fill, "Reference Txn ID"]

    def line(kind, currency, gross, key, parent):
        return ",".join(["01/02/2025", "Shop", kind, "Completed", currency, gross, "0", key, *["f"] * len(fill), parent])

    text = "\n".join([",".join(head), line("Payment", "USD", "-50.00", "A", ""), line("General Currency Conversion", "AUD", "-75.50", "B", "A"), line("General Currency Conversion", "USD", "50.00", "C", "A")])
    path = put(tmp_path, "a.csv", text + "\n")
    assert rows(CSV.read_paypal_csv(spark, path), "amount", "currency", "original_amount") == [("-75.50", "AUD", "-50.00")]


@pytest.mark.parametrize("empty", ("", '""'))
def test_width_does_not_depend_on_what_is_in_a_cell(spark, tmp_path, empty):
    fill = [f"F{i}" for i in range(28)]
    head = ["Date", "Name", "Type", "Status", "Currency", "Gross", "Fee", "Transaction ID", *fill, "Reference Txn ID"]

    def line(kind, currency, gross, key, parent):
        return ",".join(["01/02/2025", "Shop", kind, "Completed", currency, gross, "0", key, *[empty] * len(fill), parent])

    text = "\n".join([",".join(head), line("Payment", "USD", "-50.00", "A", ""), line("General Currency Conversion", "AUD", "-75.50", "B", "A"), line("General Currency Conversion", "USD", "50.00", "C", "A")])
    path = put(tmp_path, "a.csv", text + "\n")
    assert rows(CSV.read_paypal_csv(spark, path), "amount", "currency", "original_amount") == [("-75.50", "AUD", "-50.00")]
    wide = [f"X{i}" for i in range(24)]
    ing = put(tmp_path / "ing", "a.csv", ",".join([*wide, "Date", "Description", "Credit", "Debit"]) + "\n" + ",".join([empty] * 24 + ["01/02/2025", '"a, b"', "5.00", ""]) + "\n")
    got = CSV.read_ing_csv(spark, ing).first()
    assert got["description"] == "a, b" and str(got["amount"]) == "5.00" and got["raw"]["X23"] == ""


def slow_csv(text):
    """Rows of a CSV text character by character: a quote opens a cell only where the cell starts."""
    row, cell, inside, opened, seen, out = [], "", False, False, "", []
    text = text.lstrip("\ufeff") + "\n"
    i = 0
    while i < len(text):
        c = text[i]
        seen += c
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                inside = False
            else:
                cell += c
        elif c == '"' and cell == "" and not opened:
            inside = opened = True
        elif c in ",\n":
            row, cell, opened = [*row, cell], "", False
            if c == "\n":
                if seen.strip():
                    out.append(row)
                row, seen = [], ""
        else:
            cell += c
        i += 1
    return out


@pytest.mark.parametrize("lines_of_a_chunk", (1, 3, 20_000))
def test_quoted_line_ends_in_split_files(spark, tmp_path, monkeypatch, lines_of_a_chunk):
    """Rows equal those of a reader that goes through the file character by character, wherever blocks and chunks end."""
    import random

    from tallyloom.sources import cells

    monkeypatch.setattr(running, "CHUNK_ROWS", lines_of_a_chunk)
    rnd = random.Random(lines_of_a_chunk)
    pieces = ["a", "", "12\" pipe", '"x"', '"two\nlines"', '"a ""quoted"" word"', '"three\n\n""x"",\nlines"', '""', '"\n"', '","', "plain text", '"ends ""\n"', '"""\nstart"']
    want = []
    for name in ("a.csv", "b.csv"):
        text = "\ufeffh1,h2,h3\n" + "".join(",".join(rnd.choice(pieces) for _ in range(rnd.choice((1, 3, 30)))) + "\n" for _ in range(150))
        put(tmp_path / "q", name, text)
        want += [(name, tuple(r)) for r in slow_csv(text)]
    put(tmp_path / "q", "plain.csv", 'a,"b"\n1,2\n')
    want += [("plain.csv", ("a", "b")), ("plain.csv", ("1", "2"))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        read = cells.read_cells(spark, str(tmp_path / "q"))
        got = read.orderBy("file", "block", "seq").collect()
        assert len({(r["file"], r["block"]) for r in got}) > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    def bare(cells_):
        cells_ = [c or "" for c in cells_]
        while cells_ and cells_[-1] == "":
            cells_.pop()
        return tuple(cells_)

    assert [(r["file"].rsplit("/", 1)[1], bare(r["cells"])) for r in got] == [(n, bare(c)) for n, c in want]


def test_a_quote_that_stays_open_does_not_swallow_the_file(spark, tmp_path, monkeypatch):
    from tallyloom.sources import cells

    monkeypatch.setattr(cells, "ROW_LINES", 5)
    text = "Date,Description,Credit,Debit\n" + '01/02/2025,"open,1.00,\n' + "".join(f"01/02/2025,Shop {i},{i}.00,\n" for i in range(1, 30))
    got = rows(CSV.read_ing_csv(spark, put(tmp_path, "a.csv", text)), "description", "amount")
    assert ("Shop 29", "29.00") in got and len([g for g in got if g[0].startswith("Shop")]) == 29


def test_one_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    from tallyloom.sources import cells

    text = "Date,Description,Credit,Debit\n" + '01/02/2025,"two\nlines",7.00,\n' + "".join(f"01/02/2025,Shop {i},{i}.00,\n" for i in range(1, 4000))
    path = put(tmp_path, "a.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = cells.read_quoted(spark, [path])
        assert read.select("block").distinct().count() > 5 and read.count() == 4001
        assert ("two\nlines", "7.00") in rows(CSV.read_ing_csv(spark, path), "description", "amount")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unreadable_amounts_go_to_quarantine(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Date,Description,Credit,Debit\n01/02/2025,Bad,12.x,\n01/02/2025,Blank,,\n01/02/2025,Zero,0,0\n01/02/2025,Good,,3\n")
    got = rows(CSV.read_ing_csv(spark, path), "description", "amount", "reject_reason")
    assert got == [("Bad", "None", "unreadable amount"), ("Good", "-3.00", "None")]


@pytest.mark.parametrize("chunk", (2, 3, 20_000))
def test_values_below_their_label_over_chunk_borders(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(running, "CHUNK_ROWS", chunk)
    lines = ["x", "Closing Balance", "", "$1,234.50", "01 Jan 2019 to", "", "", "31 Jan 2019", "end"]
    path = put(tmp_path, "a.txt", "\n".join(lines) + "\n")
    marked = ST.mark_lines(LN.read_lines(spark, path), ST.HSBC)
    facts = ST.hsbc_attributes(marked).first()
    assert (facts["year"], facts["closing_balance"]) == ("2019", "1,234.50")


def test_a_statement_without_a_year_says_so(spark, tmp_path):
    from dataclasses import replace

    for name in ("bare", "dated"):
        (tmp_path / name).mkdir()
    bare = put(tmp_path / "bare", "a.txt", "03 Mar CORNER SHOP 4.50\n04 Mar 2021 BAKERY 2.00\n")
    dated = put(tmp_path / "dated", "a.txt", "line\nissued 2019\n03 Mar CORNER SHOP 4.50\n")

    def read(path, **changes):
        out = ST.stitch_hsbc(LN.read_lines(spark, path), replace(ST.HSBC, **changes))
        return sorted((str(r["txn_date"]), r["raw"].get("year")) for r in out.collect())

    assert read(bare) == [("2021-03-03", None), ("2021-03-04", None)]
    assert read(bare, year_lines=1, default_year="2018") == [("2018-03-03", "assumed"), ("2021-03-04", None)]
    assert read(dated) == [("2019-03-03", None)]
    assert read(dated, year_lines=1) == [("2025-03-03", "assumed")]


def test_next_value_over_blocks(spark):
    df = spark.createDataFrame([("f", 0, 0, "a"), ("f", 0, 1, ""), ("f", 9, 2, ""), ("f", 9, 3, "b"), ("g", 0, 4, "c")], "file string, block long, seq long, text string")
    got = {r["seq"]: r["n"] for r in running.with_next(df, "text", "n").collect()}
    assert got == {0: "b", 1: "b", 2: "b", 3: None, 4: None}


def test_undated_and_nameless_records_are_seen(spark):
    known = spark.createDataFrame([("s", "basiq:1", "2025-01-05")], "source_type string, reference_id string, d string").withColumn("txn_date", F.to_date("d"))
    new = spark.createDataFrame([("s", None), ("s", "2025-01-04"), ("s", "2025-01-05")], "source_type string, d string").withColumn("txn_date", F.to_date("d"))
    assert sorted(str(r["d"]) for r in OB.incremental_since(new, known).collect()) == ["2025-01-05", "None"]
    raw = spark.createDataFrame(
        [(i, "posted", "1.00", "2025-01-01", "t", "AUD", *[None] * 6, "f", 0, 0) for i in (None, " ", "7")],
        ", ".join(f"`{n}` string" for n in OB.TEXT_FIELDS) + ", file string, block long, seq long",
    )
    assert sorted(str(r["reject_reason"]) for r in OB.parse_openbanking(raw, "s").collect()) == ["None", "no record id", "no record id"]


def test_no_machine_local_scratch_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        scratch_root(Session())


def test_files_without_header_are_seen(spark, tmp_path):
    put(tmp_path, "good.csv", "Date,Description,Credit,Debit\n01/02/2025,Good,,3\n")
    path = put(tmp_path, "bad.csv", "a,b\n1,2\n3,4\n")
    got = rows(CSV.read_ing_csv(spark, path), "description", "amount", "reject_reason")
    assert got == [("", "None", "no header row"), ("Good", "-3.00", "None")]
    other = put(tmp_path / "more", "bad.csv", "a,b\n1,2\n3,4\n")
    assert [r["reject_reason"] for r in CSV.read_airbnb_csv(spark, other).collect()] == ["no header row"]
    assert [r["reject_reason"] for r in CSV.read_paypal_csv(spark, other).collect()] == ["no header row"]


def test_balances_look_up_only_the_newest_record(spark):
    from tallyloom.operators.accounts import latest_balance

    rows_ = [(f"a{i % 3}", f"h{i}", 2020 + i % 2, f"2025-01-{1 + i:02d}", i, "2.50", {"balance": f"{i}.00"}) for i in range(12)]
    txns = spark.createDataFrame(rows_, "account_id string, dedup_hash string, fy int, d string, arrival long, a string, raw map<string,string>")
    txns = txns.withColumns({"txn_date": F.to_date("d"), "amount": F.col("a").cast("decimal(18,2)")})
    accounts = spark.createDataFrame([(f"a{i}", "checking", True) for i in range(4)], "account_id string, account_type string, display boolean")
    columns = ("account_id", "transaction_count", "balance")
    found = latest_balance(txns.drop("raw"), accounts, txns.select("fy", "dedup_hash", "raw"))
    assert rows(found, *columns) == rows(latest_balance(txns, accounts), *columns)
    assert rows(found, *columns)[0] == ("a0", "4", "9.00")


def test_large_csv_files_are_split(spark, tmp_path):
    from tallyloom.sources import cells

    head = "Date,Description,Credit,Debit\n"
    put(tmp_path / "ing", "plain [1] ä.csv", head + "".join(f'01/02/2025,"Shop, {i}",{i}.50,\n' for i in range(1, 400)))
    path = put(tmp_path / "ing", "quoted %41+.csv", head + '01/02/2025,"two\nlines",7.00,\n01/02/2025,"""x""",8.00,\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        split = cells.read_cells(spark, path)
        assert split.select("file", "block").distinct().count() > 3
        got = rows(CSV.read_ing_csv(spark, path), "description", "amount", "reject_reason")
        airbnb = put(tmp_path / "air", "a.csv", "note\nDate,Type,Amount,Paid out\n" + "".join(f"01/31/2025,Payout,{i},{i}\n" for i in range(1, 600)))
        assert len(rows(CSV.read_airbnb_csv(spark, airbnb), "amount")) == 599
        headless = put(tmp_path / "none", "a.csv", "a,b\n" * 3000)
        assert rows(CSV.read_ing_csv(spark, headless), "reject_reason") == [("no header row",)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 401 and ("two\nlines", "7.00", "None") in got
