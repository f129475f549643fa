import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import stitch as ST
from tallyloom.operators import running
from tallyloom.sources import csv_sources as CSV
from tallyloom.sources import lines as LN
from tallyloom.sources import openbanking as OB


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def rows(df, *columns):
    return sorted((tuple(str(v) for v in r) for r in df.select(*columns).collect()))


def test_ing_by_header_name(spark, tmp_path):
    text = (
        '﻿Date,Description,Credit,Debit,Balance\n15/01/2025,"WOOL, ""X""\nSYDNEY",,"-1,200.50",3\n'
        '16/1/2025,Pay,"$3,000.00",7,4\n31/02/2025,Bad,1,,2\n,none,1,,\n17/01/2025,Zero,0,0,1\n18/01/2025,,1,,1\n'
    )
    put(tmp_path, "a.csv", text)
    path = put(tmp_path, "b.csv", "Balance,Date,Description,Debit,Credit\n9,01/02/2025,other order,5,\n")
    got = rows(CSV.read_ing_csv(spark, path), "txn_date", "description", "amount", "reject_reason")
    assert got == [
        ("2025-01-15", 'WOOL, "X"\nSYDNEY', "-1200.50", "None"),
        ("2025-01-16", "Pay", "3000.00", "None"),
        ("2025-02-01", "other order", "-5.00", "None"),
        ("None", "Bad", "1.00", "unreadable date"),
    ]


def test_bankwest_debit_first(spark, tmp_path):
    head = "BSB Number,Account Number,Transaction Date,Narration,Cheque Number,Debit,Credit,Balance,Transaction Type\n"
    path = put(tmp_path, "a.csv", head + "1,2,03/04/2025,SHOP,,12.00,13.00,5,WDL\n1,2,04/04/2025,PAY,,,13.00,5,DEP\n")
    assert rows(CSV.read_bankwest_csv(spark, path), "description", "amount") == [("PAY", "13.00"), ("SHOP", "-12.00")]


def test_amex_flips_signs(spark, tmp_path):
    head = "Date,Description,Card Member,Account #,Amount,Foreign Spend Amount,Commission,Exchange Rate\n"
    path = put(tmp_path, "a.csv", head + "01/02/2025,HOTEL,A,1,120.00,80.00,2,1.5\n01/02/2025,PAY,A,1,-120.00,,,\n")
    got = rows(CSV.read_amex_csv(spark, path), "description", "amount", "original_amount", "original_currency")
    assert got == [("HOTEL", "-120.00", "-80.00", "None"), ("PAY", "120.00", "None", "None")]


def test_airbnb_layouts(spark, tmp_path):
    put(
        tmp_path,
        "a.csv",
        "Report for host\n\nDate,Type,Listing,Guest,Amount,Payout,Host fee,Confirmation code\n"
        "01/02/25,Reservation,Flat,Ann,100,97.0,-3,HM1\n2025-03-01,Payout,,,50,,,\nx/y/z,Res,,,5,5,,\n02/02/25,Res,,,1,abc,,\n",
    )
    path = put(tmp_path, "b.csv", "Date,Total\n1/3/2025,12.5\n1/3/2025,0\n")
    got = rows(CSV.read_airbnb_csv(spark, path), "description", "amount", "fee", "txn_date", "reject_reason")
    assert got == [
        ("Airbnb", "12.50", "0.00", "2025-03-01", "None"),
        ("Airbnb - Payout", "50.00", "0.00", "2025-03-01", "None"),
        ("Airbnb - Res", "5.00", "0.00", "None", "unreadable date"),
        ("Airbnb - Res", "None", "0.00", "2025-02-02", "unreadable amount"),
        ("Airbnb - Reservation - Flat - Ann", "97.00", "3.00", "2025-02-01", "None"),
    ]


ACTIVITY = (
    "Date,Time,Time Zone,Description,Currency,Gross,Fee,Net,Balance,Transaction ID,From email,Name,Bank Name,"
    "Bank Account,Shipping and handling amount,GST,Invoice ID,Reference Txn ID\n"
)


def activity(date, kind, currency, gross, fee, txn, name, ref=""):
    return f"{date},1,s,{kind},{currency},{gross},{fee},0,,{txn},,{name},,,,,,{ref}\n"


def test_paypal_conversions(spark, tmp_path):
    put(
        tmp_path,
        "a.csv",
        ACTIVITY
        + activity("10/03/2025", "Pre-approved payment", "USD", "-50.00", "0.00", "MAIN", "Twilio", "B-1")
        + activity("10/03/2025", "General currency conversion", "USD", "50.00", "0.00", "C1", "", "MAIN")
        + activity("10/03/2025", "General currency conversion", "AUD", "-75.50", "0.00", "C2", "", "MAIN")
        + activity("18/03/2026", "Payment refund", "USD", "79.00", "0.00", "REFUND", "Private Inc", "ORIG")
        + activity("20/02/2025", "Payment received", "AUD", "200.00", "-5.00", "T2", "Client")
        + activity("20/02/2025", "Temporary Hold", "AUD", "200.00", "-5.00", "T3", "Client")
        + activity("21/02/2025", "Payment", "EUR", "-9.00", "0", "T4", "Half")
        + activity("21/02/2025", "General currency conversion", "EUR", "9.00", "0", "", "", "T4")
        + activity("22/02/2025", "Fee", "AUD", "-1.00", "0", "", "")
        + activity("22/02/2025", "Fee", "AUD", "x", "0", "T5", ""),
    )
    legacy = "Date,Type,Status,Currency,Gross,Fee,Net,Name,Transaction ID,Reference Txn ID\n"
    path = put(tmp_path, "b.csv", legacy + '1/1/2025,Pay,Pending,AUD,5,0,5,N,T9,\n1/1/2025,Pay,Completed,AUD,"1,005",0,5,,T10,\n')
    got = rows(CSV.read_paypal_csv(spark, path), "description", "amount", "currency", "original_amount", "original_currency", "fee", "reject_reason")
    assert got == [
        ("Client", "200.00", "AUD", "None", "None", "5.00", "None"),
        ("Fee", "-1.00", "AUD", "None", "None", "0.00", "None"),
        ("Fee", "None", "AUD", "None", "None", "0.00", "unreadable amount"),
        ("Half", "-9.00", "EUR", "None", "None", "0.00", "None"),
        ("Pay", "1005.00", "AUD", "None", "None", "0.00", "None"),
        ("Private Inc", "79.00", "USD", "79.00", "USD", "0.00", "None"),
        ("Twilio", "-75.50", "AUD", "-50.00", "USD", "0.00", "None"),
    ]


def test_openbanking(spark, tmp_path):
    lines = [
        {"id": "1", "status": "posted", "amount": "-4.50", "postDate": "2025-02-03T10:00:00Z", "description": "X", "class": {"type": "payment"}},
        {"id": "2", "status": "pending", "amount": "1", "postDate": "2025-02-03", "description": "Y"},
    ]
    path = put(tmp_path, "a.json", "\n".join(json.dumps(x) for x in lines))
    row = OB.read_openbanking_json(spark, path, "ing").collect()
    assert [(r["reference_id"], str(r["txn_date"]), float(r["amount"]), r["currency"]) for r in row] == [("basiq:1", "2025-02-03", -4.5, "AUD")]
    assert json.loads(row[0]["raw"]["class"]) == {"type": "payment"}


STATEMENTS = {
    "ing": (
        """Your statement
01/07/2024 to 30/06/2025
Date Details Money out $ Money in $ Balance $
Opening balance 100.00
02/07/2024 Visa Purchase - WOOLWORTHS -100.00 1,234.56
SYDNEY  AU
03/07/2024 Salary Deposit
Employer Pty 3,000.00 4,234.56
Page 1 of 2
Date Details Money out $ Money in $ Balance $
continued text
04/07/2024 Fee 1.00 0.00 4,233.56
Total Fees Financial Year 1.00
05/07/2024 not a txn 5.00 6.00
There were no transactions
Date Details Money out $ Money in $ Balance $
Important Reminder ignored as no entry is open
06/07/2024 Late -9.00 1.00
31/02/2024 bad date -1.00 2.00
""",
        [
            ("2024-07-02", "Visa Purchase - WOOLWORTHS SYDNEY AU", "-100.00"),
            ("2024-07-03", "Salary Deposit Employer Pty continued text", "3000.00"),
            ("2024-07-04", "Fee", "-1.00"),
            ("2024-07-06", "Late", "-9.00"),
            ("None", "bad date", "-1.00"),
        ],
    ),
    "bankwest": (
        """Closing Balance $1,500.25
Date Description Debit Credit
02 Nov 25 PAYPAL *x 4029357733 AUS $500.00
12.99 PLN
11 Nov 25 BILL PAYMENT RECEIVED FROM ING $352.00
12 Nov 25 SHOP
REFUND part $5.00
extra
13 Nov 25 both $1.00 $3.50
14 Nov 25 nothing
""",
        [
            ("2025-11-02", "PAYPAL *x 4029357733 AUS (12.99 PLN)", "-500.00"),
            ("2025-11-11", "BILL PAYMENT RECEIVED FROM ING", "352.00"),
            ("2025-11-12", "SHOP REFUND part extra", "5.00"),
            ("2025-11-13", "both", "2.50"),
        ],
    ),
    "hsbc": (
        """Statement Period 01 Dec 2024 to 31 Jan 2025
Date Description Debit Credit Balance
OPENING BALANCE 5.00
01 Dec EFTPOS PURCHASE WOOLWORTHS 45.50 1,234.56
02 Dec SALARY 0.00 3,200.00 4,434.56
trailing ignored
03 Dec 24 two
lines 7.00 1.00
04/12 slash -20.00
05 Dec none
""",
        [
            ("2024-12-01", "EFTPOS PURCHASE WOOLWORTHS", "-45.50"),
            ("2024-12-02", "SALARY", "3200.00"),
            ("2024-12-03", "two lines", "-7.00"),
            ("2024-12-04", "slash", "20.00"),
        ],
    ),
    "coles": (
        """Statement Period 15/12/24 - 14/01/25
Closing Balance $99.10
Transaction Date Post Date Description Amount
01/01 03/01 WOOLWORTHS 1234 SYDNEY $45.50
02/01 02/01 PAYMENT RECEIVED -$200.00 CR
Jan 05 Zippay P66 Sydney Au 85424784348449865990798 80.00
06/01 multi
Page 2
line 5.00 CR
minimum payment 20.00
""",
        [
            ("2025-01-01", "WOOLWORTHS 1234 SYDNEY", "-45.50"),
            ("2025-01-02", "PAYMENT RECEIVED", "200.00"),
            ("2025-01-05", "Zippay P66 Sydney Au 85424784348449865990798", "-80.00"),
            ("2025-01-06", "multi line", "5.00"),
        ],
    ),
}


@pytest.mark.parametrize("bank", STATEMENTS)
def test_statements(spark, tmp_path, bank):
    text, want = STATEMENTS[bank]
    path = put(tmp_path, "a.txt", text)
    assert rows(ST.STITCHERS[bank](LN.read_lines(spark, path)), "txn_date", "description", "amount") == want


def test_year_fits_a_period_over_new_year(spark, tmp_path):
    hsbc = put(tmp_path / "h", "a.txt", "Statement Period 15 Dec 2024 to 14 Jan 2025\n20 Dec A 1.00\n02 Jan B 2.00\n03 Jan 24 C 3.00\n")
    coles = put(tmp_path / "c", "a.txt", "Statement Period 15/12/24 - 14/01/25\nDate Amount\n20/12 A 1.00\n02/01 B 2.00\n")
    lines = LN.read_lines(spark, hsbc)
    assert [d for d, _ in rows(ST.stitch_hsbc(lines), "txn_date", "description")] == ["2024-01-02", "2024-01-03", "2024-12-20"]
    got = rows(ST.stitch_hsbc(lines, infer_year=True), "description", "txn_date")
    assert got == [("A", "2024-12-20"), ("B", "2025-01-02"), ("C", "2024-01-03")]
    got = rows(ST.stitch_coles(LN.read_lines(spark, coles), infer_year=True), "description", "txn_date")
    assert got == [("A", "2024-12-20"), ("B", "2025-01-02")]


def test_text_after_a_reopened_header_belongs_to_no_entry(spark, tmp_path):
    text = """Date Details Money out Money in Balance
01/02/2025 Shop one -1.00 10.00
Always here to help
between
Date Details Money out Money in Balance
not part of shop one
02/02/2025 Shop two -2.00 8.00
"""
    got = rows(ST.stitch_ing(LN.read_lines(spark, put(tmp_path, "a.txt", text))), "description", "amount")
    assert got == [("Shop one", "-1.00"), ("Shop two", "-2.00")]


@pytest.mark.parametrize("bank", STATEMENTS)
@pytest.mark.parametrize("chunk_rows", [1, 7])
def test_statements_do_not_depend_on_chunks(spark, tmp_path, monkeypatch, bank, chunk_rows):
    monkeypatch.setattr(running, "CHUNK_ROWS", chunk_rows)
    text, want = STATEMENTS[bank]
    path = put(tmp_path, "a.txt", text)
    assert rows(ST.STITCHERS[bank](LN.read_lines(spark, path)), "txn_date", "description", "amount") == want


@pytest.mark.parametrize("bank", ["ing", "bankwest", "hsbc", "coles"])
def test_entries_of_very_many_lines_come_in_parts(spark, tmp_path, monkeypatch, bank):
    """No row gathers more than PART_LINES lines, the transaction stays, and what follows is in quarantine."""
    monkeypatch.setattr(ST, "PART_LINES", 4)
    monkeypatch.setattr(running, "CHUNK_ROWS", 5)
    head = {"ing": "Date Details Money out Money in Balance\n01/02/2025 Shop -1.00 10.00\n", "bankwest": "Date Description Debit Credit\n02 Nov 25 Shop $1.00\n",
            "hsbc": "02 Nov 24 Shop 1.00\n", "coles": "Date Description Amount\n02 Nov 24 Shop $1.00\n"}[bank]
    text = head + "".join(f"more {i}\n" for i in range(1, 21))
    got = ST.STITCHERS[bank](LN.read_lines(spark, put(tmp_path, "a.txt", text))).collect()
    good = [r for r in got if r["reject_reason"] is None]
    assert [(r["description"], str(r["amount"])) for r in good] == [("Shop more 1 more 2 more 3" if bank in ("ing", "bankwest") else "Shop", "-1.00")]
    parts = sorted((r for r in got if r["reject_reason"] == ST.TOO_LONG), key=lambda r: int(r["raw"]["part"]))
    lost = [line for r in parts for line in r["raw"]["text"].split("\n")]
    assert lost == ([f"more {i}" for i in range(4, 21)] if bank in ("ing", "bankwest") else [])


@pytest.mark.parametrize("chunk_rows", [1, 4, 20_000])
def test_running_values_equal_a_sequential_reader(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(running, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(chunk_rows)
    machine = running.Machine(((1, 2, 0), (0, 0, 2)), 1)
    data = [(f"f{f}", n // 7, n, rng.randrange(9), rng.choice([None, n]), rng.choice([0, 1, None])) for f in range(4) for n in range(60)]
    df = spark.createDataFrame(data, "file string, block int, seq long, v long, x long, e int")
    out = running.accumulate(
        df, {"s": F.col("v")}, {"l": F.col("x")}, earlier={"b": F.col("x")}, marks={"m": ("s", F.col("v") == 3)}, nexts={"n": F.col("x")}, states={"st": (machine, F.col("e"))}
    )
    got = {(r["file"], r["seq"]): tuple(r[c] for c in ("s", "l", "b", "m", "n", "st")) for r in out.collect()}
    for f in range(4):
        mine = [r for r in data if r[0] == f"f{f}"]
        total, last, mark, state = 0, None, None, 1
        for i, (_, _, seq, v, x, e) in enumerate(mine):
            before, total = last, total + v
            last = x if x is not None else last
            mark = total if v == 3 else mark
            state = machine.moves[e][state] if e is not None else state
            later = next((r[4] for r in mine[i + 1 :] if r[4] is not None), None)
            assert got[f"f{f}", seq] == (total, last, before, mark, later, state)


def sequential_section(kinds):
    """Which lines belong to an entry, read one by one."""
    state, kept = 0, []
    for n, kind in enumerate(kinds):
        if kind == "H":
            state = max(state, 1)
        elif kind == "D":
            state = 2 if state else 0
        elif kind == "F" and state == 2:
            state = 0
        if state and kind in "DT":
            kept.append(n)
    return kept


@pytest.mark.parametrize("chunk_rows", [3, 20_000])
def test_sections_equal_a_sequential_reader(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(running, "CHUNK_ROWS", chunk_rows)
    text = {"H": "Date Details Money", "D": "01/02/2003 x", "F": "Always here to help", "T": "text", "N": "Page 1 of 2"}
    rng = random.Random(5)
    files = {f"f{i}": [rng.choice("HDFTN") for _ in range(rng.randint(1, 40))] for i in range(60)}
    data = [(f, 0, n, text[k]) for f, kinds in files.items() for n, k in enumerate(kinds)]
    lines = spark.createDataFrame(data, "file string, block int, seq long, text string")
    out = ST.in_section(ST.mark_lines(lines, ST.ING)).select("file", "seq").collect()
    got = {f: sorted(r["seq"] for r in out if r["file"] == f) for f in files}
    assert got == {f: sequential_section(k) for f, k in files.items()}
    assert out and F is not None
