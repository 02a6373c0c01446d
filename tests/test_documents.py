import datetime

import pytest
from duebook.operators import documents, proofs
from duebook.operators.ingest import folded
from pyspark.sql import functions as F

D = datetime.date
GSTIN = "27AAPFU0939F1ZV"
OTHER = "29AAGCB7383J1Z4"


def read(spark, *texts, **kw):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(2)
    return sorted(documents.invoice_fields(df, **kw).collect(), key=lambda r: r.k)


INLINE = f"""TAX INVOICE
Seller: Blue Traders Pvt Ltd
GSTIN: {GSTIN}
Bill To: Acme Industries
GSTIN/UIN: {OTHER}
Invoice No: SI/2024-001
Date: 01/02/2024
Invoice Date: 3rd March 2024
Due Date: 1 Jan 2024
Pay by: 02-04-2024
PO No: PO-9/1
Customer ID: C-77
Taxable value: Rs. 1,000.00
CGST @ 9%: 90.00
SGST @9%: ₹90.00
Total: ₹ 500.00
Grand Total: ₹ 1,180.00
"""


def test_the_best_label_wins(spark):
    r = read(spark, INLINE)[0]
    assert (r.number, r.invoice_date, r.due_date, str(r.total), r.currency) == ("SI/2024-001", D(2024, 3, 3), D(2024, 4, 2), "1180.00", "INR")
    assert (r.seller, r.seller_gstin, r.buyer, r.buyer_gstin, r.buyer_ref) == ("Blue Traders Pvt Ltd", GSTIN, "Acme Industries", OTHER, "C-77")
    assert (r.order_number, str(r.taxable_amount), str(r.cgst), str(r.sgst), r.igst) == ("PO-9/1", "1000.00", "90.00", "90.00", None)
    # total 1.0, number .98, issued .98, due .98 - 4 * .015, buyer .95, currency .99
    assert (r.confidence, r.missing) == (round((1 + 0.98 + 0.98 + 0.92 + 0.95 + 0.99) / 6, 3), "")


LAYOUTS = [
    ("Invoice No\nBILL-12\nInvoice Date\n2024-01-05\nTerms: Net 30\nBuyer\nZed LLP\nTotal\nINR 900", ("BILL-12", D(2024, 1, 5), D(2024, 2, 4), "900.00", "INR", "Zed LLP", "")),
    ("Ref: INV_22-7 paid\nDocument Date: Jan 5, 2024\nCash on delivery\nSold to: Q Co\nBalance Due $12.5", ("INV_22-7", D(2024, 1, 5), D(2024, 1, 5), "12.50", "USD", "Q Co", "")),
    ("Invoice: 12/05/2024\nInvoice: tax\nbill 5551234567890\nDue on: 7/8/2024\nCustomer:\nGSTIN 1\nC1\nTotal 0", (None, None, D(2024, 8, 7), None, None, "C1", "number,invoice_date,total")),
    ("Invoice #A77\nDate: 31/01/2024\nDue Date: 30/01/2024\nCredit period 400 days\nM/s. Om\nAmount due: EUR 1,00,000.50", ("A77", D(2024, 1, 31), None, "100000.50", "EUR", "Om", "due_date")),
    ("Inv 9Z1\nInvoice date: 13.02.2024\nwithin 10 days\nTerms: within 10 days\nFrom: Me Ltd\nBill to: Me Ltd\nYou Ltd\nTotal 7 usd", ("9Z1", D(2024, 2, 13), D(2024, 2, 23), "7.00", "USD", "You Ltd", "")),
]


def test_layouts(spark):
    for r, (_, want) in zip(read(spark, *(t for t, _ in LAYOUTS)), LAYOUTS):
        assert (r.number, r.invoice_date, r.due_date, r.total if r.total is None else str(r.total), r.currency, r.buyer, r.missing) == want


def test_candidates_are_listed(spark):
    rows = documents.invoice_candidates(spark.createDataFrame([(INLINE, 1)], "text string, id int")).collect()
    days = {(r.value, round(r.score, 6)) for r in rows if r.field == "due_date"}
    assert days == {("2024-01-01", 0.98), ("2024-04-02", 0.92)} and {r.id for r in rows} == {1}
    assert {r.value for r in rows if r.field == "total"} >= {"500.00", "1180.00"}


def test_readings(spark):
    whole = INLINE
    worse = INLINE.replace("Invoice Date", "Inv Date")
    rows = [
        ("a", "text", worse), ("a", "layout_text", whole), ("b", "text", "no"), ("b", "ocr", whole), ("c", "text", "Grand total 5 and thirty characters"), ("c", "layout_text", None), ("d", "text", "short"), ("e", "text", whole), ("e", "ocr", whole),
    ]
    got = {r.doc: r for r in documents.best_readings(spark.createDataFrame(rows, "doc string, reading string, text string"), ["doc"]).collect()}
    assert {k: (r.reading, r.problem) for k, r in got.items()} == {"a": ("layout_text", None), "b": ("ocr", None), "c": (None, "REQUIRED_FIELDS_MISSING"), "d": (None, "UNREADABLE"), "e": ("text", None)}
    assert got["b"].confidence == pytest.approx(got["e"].confidence * 0.85, abs=1e-3)
    assert got["c"].missing == "number,buyer,invoice_date,due_date,total" and got["a"].missing == ""


def test_proofs(spark):
    texts = [
        f"Receipt\nPaid by: Acme & Sons\nAgainst invoice no: INV-7/1\nAmount paid: x\nPaid amount ₹ 1,234.50\nPaid on 5 Feb 2024\nUTR: ABCDEF123\n{GSTIN}",
        "Bill paid\nDOC1_22\n$ 45.10\n2024-02-30 or 29/02/2024", "nothing here", None,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    a, b, c, d = sorted(proofs.proof_fields(df).collect(), key=lambda r: r.k)
    assert (a.reference, str(a.amount), a.paid_on, a.customer_name, a.gstin, a.payment_reference, a.confidence, a.candidates) == ("INV-7/1", "1234.50", D(2024, 2, 5), "Acme & Sons", GSTIN, "ABCDEF123", 1.0, 1)
    assert (b.reference, str(b.amount), b.paid_on, b.confidence) == ("DOC1_22", "45.10", D(2024, 2, 29), 1.0)
    assert (c.amount, c.paid_on, d.amount, d.confidence) == (None, None, None, 0.5)


def test_proof_tables(spark):
    kind = "file string, row_number long, invoice string, date string, amount string, gstin string, customer_name string, payment_reference string"
    rows = [("a", 3, "x", "bad", "5", None, "", None), ("a", 2, " INV-1 ", "1/2/2024", "1,000", "", " Z ", "U1"), ("b", 9, "", "2/2/2024", "-1", None, None, None)]
    got = {r.file: r for r in proofs.table_proofs(spark.createDataFrame(rows, kind), ["file"]).collect()}
    assert (got["a"].reference, str(got["a"].amount), got["a"].paid_on, got["a"].candidates, got["a"].customer_name, got["a"].gstin, got["a"].confidence) == ("INV-1", "1000.00", D(2024, 2, 1), 2, "Z", None, 0.9)
    assert (got["b"].reference, got["b"].amount, got["b"].candidates) == (None, None, 1)


def test_readings_are_dealt_and_read_once(spark):
    rows = spark.createDataFrame([("a", "text", "Invoice No: INV-1"), ("a", "ocr", None)], "doc string, reading string, text string")
    plan = documents.best_readings(rows, ["doc"])._jdf.queryExecution().executedPlan().toString()
    # readings of one document are together before they are compared, and a text is made plain once
    assert (plan.count("RoundRobin"), plan.count("ArrowEvalPython [_nfkc")) == (0, 1)


def test_days_and_texts_beyond_ascii(spark):
    texts = ["1st/2/2000", "٣/٤/2001", "3rd March 2001", "#: 5 May 2001 -", "2001-2-30", "", "INV-2001", "1/2/2000\0", "May\t5, 2001", "1– 2"]
    rows = spark.createDataFrame([(1, texts), (2, []), (3, None), (4, [None, "4/5/2001"])], "k int, a array<string>")
    got = {r.k: r.d for r in rows.select("k", proofs.receipt_days(F.col("a")).alias("d")).collect()}
    assert got == {1: [D(2000, 2, 1), D(2001, 4, 3), D(2001, 3, 3), D(2001, 5, 5), None, None, None, None, D(2001, 5, 5), None], 2: [], 3: None, 4: [None, D(2001, 5, 4)]}
    said = ["A\r\nB\r C", "a \t\f b", "x  \n\n\n\n y ", "ｌ2O20 1l,5", "Straße ﬁ ‑–", None]
    plain = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").orderBy("k").select(documents.plain_text(F.col("t"), True).alias("p")).collect()]
    assert plain == ["A\nB\nC", "a b", "x\n\ny", "l2020 11,5", "Straße fi --", None]
    assert [r.f for r in spark.createDataFrame([("ABC",), ("Straße ﬁ İ",), (None,)], "t string").select(folded(F.col("t")).alias("f")).collect()] == ["abc", "strasse fi i̇", None]


def test_days_and_amounts_behind_no_label(spark):
    """What can't be a day or an amount behind a label gives way to what stands elsewhere, in order."""
    texts = ["Paid on: 30-02-2024\nseen 3/4/2024", "Paid on: 28.02.2024 or 1/1/2020", "Amount paid: 0\n$ 7.25", "PA\u0130D BY: Ann Lee", "by Bo, paid"]
    got = [(r.paid_on, r.amount if r.amount is None else str(r.amount), r.customer_name) for r in proofs.proof_fields(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")).orderBy("k").collect()]
    assert got[0][0] == D(2024, 4, 3) and got[1][0] == D(2024, 2, 28) and got[2][1] == "7.25" and got[4][2] is None
    plan = proofs.proof_fields(spark.createDataFrame([(1, "x")], "k int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[-/.]" in plan and "CASE WHEN RLIKE(lambda" in plan
