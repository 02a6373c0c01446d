import datetime
import difflib
import itertools
import math
import random

import numpy as np
import pytest
from duebook.operators import cleaning, diagnostics, documents, features, history, imports, ingest, listing, models
from duebook.sources import files
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

D = datetime.date


def test_same_invoice_id_of_two_tenants(spark):
    bills = spark.sql("SELECT CAST(b AS INT) business_id, 1L invoice_id, 7L customer_id, CAST(100 AS DECIMAL(14,2)) amount, DATE'2001-01-01' invoice_date, 30 terms, DATE'2001-01-31' due_date, 'CURRENT' origin FROM VALUES (1), (2) t(b)")
    paid = spark.createDataFrame([(1, 1, D(2001, 1, 5), 60.0), (1, 1, D(2001, 1, 9), 40.0), (2, 1, D(2001, 1, 7), 30.0)], "business_id int, invoice_id long, paid_on date, amount double").withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    got = {r.business_id: (float(r.paid), r.status, r.settled_on) for r in history.ledger(bills, paid).collect()}
    assert got == {1: (100.0, "PAID", D(2001, 1, 9)), 2: (30.0, "PARTIAL", None)}
    past = history.history_as_of(history.ledger(bills, paid))
    assert sorted((r.business_id, r.settled, r.median_delay) for r in past.collect()) == [(1, 0, None), (2, 0, None)]


def test_running_history_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(rng.randint(1, 2), k, rng.choice([1, 1, 1, 2, None]), D(2001, 1, 1) + datetime.timedelta(rng.randint(0, 60)), rng.randint(-5, 40)) for k in range(200)]
    data = [(b, k, c, day, day + datetime.timedelta(10), None if k % 4 == 0 else day + datetime.timedelta(10 + late)) for b, k, c, day, late in rows]
    df = spark.createDataFrame(data, "business_id int, invoice_id long, customer_id long, invoice_date date, due_date date, settled_on date")
    got = {r.invoice_id: r for r in history.history_as_of(df).collect()}
    assert len(got) == sum(r[2] is not None for r in data)
    for b, k, c, day, _, _ in data:
        if c is None:
            continue
        seen = sorted((s, i, (s - due).days) for bb, i, cc, inv, due, s in data if (bb, cc) == (b, c) and s is not None and max(s, inv) < day)
        delays = [x[2] for x in seen]
        r = got[k]
        assert r.settled == len(delays) and r.late == sum(x > 0 for x in delays)
        assert r.median_delay == (float(np.median(delays)) if delays else None)
        assert r.last3_mean_delay == (pytest.approx(np.mean(delays[-3:]), abs=1e-6) if delays else None)
        assert r.std_delay == (pytest.approx(np.std(delays, ddof=1), abs=2e-6) if len(delays) > 1 else 0.0 if delays else None)


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(1)
    names = set()
    for _ in range(40):
        base = "".join(rng.choices("abcd ", k=rng.randint(3, 40))).strip() or "a"
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "b"])
            names.add("".join(t))
    names = sorted(names - {""})
    got = {(r.a, r.b) for r in diagnostics.similar_names(spark.createDataFrame([("g", n) for n in names] + [("h", names[0]), ("h", None)], "group string, name string")).collect()}
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if difflib.SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert got == want and want


def test_dates_amounts_and_names(spark):
    dates = {"3/4/2020": D(2020, 4, 3), "03-04-2020": D(2020, 4, 3), "1st Feb 2020": D(2020, 2, 1), "2020-1-5": D(2020, 1, 5), "2020/01/05": D(2020, 1, 5), "Mar 7, 2020": D(2020, 3, 7), "2020-05-06T10:00:00": D(2020, 5, 6), "2020-05-06 nonsense": None, "31/02/2020": None, "": None, None: None}
    amounts = {"1,234.50": "1234.50", "12,34,567": "1234567.00", "₹ 99": "99.00", "Rs. 5": "5.00", "7 usd": "7.00", "+3": "3.00", "-3": None, "(3)": None, "1,23": None, "2.345": "2.34", "2.355": "2.36", "0": None, "1e5": None, None: None}
    names = {" Acme,  PVT. Ltd ": "acme private limited", "Straße": "strasse", "ＡＢＣ": "abc", "(;)": None, None: None}
    got = {r.t: (r.d, r.a, r.n) for r in spark.createDataFrame([(t,) for t in {*dates, *amounts, *names}], "t string").select("t", ingest.parse_date(F.col("t")).alias("d"), ingest.parse_amount(F.col("t")).alias("a"), ingest.company_name(F.col("t")).alias("n")).collect()}
    assert {t: got[t][0] for t in dates} == dates
    assert {t: None if got[t][1] is None else str(got[t][1]) for t in amounts} == amounts
    assert {t: got[t][2] for t in names} == names


def test_guards(spark):
    with pytest.raises(ValueError, match="tell the outcome"):
        features.assert_no_leakage(["amount", "is_late"])
    with pytest.raises(ValueError, match="nulls after"):
        cleaning.assert_no_nulls(spark.createDataFrame([(1, None)], "a int, b int"), ["a", "b"])
    with pytest.raises(ValueError, match="missing columns"):
        files.require_columns(["doc_id"])
    bills = spark.createDataFrame([], "business_id int, status string, due_date date, outstanding double")
    for wrong in ({"status": "odd"}, {"aging": "odd"}, {"sort": "odd"}, {"direction": "odd"}):
        with pytest.raises(ValueError, match="unknown"):
            listing.list_invoices(bills, "2001-01-01", **wrong)


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿companyName;Bill No.;Date;AMOUNT\nBüro;1;2/3/2020;5\n;;;\nx;2;3/3/2020;6\n".encode())
    rows = files.read_upload(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.row_number, r.customer_name, r.invoice, r.amount) for r in rows] == [(2, "Büro", "1", "5"), (4, "x", "2", "6")]
    (tmp_path / "b.csv").write_bytes("date|amount|party\n1/1/2020|3|Büro €\n".encode("cp1252"))
    assert files.read_upload(spark, str(tmp_path / "b.csv")).first().customer_name == "Büro €"
    (tmp_path / "c.csv").write_text("when,amount\n1,2\n")
    with pytest.raises(ValueError, match="missing columns: date"):
        files.read_upload(spark, str(tmp_path / "c.csv"))
    assert files.delimiter_of("a") == "," and files.header_key("InvoiceNo ") == "invoice_no"


def test_first_row_of_a_new_name_stands(spark):
    kind = "business_id int, row_number long, customer_name string, invoice string, date string, amount string, gstin string, customer_id string, customer_ref string, payment_reference string"
    rows = spark.createDataFrame([(1, 2, "New Co", "", "1/2/2020", "5", None, None, None, None), (1, 3, "NEW CO.", "", "1/2/2020", "5", None, None, None, None), (1, 4, None, "", "1/2/2020", "5", None, None, None, None), (1, 5, "A", "", "x", "5", None, None, None, None), (1, 6, "B", "", "1/2/2020", "5", None, "no", None, None)], kind)
    none = lambda s: spark.createDataFrame([], s)
    out = imports.classify(rows, none("business_id int, invoice_id long, number string, customer_id long"), none("business_id int, customer_id long, display_name string, gstin string, reference string"), none("business_id int, customer_key string, reference string, paid_on date, amount decimal(14,2)"))
    assert {r.row_number: (r.status, r.reason) for r in out.collect()} == {2: ("imported", "no such invoice"), 3: ("duplicate", "repeats a row of the file"), 4: ("rejected", "no customer"), 5: ("rejected", "date"), 6: ("rejected", "customer id")}
    assert [tuple(r) for r in imports.new_customers(out).collect()] == [(1, "new:new co", 2)]


def test_scanned_invoice(spark):
    text = "Tax Invoice\nInvoice No: SI-77\nDate: 10/02/2O20\nDue on receipt\nTotal: USD 1l,234.50\n"
    r = documents.invoice_fields(spark.createDataFrame([(text,), (None,)], "text string"), scanned=True).collect()
    assert (r[0].number, r[0].invoice_date, r[0].due_date, str(r[0].total), r[0].currency) == ("SI-77", D(2020, 2, 10), D(2020, 2, 10), "11234.50", "USD")
    assert r[1].missing == "number,buyer,invoice_date,due_date,total"


def test_contributions_add_up(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    late = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(k, *map(float, v), int(y), "validation" if k % 5 == 0 else "train", float(abs(v[0]) * 10)) for k, (v, y) in enumerate(zip(x, late))], "invoice_id long, a double, b double, c double, is_late int, split string, days_until_payment double")
    columns = ["a", "b", "c"]
    model, timing = models.train_classifier(rows, columns, 5), models.train_timing(rows, columns, 5)
    raw = {r.invoice_id: r.raw for r in model.transform(models._vectors(rows, columns)).select("invoice_id", vector_to_array("rawPrediction")[1].alias("raw")).collect()}
    for r in models.contributions(rows, columns, model).collect():
        assert r.bias + sum(r.parts) == pytest.approx(raw[r.invoice_id], abs=1e-9)
    scores = models.score(rows, columns, model, timing).collect()
    assert np.mean([r.predicted_late == late[r.invoice_id] for r in scores]) > 0.9 and all(r.predicted_days >= 0 for r in scores)
    shares = models.importance(model, columns, spark).collect()
    assert shares[0].feature == "a" and sum(r.importance for r in shares) == pytest.approx(1, abs=1e-5)


def worth(tree, x, known, node=0):
    """The mean of a tree for one row of which only some features are known."""
    feature, threshold, left, right, value, cover = tree
    f = feature[node]
    if f < 0:
        return value[node]
    if f in known:
        return worth(tree, x, known, left[node] if x[f] <= threshold[node] else right[node])
    return sum(cover[k] / cover[node] * worth(tree, x, known, k) for k in (left[node], right[node]))


def test_contributions_against_all_coalitions(spark, monkeypatch):
    monkeypatch.setattr(models, "DEPTH", 4)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 4)).astype(float)  # ties at the thresholds, features that a path splits twice
    late = (x[:, 0] * x[:, 1] + x[:, 2] ** 2 - x[:, 3] > 1).astype(int)
    columns = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(k, *map(float, v), int(y), "validation" if k % 5 == 0 else "train") for k, (v, y) in enumerate(zip(x, late))], "invoice_id long, a double, b double, c double, d double, is_late int, split string")
    model = models.train_classifier(rows, columns, 4)
    trees = models._trees(model)
    assert max(len(t[0]) for t in trees) > 15 and all(t[5][0] == t[5][left] + t[5][right] for t in trees for left, right in [(t[2][0], t[3][0])])
    x[7, 2] = np.inf
    got = models.contributions(rows.filter("invoice_id < 40").withColumn("c", F.when(F.col("invoice_id") == 7, float("inf")).otherwise(F.col("c"))), columns, model).collect()
    assert len(got) == 40
    for r in got:
        v = x[r.invoice_id]
        value = {s: sum(worth(t, v, s) for t in trees) for k in range(5) for s in map(frozenset, itertools.combinations(range(4), k))}
        assert r.bias == pytest.approx(value[frozenset()], abs=1e-9)
        for i in range(4):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[s | {i}] - value[s]) for s in value if i not in s)
            assert r.parts[i] == pytest.approx(want, abs=1e-9)
    assert models.contributions(rows.limit(0), columns, model).collect() == []


def test_trees_go_on_until_none_helps(spark, monkeypatch):
    assert [models._stop(losses, 3) for losses in ([5, 4, 6, 3, 3, 4, 3.5, 1], [5, 4, 6, 3, 3, 4], [1], [1, 2, 3, 4])] == [(4, True), (4, False), (1, False), (1, True)]
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 2))
    late = (np.sin(3 * x[:, 0]) + x[:, 1] + rng.standard_normal(600) / 2 > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, v), int(y), "validation" if k % 3 == 0 else "train") for k, (v, y) in enumerate(zip(x, late))], "a double, b double, is_late int, split string").coalesce(1)
    monkeypatch.setattr(models, "DEPTH", 2)
    monkeypatch.setattr(models, "PATIENCE", 6)
    whole = models.train_classifier(rows.withColumn("split", F.when(F.col("split") == "train", "train")), ["a", "b"], 40)
    assert len(whole.trees) == 40
    model = models.train_classifier(rows, ["a", "b"], 40)
    losses = whole.evaluateEachIteration(models._vectors(rows.filter("split = 'validation'").withColumn("label", F.col("is_late").cast("double")), ["a", "b"]))
    # one tree that gains little is no end, and the trees are the first of all 40
    assert len(model.trees) == models._stop(losses, 6)[0] > 5
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[: len(model.trees)]]
