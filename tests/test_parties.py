import difflib
import random

import pytest
from duebook.operators import diagnostics, parties
from duebook.sources import files
from pyspark.sql import functions as F

ROW = "business_id int, invoice_id long, seller_name string, seller_gstin string, seller_score double, buyer_name string, buyer_gstin string, buyer_score double, buyer_ref string, selected_id long"


def decide(spark, rows, customers, **kw):
    tenants = spark.createDataFrame([(1, "House Pvt Ltd"), (2, None)], "business_id int, name string")
    known = spark.createDataFrame(customers, "business_id int, customer_id long, display_name string, gstin string, reference string")
    return {r.invoice_id: r for r in parties.decide(spark.createDataFrame(rows, ROW), tenants, known, **kw).collect()}


def test_similar_names_are_never_merged(spark):
    customers = [(1, 7, "Northern Lights Trading Company", None, None), (1, 8, "Northern Lights Trading Companies", None, None), (1, 9, "Quite Another Firm", None, None), (2, 10, "Northern Lights Trading Company", None, None)]
    rows = [
        (1, 1, "House Private Limited", None, 0.9, "Northern Lights Trading Companys", None, 0.9, None, None), (1, 2, "House", None, 0.9, "Quite Another Firms", None, 0.9, None, None), (1, 3, None, None, None, "QUITE ANOTHER FIRM.", None, 0.9, None, None),
        (1, 4, None, None, 0.0, "Fresh Co", None, 0.9, None, None), (1, 5, None, None, 0.0, "fresh co.", None, 0.8, None, None), (1, 6, "Hause Pvt Ltd", None, 0.9, "Fresh Co", None, 0.9, None, None), (2, 7, "Any", None, 0.9, "Fresh Co", None, 0.9, None, None), (1, 8, None, None, 0.0, "House", None, 0.9, None, None),
        (1, 9, None, None, 0.0, "(;)", None, 0.9, None, None),
    ]
    got = decide(spark, rows, customers)
    assert [got[k].reason for k in (1, 2, 6, 7, 8, 9)] == ["several customers are similar", "one customer is similar", "seller only similar to the tenant", "seller not comparable", "buyer is the tenant", "no buyer name"]
    assert [(got[k].status, got[k].matched_by, got[k].matched_id) for k in (3, 4, 5)] == [("matched", "buyer_identity", 9), ("created", "created", None), ("matched", "buyer_identity", None)]
    assert got[4].owner_name == got[5].owner_name == "fresh co"
    ratio = lambda b: difflib.SequenceMatcher(None, "northern lights trading companys", b).ratio()
    a, b = sorted((ratio("northern lights trading company"), ratio("northern lights trading companies")), reverse=True)
    assert (got[1].n_similar, got[1].nearest, got[1].margin) == (2, pytest.approx(a), pytest.approx(a - b))
    held = decide(spark, rows[3:4] + [(1, 2, None, None, 0.0, None, None, 0.0, None, None)], customers, allow_create=False)
    assert {k: (r.status, r.reason) for k, r in held.items()} == {4: ("unresolved", None), 2: ("unresolved", None)}


def test_similar_customers_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdef ", k=25)).strip() + "z" for _ in range(12)]
    change = lambda t: t[: (k := rng.randrange(len(t)))] + rng.choice(["", "q", "qr"]) + t[k + rng.randint(0, 1) :]
    names, known = sorted({change(rng.choice(base)) for _ in range(60)}), sorted({change(rng.choice(base)) for _ in range(40)})
    known = [" ".join(n.split()) for n in known]
    names = sorted({" ".join(n.split()) for n in names})
    customers = spark.createDataFrame([(1, k, n) for k, n in enumerate(known)], "business_id int, customer_id long, display_name string")
    got = {r.name: (r.n_similar, r.nearest) for r in parties.similar_customers(spark.createDataFrame([(1, n) for n in names], "business_id int, name string"), customers).collect()}
    want = {}
    for n in names:
        ratios = [x for o in known if o != n and (x := difflib.SequenceMatcher(None, n, o).ratio()) >= 0.92]
        if ratios:
            want[n] = (len(ratios), pytest.approx(max(ratios)))
    assert got == want and want


def test_names_that_begin_alike_are_no_pairs(spark):
    names = spark.createDataFrame([("g", f"customer#{k:09d}") for k in range(0, 60000, 101)] + [("g", "customer#000000001"), ("g", "customer#00000000")], "group string, name string")
    got = {(r.a, r.b) for r in diagnostics.name_pairs(names, names).collect()}
    assert {("customer#000000001", "customer#000000101"), ("customer#00000000", "customer#000000001"), ("customer#000000001", "customer#00000000")} <= got
    # one digit stands elsewhere or is another: far fewer than the 356,000 pairs that begin alike
    assert all(difflib.SequenceMatcher(None, a, b).ratio() >= 0.88 for a, b in got) and len(got) < 6000


def test_same_organization(spark):
    pairs = {("acme", "acme"): True, ("acme private limited", "acme"): True, ("acme", "acme llp"): True, ("acme works", "acme"): False, ("acmeltd", "acme"): False, (None, "acme"): False}
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    assert {(r.a, r.b): r.same for r in df.select("a", "b", diagnostics.same_organization(F.col("a"), F.col("b")).alias("same")).collect()} == pairs


def test_uploaded_files_are_checked(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.4 x", "b.pdf": b"no", "d.exe": b"MZ", "e.jpg": b"\xff\xd8\xff\xe0", "f.png": b"\x89PNG" + b"x" * 99}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: (r.problem, r.length) for r in files.file_digests(spark, str(tmp_path), ("pdf", "png", "jpg"), 50).collect()}
    assert got == {"a.pdf": (None, 10), "b.pdf": ("not a PDF", 2), "d.exe": ("unsupported type", 2), "e.jpg": (None, 4), "f.png": ("too large", 103)}
