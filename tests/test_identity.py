import random

from duebook.operators import identity
from pyspark.sql import functions as F


def digit(stem):
    """The check character, character by character."""
    total = 0
    for i, c in enumerate(stem):
        p = identity.ALPHABET.index(c) * (1 if i % 2 == 0 else 2)
        total += p // 36 + p % 36
    return identity.ALPHABET[(36 - total % 36) % 36]


def test_tax_numbers(spark):
    rng = random.Random(7)
    letters, stems = identity.ALPHABET[10:], []
    for _ in range(200):
        stems.append("".join([str(rng.randint(10, 37)), *rng.choices(letters, k=5), *rng.choices("0123456789", k=4), rng.choice(letters), rng.choice("123456789" + letters), "Z"]))
    good = [s + digit(s) for s in stems]
    bad = [s + identity.ALPHABET[(identity.ALPHABET.index(digit(s)) + 1) % 36] for s in stems]
    rows = [(v, v) for v in good] + [(v, None) for v in bad] + [(f" {good[0][:5].lower()} {good[0][5:]} ", good[0]), ("", None), (None, None), ("x" * 15, None)]
    got = spark.createDataFrame(rows, "text string, want string").select(identity.tax_number(F.col("text")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_cascade(spark):
    stem, other = "22AAAAA0000A1Z", "27BBBBB1111B1Z"
    tax, tax2 = stem + digit(stem), other + digit(other)
    customers = [(1, 10, tax, "R1", "Acme Pvt. Ltd."), (1, 11, None, "R2", "Bolt"), (1, 12, None, "R3", "Bolt"), (2, 20, tax, "R1", "Acme Private Ltd")]
    rows = [
        ("id", 1, 10, None, None, None, 10, "id"),
        ("other tenant's id", 1, 20, None, None, None, None, None),
        ("tax number", 1, None, tax.lower(), "R2", None, 10, "gstin"),
        ("reference", 1, None, None, " r2 ", "Acme Pvt Ltd", 11, "reference"),
        ("name", 1, None, None, None, "ACME private  limited", 10, "name"),
        ("ambiguous name", 1, None, None, None, "bolt", None, None),
        ("clashing tax number", 1, None, tax2, "R1", None, None, None),
        ("tenant", 2, None, None, "R2", "Acme", None, None),
        ("nulls", None, None, None, None, None, None, None),
    ]
    kind = "business_id long, customer_id long, gstin string, reference string, name string"
    given = spark.createDataFrame(rows, f"what string, {kind}, want long, want_by string")
    got = identity.resolve(given, spark.createDataFrame(customers, kind)).collect()
    assert len(got) == len(rows)
    assert [(r.what, r.resolved_id, r.resolved_by) for r in got if (r.resolved_id, r.resolved_by) != (r.want, r.want_by)] == []
    none = identity.resolve(given, spark.createDataFrame([], kind)).filter("resolved_id IS NOT NULL").count()
    assert none == 0
