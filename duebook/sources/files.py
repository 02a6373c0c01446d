"""Files in and out. Executors read and write them; the driver sees headers and metadata only."""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the ERP export, and those that have to be there.
ERP_COLUMNS = (
    "business_code", "cust_number", "name_customer", "clear_date", "buisness_year", "doc_id", "posting_date", "document_create_date", "document_create_date.1", "due_in_date",
    "invoice_currency", "document type", "posting_id", "area_business", "total_open_amount", "baseline_create_date", "cust_payment_terms", "invoice_id", "isOpen",
)
ERP_REQUIRED = ("business_code", "cust_number", "name_customer", "clear_date", "doc_id", "posting_date", "due_in_date", "invoice_currency", "document type", "total_open_amount", "baseline_create_date", "cust_payment_terms", "isOpen")
#: The headers that an uploaded payment table may use, the first match in order wins.
HEADERS = {
    "customer_name": ("customer_name", "customer", "company", "company_name", "client", "client_name", "buyer", "buyer_name", "party", "party_name", "name_customer"),
    "invoice": ("invoice_number", "invoice_no", "invoice", "invoice_reference", "bill_number", "bill_no", "invoicenumber", "invoiceno"),
    "date": ("payment_date", "paid_date", "received_date", "date_received", "paymentdate", "date_paid", "clear_date", "date"),
    "amount": ("payment_amount", "paid_amount", "received_amount", "amount_paid", "amount_received", "paymentamount", "amount"),
    "gstin": ("gstin", "gstin_no", "gst_no", "gst_number", "gstin_uin"),
    "customer_id": ("customer_id", "customer_uuid"),
    "customer_ref": ("customer_reference", "customer_ref", "customer_number", "customer_no", "cust_number"),
    "payment_reference": ("reference", "payment_reference", "paymentreference", "utr", "transaction_id"),
}
DELIMITERS = (",", ";", "\t", "|")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only a local session may do without that setting."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to a new path in the shared folder, and read from there."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def require_columns(found: list[str], required: tuple[str, ...] = ERP_REQUIRED) -> None:
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_erp(spark: SparkSession, path: str) -> DataFrame:
    """The ERP export, all columns as text; an absent file or required column is an error."""
    found = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    require_columns(found.columns)
    return found


def write_csv(rows: DataFrame, path: str, delimiter: str = ",") -> str:
    rows.write.option("header", True).option("sep", delimiter).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def delimiter_of(header: str) -> str:
    """The most frequent delimiter of the first line, the comma where none occurs."""
    best = max(DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def header_key(name: str) -> str:
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", unicodedata.normalize("NFKC", name or "").strip())
    return re.sub(r"[^a-z0-9]+", "_", name.casefold()).strip("_")


def resolve_headers(names: list[str]) -> dict[str, str]:
    """Each known field with the column that holds it, by the order of its aliases."""
    keyed = {header_key(n): n for n in names if n}
    return {field: next(keyed[a] for a in aliases if a in keyed) for field, aliases in HEADERS.items() if any(a in keyed for a in aliases)}


def read_upload(spark: SparkSession, path: str, required: tuple[str, ...] = ("date", "amount"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_number, fields..., ``keep``) of uploaded delimited files: all text, blank rows left out.

    Files are UTF-8 (with or without a mark) or else Windows-1252. The first line of the first file that has
    any text names delimiter and columns; a row's number is its order in the files, from 2.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.limit(1).collect()
    if not first:
        raise ValueError("the upload is empty")
    mark = "﻿"
    sniffed = first[0].value.lstrip(mark)
    # Spark reads ISO 8859-1, which differs from Windows-1252 in the bytes 80 to 9F alone
    encoding = "iso-8859-1" if lines.filter(~F.is_valid_utf8("value")).limit(1).count() else "utf-8"
    sep = delimiter_of(sniffed)
    rows = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = rows.toDF(*(c.lstrip(mark) for c in rows.columns))
    if encoding != "utf-8":
        pairs = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
        rows = rows.select(*(F.translate(F.col(f"`{c}`"), "".join(a for a, _ in pairs), "".join(b for _, b in pairs)).alias(c) for c in rows.columns))
    columns = resolve_headers(rows.columns)
    missing = [f for f in required if f not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    blank = F.lit(True)
    for c in rows.columns:
        blank = blank & (F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == "")
    rows = rows.withColumn("row_number", F.monotonically_increasing_id() + 2).filter(~blank)
    return rows.select("row_number", *((F.trim(F.col(f"`{columns[f]}`")) if f in columns else F.lit(None).cast("string")).alias(f) for f in HEADERS), *keep)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> str:
    """One folder of Parquet for each split, and beside them a JSON manifest of their rows."""
    rows.write.partitionBy(split).parquet(f"{path}/rows")
    manifest = rows.sparkSession.read.parquet(f"{path}/rows").groupBy(split).agg(F.count("*").alias("n"))
    manifest.select(split, "n", F.lit(",".join(c for c in rows.columns if c != split)).alias("columns")).coalesce(1).write.json(f"{path}/manifest")
    return path


def read_splits(spark: SparkSession, path: str, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """The rows and the manifest (split, n, columns)."""
    return spark.read.parquet(f"{path}/rows"), spark.read.schema(f"{split} string, n long, columns string").json(f"{path}/manifest")


def file_digests(spark: SparkSession, path: str, extensions: tuple[str, ...], most_bytes: int) -> DataFrame:
    """(path, sha256, length, problem) of uploaded files: their size and name are checked before their contents count; Spark's scan leaves empty files out."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    problem = F.when(F.col("length") > most_bytes, "too large").when(~kind.isin(*extensions), "unsupported type")
    magic = F.hex(F.substring("content", 1, 4))
    wrong = F.when((kind == "pdf") & (magic != "25504446"), "not a PDF").when((kind == "png") & (magic != "89504E47"), "not a PNG").when(kind.isin("jpg", "jpeg") & ~magic.startswith("FFD8FF"), "not a JPEG")
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.coalesce(problem, wrong).alias("problem"))


