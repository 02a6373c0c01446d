"""Registered query: payments as workbooks that tasks write from the line items, read back as typed cells, with SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.spread import spread
from ..sources import files, workbooks
from . import views
from .queries import _query

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: The parts of a workbook of one sheet beside the sheet itself; style 1 shows dates.
_PARTS = {
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="payments" sheetId="1" r:id="one"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="one" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}"><si><t>Invoice No</t></si><si><t>amountPaid</t></si><si><t>Date Received</t></si></sst>',
}


@F.pandas_udf(BinaryType())
def _zipped(sheets: pd.Series) -> pd.Series:
    def one(rows: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, part in _PARTS.items():
                book.writestr(name, part)
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        return out.getvalue()

    return sheets.map(one)


def _books(s: SparkSession, d: str) -> DataFrame:
    """(path, content): a workbook for each thousand order numbers, so that none grows with the data."""
    lines = views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(views.MONEY).alias("price"), F.datediff(F.to_date("l_shipdate"), F.lit("1899-12-30").cast("date")).alias("day"))
    file = F.expr("l_orderkey DIV 1000")
    lines = lines.withColumn("file", file).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber", "price", "day")) + 1)
    cell = lambda value, more="": F.concat(F.lit(f"<c{more}><v>"), value.cast("string"), F.lit("</v></c>"))
    row = F.concat(F.lit('<row r="'), F.col("k").cast("string"), F.lit('"><c t="inlineStr"><is><t>INV-'), F.col("l_orderkey").cast("string"), F.lit("</t></is></c>"), cell(F.col("price")), cell(F.col("day"), ' s="1"'), F.lit("</row>"))
    head = '<row r="1"><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c></row>'
    sheets = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))).alias("rows"))
    return spread(sheets).select(F.concat(F.lit("upload-"), F.col("file").cast("string"), F.lit(".xlsx")).alias("path"), _zipped(F.concat(F.lit(head), F.concat_ws("", "rows.row"))).alias("content"))


@_query("""SELECT 'upload-' || (l_orderkey // 1000) || '.xlsx' AS path, 1 + row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, price, day) AS row_number, 'INV-' || l_orderkey AS invoice,
  CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(CAST(price AS DOUBLE) AS VARCHAR) END AS amount, CAST(day AS VARCHAR) || ' 00:00:00' AS date
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, CAST(l_shipdate AS DATE) AS day FROM lineitem)""", views_first=False)
def workbook_payments(s: SparkSession, d: str) -> DataFrame:
    rows = workbooks.with_headers(workbooks.workbook_rows(_books(s, d)), files.HEADERS)
    return rows.select("path", "row_number", "invoice", "amount", "date")
