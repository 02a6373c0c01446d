import zipfile

from duebook.sources import files, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(rows, sheets=1, active=0, shared=()):
    """Bytes of a workbook whose active sheet has the given rows of XML."""
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(sheets)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for k in range(sheets):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows if k == active else ""}</sheetData></worksheet>')
    return out.getvalue()


ROWS = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>Amount Paid</t></is></c><c r="D2" t="str"><v>payment date</v></c></row><row r="3"/>'
    '<row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5"><v>1200.0</v></c><c r="D5" s="1"><v>45292</v></c></row>'
    '<row r="6"><c r="B6" s="3"><f>1+1</f><v>2.5</v></c><c r="C6" t="b"><v>1</v></c><c r="D6" s="2"><v>45292.75</v></c><c r="AA6" t="e"><v>#N/A</v></c></row>'
)
SHARED = ("<t>Invoice No.</t>", "<r><t>INV</t></r><r><t>-1</t></r><rPh><t>x</t></rPh>")


def test_typed_cells():
    got = list(workbooks.rows_of(book(ROWS, 3, 1, SHARED)))
    assert got[0] == (2, ["Invoice No.", "Amount Paid", "", "payment date"])
    assert got[1] == (5, ["INV-1", "1200", "", "2024-01-01 00:00:00"])
    assert got[2][0] == 6 and got[2][1][:4] == ["", "2.5", "True", "2024-01-01 18:00:00"] and got[2][1][26] == "#N/A" and len(got) == 3


def test_files_and_headers(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book(ROWS, 1, 0, SHARED))
    (tmp_path / "b.xlsx").write_bytes(b"PK not a workbook")
    (tmp_path / "c.csv").write_text("x")
    rows = workbooks.read_workbooks(spark, str(tmp_path))
    assert sorted((r.path[-6:], r.row_number or 0, r.problem) for r in rows.collect()) == [("a.xlsx", 2, None), ("a.xlsx", 5, None), ("a.xlsx", 6, None), ("b.xlsx", 0, "unreadable workbook")]
    got = sorted((r.row_number, r.invoice, r.amount, r.date, r.gstin) for r in workbooks.with_headers(rows, files.HEADERS).collect())
    assert got == [(5, "INV-1", "1200", "2024-01-01 00:00:00", None), (6, "", "2.5", "2024-01-01 18:00:00", None)]
