import zipfile

from pyspark.sql import functions as F

from quireframe.sources import sheets

RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(parts, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="x" Target="worksheets/s{i}.xml"/>' for i in range(1, len(parts) + 1)) + "</Relationships>")
        for i, body in enumerate(parts.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{body}")


def row(r, *values):
    return f'<row r="{r}">' + "".join(f"<c><v>{v}</v></c>" for v in values) + "</row>"


def test_reading_stops_behind_the_last_row(spark, tmp_path):
    """Behind row 50 the sheet is no XML: whoever reads on fails. The second sheet is broken at once and filtered out."""
    workbook(tmp_path / "a.xlsx", {"Good": "".join(row(i, i, 2 * i) for i in range(1, 51)) + "<row r='51'><<<", "Bad": "<<<"})
    workbook(tmp_path / "b.xlsx", {"Good": "<row><c r='C1' t='inlineStr'><is><t>x</t></is></c><c><v>7</v><f>A1</f></c></row><row/></sheetData></worksheet>", "Bad": "<<<"})
    cells = sheets.raw_cells(spark, f"file://{tmp_path}").where("sheet_name = 'Good' AND row_index BETWEEN 9 AND 50 AND column_index > 1")
    assert cells.count() == 42 and cells.agg(F.sum("raw_value")).first()[0] == sum(2 * i for i in range(9, 51))
    b = sheets.raw_cells(spark, f"file://{tmp_path}/b.xlsx").where("sheet_id IN ('1')")
    assert sorted(tuple(r)[3:] for r in b.collect()) == [(1, 3, "inlineStr", "x", 0, None), (1, 4, "n", "7", 0, "A1")]


def test_a_large_sheet_is_not_held(tmp_path):
    """A million cells: the parser's tree holds a row at a time, and batches come while the rest is unread."""
    import tracemalloc

    workbook(tmp_path / "large.xlsx", {"S": "".join(row(i, *range(20)) for i in range(1, 50_001)) + "</sheetData></worksheet>"})
    reader = sheets.SheetReader(f"file://{tmp_path}")
    (part,) = reader.partitions()
    tracemalloc.start()
    rows = sum(b.num_rows for b in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_000_000 and peak < 12e6
