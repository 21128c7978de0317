"""Values by hand of the scalar functions, and operators on nulls, ties and empty tables."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from quireframe.functions import a1, chart, numbers, text, units
from quireframe.operators import axis, charts, documents, grid, lookup, merges, revisions
from quireframe.sources import names


def values(spark, kind, rows, *functions):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [tuple(r)[1:] if len(functions) > 1 else r[1] for r in df.select("i", *[f(F.col("x")).alias(f"f{k}") for k, f in enumerate(functions)]).orderBy("i").collect()]


def test_references(spark):
    assert values(spark, "int", [1, 26, 27, 702, 703, 16384, 0, None, 18279], a1.column_label) == ["A", "Z", "AA", "ZZ", "AAA", "XFD", "", None, None]
    assert values(spark, "string", ["A", "XFD", ""], a1.column_index) == [1, 16384, 0]
    assert [r and tuple(r) for r in values(spark, "string", ["C5", "c5", "$C$5", "5C", None], a1.parse_ref)] == [(5, 3), (5, 3), (1, 1), (1, 1), None]
    assert [r and tuple(r) for r in values(spark, "string", ["$A$1:D20", "B2", "", None], a1.parse_range)] == [(1, 1, 20, 4), (2, 2, 2, 2), None, None]


@pytest.mark.parametrize(
    ("x", "fmt", "shown"),
    [
        (1234.5, "#,##0.00", "1,234.50"), (-3.0, "$#,##0_);($#,##0)", "($3)"), (0.256, "0%", "26%"), (12345.678, "0.00E+00", "1.23E+4"), (1.5, "# ?/?", "1 1/2"), (0.5, "# ?/?", "1/2"),
        (2.0, "# ??/??", "2"), (0.1, "General", "0.1"), (100.0, "General", "100"), (-2.5, "0", "-3"), (45292.75, "yyyy-mm-dd hh:mm:ss", "2024-01-01 18:00:00"), (45292.0, "d-mmm-yy", "1-Jan-24"),
        (1.5, "[h]:mm:ss", "36:00:00"), (0.75, "h:mm AM/PM", "06:00 PM"), (None, "0.00", ""), (1e-5, "0.0E+00", "1.0E-5"), (5.0, '0 "days"', "5"),
    ],
)
def test_formats(spark, x, fmt, shown):
    assert values(spark, "double", [x], lambda c: numbers.display(c, fmt)) == [shown]


def test_exponents_of_halves(spark):
    """As C's printf: of the exact value of the double, which is just below a half for 12.35 and 2.675, and just above for 1.115."""
    x = [74050.0, 74150.0, 7765.0, -122.5, -123.5, 12.35, 2.675, 1.115, 0.0, -0.0, 9.995e22, 99950.0, 1e100, 1.5e-7, float("inf"), float("-inf"), None]
    x += [k * 10.0**e / 2 for k in range(1001, 3000, 52) for e in range(-9, 25, 3)]
    want = [v if v is None else re.sub(r"E([+-])0(\d)$", r"E\1\2", f"{v:.2E}") for v in x]
    assert values(spark, "double", x, lambda c: numbers.exponential(c, 2)) == want


def test_negative_zero(spark):
    """As the SQL of balances: the sign stays where digits are grouped and follow a point."""
    x = [-0.0, 0.0, -0.25, None]
    assert values(spark, "double", x, lambda c: numbers.display(c, "$#,##0.00_);($#,##0.00)")) == ["$-0.00", "$0.00", "($0.25)", ""]
    assert values(spark, "double", x, lambda c: numbers.display(c, "#,##0")) == ["0", "0", "-0", ""]
    assert values(spark, "double", x, lambda c: numbers.display(c, "0.00")) == ["0.00", "0.00", "-0.25", ""]


def test_dates(spark):
    day = lambda *d: datetime.datetime(*d)
    assert values(spark, "double", [1.0, 59.0, 60.0, 61.0, 45292.0], numbers.serial_timestamp) == [day(1900, 1, 1), day(1900, 2, 28), day(1900, 2, 28), day(1900, 3, 1), day(2024, 1, 1)]
    assert values(spark, "double", [0.0], lambda c: numbers.serial_timestamp(c, True)) == [day(1904, 1, 1)]
    assert values(spark, "double", [45292.0], lambda c: numbers.chart_date(c, "yyyy/m/d")) == ["2024/1/1"]


def test_texts(spark):
    assert values(spark, "int", [4, 1994, 0], text.roman) == ["IV", "MCMXCIV", "I"]
    assert values(spark, "int", [10, 11, 20, 105, 110, 1010, 10001], text.chinese) == ["十", "十一", "二十", "一百零五", "一百一十", "一千零一十", "10001"]
    assert values(spark, "string", ["ab中", "", None], lambda c: F.round(text.weighted_length(c), 4)) == [2.1, 0.0, None]
    assert values(spark, "string", ["a\x07b\x0dc\x02  d "], text.normalize) == ["a|b\nc d"]
    assert values(spark, "string", ["a😀", "ab"], text.utf16_length) == [3, 2]
    assert values(spark, "string", ["Ã¼ber", "plain", "naïve", None, "锟é", "锟 a", "é", "\U0001f600 Ã©"], text.mojibake) == ["über", "plain", "naïve", None, "锟é", "\x1f a", "é", "= é"]
    assert values(spark, "string", ["1. a", "(b) c", "（三） d", "- e", "• f", "x", "1234. g"], text.list_kind) == ["ordered"] * 3 + ["bulleted"] * 2 + [None] * 2
    assert values(spark, "string", ["a|b", "a|", "| |x| y"], text.is_table_line) == [True, False, True]
    assert values(spark, "string", ["<p>a<script>x</script>b &amp;</p>"], text.strip_html) == ["a b &amp;"]
    assert values(spark, "string", [r"{\rtf1\b Bold\par next}"], text.strip_rtf) == ["Bold\nnext"]
    assert values(spark, "string", ["f.XLSX", "f.wps", "f.txt"], names.kind_of) == ["xlsx", "doc", None]
    assert values(spark, "string", ["attachment; filename=a.doc; filename*=UTF-8''%C3%BC.doc", 'inline; filename="b c.xls"', "inline"], names.header_name) == ["ü.doc", "b c.xls", None]
    assert values(spark, "string", ["https://h/p/a.docx?x=/y#z"], names.file_name) == ["a.docx"]


def test_units_and_charts(spark):
    assert values(spark, "double", [8.43, 0.0, 10.0, None], units.column_width_px) == [59, 64, 70, 64]
    assert values(spark, "double", [15.0, 0.0, 0.1], units.row_height_px) == [20, 20, 1]
    assert values(spark, "double", [-0.5, 0.5, 0.0, None], lambda t: units.tint(F.lit("#808080"), t)) == ["#404040", "#c0c0c0", "#808080", "#808080"]
    assert values(spark, "double", [0.0, 1.5, 3.0, 7.0, 120.0, None], chart.nice_max) == [1, 2, 5, 10, 200, 1]
    assert values(spark, "int", [0, 120, -30], chart.pie_start) == [90, 330, 120]
    assert values(spark, "double", [0.0, 4.0, 100.0], chart.bubble_size) == [6, 12, 42]


def test_axis(spark):
    rows = spark.createDataFrame([("s", "row", 2, 5.0, True, 20.0), ("s", "row", 3, 40.0, False, 20.0)], "sheet_id string, axis string, idx int, size double, hidden boolean, default_size double")
    sized = axis.offsets(rows)
    assert [(r.start, r.end) for r in sized.orderBy("idx").collect()] == [(20, 20), (20, 60)]
    points = spark.createDataFrame([("s", "row", x, 20.0, 5) for x in (-4.0, 0.0, 20.0, 59.0, 60.0, 79.0, 1e9)], "sheet_id string, axis string, x double, default_size double, count long")
    assert [r.idx for r in axis.find(sized, points).orderBy("x").collect()] == [1, 1, 3, 3, 4, 4, 5]


def test_outline_and_numbers(spark):
    items = spark.createDataFrame([("d", i, level, f"h{i}") for i, level in enumerate([0, 2, 1, 1, 0])], "doc string, ord int, level int, id string")
    assert [r.parent_id for r in documents.outline(items, "doc").orderBy("ord").collect()] == [None, "h0", "h0", "h0", None]
    assert [r.counters for r in documents.numbering(items, "doc").orderBy("ord").collect()] == [[1], [1, 1, 1], [1, 1], [1, 2], [2]]
    assert documents.outline(items.limit(0), "doc").count() == documents.numbering(items.limit(0), "doc").count() == 0


def test_batches(spark):
    df = spark.createDataFrame([([3, 3, 3, 9, 1],), ([],), (None,)], "s array<int>")
    assert [r[0] for r in df.select(documents.greedy_batches(F.col("s"), 6)).collect()] == [[0, 0, 1, 2, 3], [], []]


def test_documents_with_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n"), (None, "a\r\rb")], "doc_id int, text string")
    assert [tuple(r) for r in documents.paragraphs(docs, "doc_id", "text").orderBy("ord").collect()] == [(None, 0, "a"), (None, 1, "b")]
    assert sorted(r.paragraphs for r in documents.statistics(docs, "doc_id", "text").collect()) == [0, 0, 0, 2]
    assert documents.pages(docs, "doc_id", "text").count() == documents.chunks(docs, "doc_id", "text").count() == 2


def test_merges(spark):
    ends = "sheet_id string, merge_id int, start_row int, start_column int, end_row int, end_column int"
    m = spark.createDataFrame([("s", 1, 1, 1, 2, 2), ("s", 2, 2, 2, 3, 3), ("s", 3, 3, 3, 4, 4), ("s", 4, 199, 49, 405, 120), ("t", 5, 1, 1, 9, 9)], ends)
    r = spark.createDataFrame([("s", 1, 1, 1, 1, 1), ("s", 2, 300, 60, 300, 60), ("s", 3, 9, 9, 9, 9)], ends.replace("merge_id", "range_id"))
    assert sorted((x.range_id, x.start_row, x.end_column) for x in merges.expand(r, m).collect()) == [(1, 1, 4), (2, 199, 120), (3, 9, 9)]
    assert sorted(x.merge_id for x in merges.drop_overlapping(m).collect()) == [1, 3, 4, 5]
    assert merges.overlapping(r, m).where("range_id = 2").count() == 1
    cells = spark.createDataFrame([("s", 250, 70), ("s", 2, 2), ("u", 1, 1)], "sheet_id string, row_index int, column_index int")
    assert sorted(x.merge_id for x in merges.containing(cells, m).collect()) == [1, 2, 4]
    assert merges.expand(r.limit(0), m).count() == 0


def test_grid(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 3, "y")], "s string, n int, t string")
    cells = grid.to_cells(df, "s", ["n"], ["n", "t"])
    assert sorted((r.sheet_id or "", r.row_index, r.column_index, r.raw_value or "") for r in cells.collect()) == [("", 2, 1, "3"), ("", 2, 2, "y"), ("a", 2, 1, "1"), ("a", 2, 2, "x"), ("a", 3, 1, "2"), ("a", 3, 2, "")]
    assert {(r.sheet_id, r.rows, r.declared_rows) for r in grid.used_range(cells, F.col("raw_value").isNotNull() & (F.col("column_index") == 2)).collect()} == {("a", 2, 3), (None, 2, 2)}
    first, last = grid.clamp_range(F.lit(-3.5), F.lit(99.0), F.lit(10))
    assert tuple(spark.range(1).select(first, last).first()) == (1, 10)


def test_lookups(spark):
    cells = spark.createDataFrame([("f", 0), ("f", 7), ("f", None)], "file string, i int")
    entries = spark.createDataFrame([("f", 0, "zero")], "file string, index int, value string")
    assert sorted(r.value for r in lookup.resolve(cells, entries, ["file"], "i").collect()) == ["", "", "zero"]
    with pytest.raises(Exception, match="no entry 7"):
        lookup.resolve(cells, entries, ["file"], "i", missing=None).collect()
    runs = spark.createDataFrame([("k", 0, 3, "a"), ("k", 1, 0, "none"), ("k", 2, 2, "b")], "key string, ord int, count int, style string")
    points = spark.createDataFrame([("k", p) for p in (0, 2, 3, 99)] + [("other", 1)], "key string, position int")
    assert [r.style for r in lookup.style_at(points, runs, "key", "style").orderBy("key", "position").collect()] == ["a", "a", "b", "b", None]


def test_vertical_spans(spark):
    cells = spark.createDataFrame([("g", i, k) for i, k in enumerate("crcc.c")], "g string, row int, kind string")
    found = documents.vertical_spans(cells, ["g"], "row", F.col("kind") == "r", F.col("kind") == "c")
    assert sorted((r.row, r.row_span) for r in found.collect()) == [(0, 1), (1, 3), (4, 1), (5, 1)]


def test_pies_and_series(spark):
    points = spark.createDataFrame([("c", i, f"p{i}", 1.0) for i in range(7)], "chart string, i int, label string, v double")
    got = charts.of_pie(points, ["chart"], F.col("i"), "label", "v").collect()
    assert sorted((r.part, r.category) for r in got)[:5] == [("main", "other"), ("main", "p0"), ("main", "p1"), ("main", "p2"), ("main", "p3")] and len(got) == 8
    one = charts.of_pie(points.limit(1), ["chart"], F.col("i"), "label", "v").collect()
    assert [(r.part, r.category) for r in one] == [("main", "p0")]
    series = spark.createDataFrame([("s", 3, 1.0, 0), ("s", 3, 2.0, 1), ("s", 0, None, 2)], "series string, idx int, value double, ord int")
    assert [(r.idx, r.value) for r in charts.matrix(series, ["series"]).orderBy("idx").collect()] == [(0, None), (1, None), (2, None), (3, 2.0)]


def test_upsert_knows_stale_rows(spark):
    now = spark.createDataFrame([("a", 2, "old"), ("b", 5, "b5"), (None, 1, "n")], "key string, revision int, v string")
    new = spark.createDataFrame([("a", 3, "new"), ("b", 5, "again"), ("c", 1, "c")], "key string, revision int, v string")
    rows = lambda **k: sorted((r.key or "", r.v) for r in revisions.upsert(now, new, ["key"], **k).collect())
    assert rows() == [("", "n"), ("a", "new"), ("b", "b5"), ("c", "c")] and rows(strict=False)[2] == ("b", "again")
    with pytest.raises(Exception, match="not newer"):
        rows(on_stale="error")


def test_hsl(spark):
    import colorsys

    colours = ["#ff0000", "#12ab34", "#3366ff", "#fffffe", "#000000", "#7f6040"]
    got = values(spark, "string", colours, lambda c: units.shift_hsl(c, F.lit(0.8), F.lit(0.1), F.lit(0.5)))
    for base, shown in zip(colours, got, strict=True):
        h, light, s = colorsys.rgb_to_hls(*[int(base[i : i + 2], 16) / 255 for i in (1, 3, 5)])
        want = colorsys.hls_to_rgb(h, min(1, light * 0.8 + 0.1), s * 0.5)
        assert all(abs(int(shown[i : i + 2], 16) - 255 * w) <= 0.51 for i, w in zip((1, 3, 5), want, strict=True))


def test_decoding_by_score(spark):
    """The first candidate with the highest score; bytes that a code page leaves out are kept."""
    raws = {"plain": b"plain", "han": "你好".encode("gbk"), "out": b"a\x81b", "bad": b"\xff\xff", "none": None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in raws.items()], "k string, raw binary")
    got = {r.k: r.t for r in df.select("k", text.best_decoded(F.col("raw")).alias("t")).collect()}
    assert (got["plain"], got["han"], got["bad"], got["none"]) == ("plain", "你好", "ÿÿ", None) and got["out"] in ("a\x81b", "a乥", "a�b")
    pages = {r.k: (r.d.text, r.d.warning) for r in df.select("k", text.decode_page(F.col("raw"), F.lit(1)).alias("d")).collect()}
    assert pages["out"] == ("a\x81b", "code page 1 is read as 1252")


def test_fields_in_east_asian_languages(spark):
    from quireframe.functions.fields import slide_field

    rows = spark.createDataFrame([("ja-JP", "datetime2"), ("ko", "datetime2"), ("ko-KR", "datetime12"), ("ja", "datetime13"), ("ko", "datetime1"), ("fr-FR", "datetime4"), (None, "datetime10")], "l string, k string")
    at = F.lit("2024-03-05 14:07:09").cast("timestamp")
    found = rows.select(slide_field(F.col("k"), F.lit("x"), F.lit(1), at, F.col("l")).alias("t"))
    assert [r.t for r in found.collect()] == ["2024年3月05日火曜日", "2024년 3월 05일 화요일", "오후 02:07", "午後02:07:09", "2024. 03. 05.", "March 05, 2024", "14:07"]
