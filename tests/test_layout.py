import math
import re

from pyspark.sql import functions as F

from quireframe.operators import axis, layout, slides
from quireframe.plans.more import measuring_batches, reading_heights


def plain_batches(sizes, blocks=100, rows=200):
    """The batch in which each block begins, by dealing out single table rows."""
    out, batch, held, used = [], 0, 0, 0
    for size in sizes:
        if held >= blocks or (size and used >= rows):
            batch, held, used = batch + 1, 0, 0
        out.append(batch)
        held += 1
        for k in range(size):
            used += 1
            if used == rows and k + 1 < size:
                batch, held, used = batch + 1, 1, 0
    return out


def test_batches(spark, sf):
    got = {}
    for r in measuring_batches(spark, sf).collect():
        got.setdefault(r.user_id, {})[r.event_id] = r.batch
    for own in got.values():
        ids = sorted(own)
        assert [own[i] for i in ids] == plain_batches([i % 90 if i % 5 == 0 else 0 for i in ids])
    df = spark.createDataFrame([([0] * 101,), ([450, 0, 3],), ([],), (None,), ([200, 1],)], "s array<int>")
    assert [r[0] for r in df.select(layout.measuring_batches(F.col("s"))).collect()] == [[0] * 100 + [1], [0, 2, 2], [], [], [0, 1]]


def plain_height(text, font=12.0, available=395 * 0.92):
    """By pieces that are words, spaces, or the characters of a word wider than a line, the first of which begins a line."""
    lines = 0
    for line in re.split(r"\r?\n", re.sub(r"(?:\r?\n)+$", "", text)):
        pieces, used, lines = [], 0.0, lines + 1
        for token in re.findall(r"\s+|\S+", line):
            widths = [layout.char_width(c) * font for c in token]
            pieces += [(sum(widths), False)] if sum(widths) <= available else [(w, k == 0) for k, w in enumerate(widths)]
        for width, first in pieces:
            if used > 0 and (first or used + width > available):
                lines, used = lines + 1, 0.0
            used += width
    return math.ceil(max(1, lines) * font * 1.2 + 1)


def test_reading_heights_by_pieces(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        if r.text is not None:
            want[r.conv_id] = max(want.get(r.conv_id, 0), plain_height(r.text))
    got = {r.conv_id: r.height for r in reading_heights(spark, sf).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want


def test_wrapping(spark, sf):
    assert layout.count_lines("aaaa bbbb", 10, 40) == 2 and layout.count_lines("a" * 20, 10, 45) == 3 and layout.count_lines("", 10, 45) == 1 and layout.count_lines("a\n\nb", 10, 45) == 3
    df = spark.createDataFrame([("x\r\n\r\n",), (None,), ("",), ("中中中",)], "t string")
    assert [r[0] for r in df.select(layout.reading_height(F.col("t"), F.lit(10.0), F.lit(30.0))).collect()] == [13, None, 13, 25]
    assert all(r.height >= 16 for r in reading_heights(spark, sf).collect())


def test_image_rows_and_pages(spark):
    df = spark.createDataFrame([([100.0, 200.0, 300.0, 310.0, 100.0, 0.0, None],), (None,)], "w array<double>")
    assert [r[0] for r in df.select(layout.image_rows(F.col("w"))).collect()] == [[0, 0, 1, 2, 3, 4, 5], []]
    df = spark.createDataFrame([([500.0, 520.0],), ([500.0, 521.0, 380.0, 1.0],), ([],), (None,)], "h array<double>")
    assert [r[0] for r in df.select(layout.measured_pages(F.col("h"), 900.0)).collect()] == [[0, 0], [0, 1, 1, 2], [], []]


def test_anchors_without_overrides(spark):
    sized = axis.offsets(spark.createDataFrame([("s", "row", 3, 7.0, False, 20.0)], "sheet_id string, axis string, idx int, size double, hidden boolean, default_size double"))
    points = spark.createDataFrame([(s, "row", i, 20.0, "x") for s in ("s", "t") for i in (1, 3, 4, 6)], "sheet_id string, axis string, idx int, default_size double, name string")
    got = sorted((r.sheet_id, r.idx, r.start, r.name) for r in axis.offset_at(sized, points).collect())
    assert got == [("s", 1, 0, "x"), ("s", 3, 40, "x"), ("s", 4, 47, "x"), ("s", 6, 87, "x"), ("t", 1, 0, "x"), ("t", 3, 40, "x"), ("t", 4, 60, "x"), ("t", 6, 100, "x")]


def test_table_styles(spark):
    names = "whole band1_row band2_row band1_column band2_column first_row last_row first_column last_column".split()
    style = {n: F.lit(n) for n in names}
    flags = dict.fromkeys(("first_row", "last_row", "first_column", "last_column", "band_rows", "band_columns"), F.lit(True))
    cells = spark.createDataFrame([(r, c) for r in range(3) for c in range(4)], "r int, c int")
    got = {(x.r, x.c): x.s for x in cells.withColumn("s", slides.table_style(F.col("r"), F.col("c"), F.lit(3), F.lit(4), flags, style)).collect()}
    assert (got[0, 1], got[2, 1], got[1, 0], got[1, 3], got[0, 0], got[1, 1], got[1, 2]) == ("first_row", "last_row", "first_column", "last_column", "first_column", "band1_column", "band2_column")
    plain = slides.table_style(F.col("r"), F.col("c"), F.lit(3), F.lit(4), dict.fromkeys(flags, F.lit(False)), style)
    assert {x.s for x in cells.select(plain.alias("s")).collect()} == {"whole"}
