"""Folds of layout over the arrays of one row: rows of images, measuring batches, pages of measured blocks, wrapped lines."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from quireframe.functions.text import CHAR_WIDTHS

INTS = ArrayType(IntegerType())


@pandas_udf(INTS)
def _image_rows(widths: pd.Series, content: pd.Series) -> pd.Series:
    def one(row, width):
        out, at, n = [], 0, 0
        row = [] if row is None else [0.0 if w is None else w for w in row]
        most = min(300.0, width * 0.55)
        while at < len(row):
            pair = at + 1 < len(row) and 0 < row[at] <= most and 0 < row[at + 1] <= most and row[at] + row[at + 1] + 6 <= width
            out += [n] * (2 if pair else 1)
            at, n = at + (2 if pair else 1), n + 1
        return out

    return pd.Series([one(r, w) for r, w in zip(widths, content, strict=True)])


def image_rows(widths: Column, content_width: float = 554.0) -> Column:
    """array<int>: the row (from 0) of each image: two small ones in sequence share a row if they fit with a gap of 6 px."""
    return _image_rows(widths.cast("array<double>"), F.lit(content_width))


@pandas_udf(INTS)
def _measure(rows: pd.Series, blocks: pd.Series, most_rows: pd.Series) -> pd.Series:
    def one(sizes, limit, most):
        out, batch, held, used = [], 0, 0, 0
        for size in () if sizes is None else sizes:
            if held >= limit or size and used >= most:
                batch, held, used = batch + 1, 0, 0
            out.append(batch)
            held, used = held + 1, used + size
            while used > most:  # a long table goes on in batches of its own
                batch, held, used = batch + 1, 1, used - most
        return out

    return pd.Series([one(s, b, m) for s, b, m in zip(rows, blocks, most_rows, strict=True)])


def measuring_batches(table_rows: Column, blocks: int = 100, rows: int = 200) -> Column:
    """array<int>: the batch (from 0) in which each block begins: at most so many blocks and table rows in one.

    table_rows has the rows of each block that is a table, 0 for others. A table that has more rows than are left is
    cut there and goes on in the next batch.
    """
    return _measure(table_rows.cast("array<int>"), F.lit(blocks), F.lit(rows))


@pandas_udf(INTS)
def _fit(heights: pd.Series, content: pd.Series) -> pd.Series:
    def one(row, height):
        row = [] if row is None else list(row)
        if sum(row) <= height + 120:
            return [0] * len(row)
        out, page, used = [], 0, 0.0
        for h in row:
            if used > 0 and used + h > height + 1:
                page, used = page + 1, 0.0
            used += h
            out.append(page)
        return out

    return pd.Series([one(r, h) for r, h in zip(heights, content, strict=True)])


def measured_pages(heights: Column, content_height: float) -> Column:
    """array<int>: the page (from 0) of each measured block: all on one if they exceed it by at most 120 px, else filled to 1 px over."""
    return _fit(heights.cast("array<double>"), F.lit(content_height))


_WIDTHS = [(re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), p)), w) for p, w in CHAR_WIDTHS]


@cache
def char_width(c: str) -> float:
    """Width of a character as a share of the font size."""
    return next((w for p, w in _WIDTHS if p.match(c)), 0.5)


def count_lines(text: str, font: float, available: float) -> int:
    """Lines that a text takes when it is wrapped between words, and inside words that are wider than a line."""
    lines = 0
    for source in re.split(r"\r?\n", text):
        lines, used = lines + 1, 0.0
        for token in re.findall(r"\s+|\S+", source):
            widths = [char_width(c) * font for c in token]
            if used > 0 and used + sum(widths) > available:
                lines, used = lines + 1, 0.0
            if sum(widths) <= available:
                used += sum(widths)
                continue
            for w in widths:
                if used > 0 and used + w > available:
                    lines, used = lines + 1, 0.0
                used += w
    return max(1, lines)


@pandas_udf(IntegerType())
def _lines(text: pd.Series, font: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else count_lines(t, f, w) for t, f, w in zip(text, font, width, strict=True)], dtype="Int32")


def wrapped_lines(text: Column, font: Column, width: Column) -> Column:
    return _lines(text, font.cast("double"), width.cast("double"))


def reading_height(text: Column, font: Column, width: Column) -> Column:
    """px that a cell's text needs when it is shown whole: line ends after it do not count; an inset and a margin are taken off the width."""
    lines = wrapped_lines(F.regexp_replace(text, r"(?:\r?\n)+$", ""), font, F.greatest(F.lit(1.0), (width - 5) * 0.92))
    return F.ceil(lines * font * 1.2 + 1).cast("int")
