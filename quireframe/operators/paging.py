"""Pages of documents: a fold over blocks that splits tables and keeps what belongs together, and pages of measured blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# Fixed values, in px: least rest of a page that a table begins in, gap between rows of images, margin of a group of
# images, part of the width (and most) that an image beside another may have, gap between two; longest caption.
TABLE_REST, IMAGE_GAP, IMAGE_MARGIN, PAIR_SHARE, PAIR_MOST, PAIR_GAP, CAPTION = 80.0, 12.0, 10.0, 0.55, 300.0, 6.0, 40
TEXTS = ("paragraph", "heading", "title")
BLOCK = "kind string, break_before boolean, solid int, height double, leading double, lead double, after double, width double, align string, rows array<double>"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]
PIECE = "piece int, page int, first_row int, last_row int, height double"


class Block(NamedTuple):
    """A block to be put on pages; the heights of all but images have the spacing before them (lead) in them.

    kind: paragraph, heading, title, image, table or drawing (which takes no height); solid: characters that are no
    space; leading: what of it has to stay with a heading before it; rows: heights of a table's rows, whose own height
    is not used; after: spacing behind a table; width and height of an image are its own, at most the page's width
    counts (0: unknown).
    """

    ord: int
    kind: str
    break_before: bool = False
    solid: int = 0
    height: float = 0.0
    leading: float = 0.0
    lead: float = 0.0
    after: float = 0.0
    width: float = 0.0
    align: str | None = None
    rows: tuple[float, ...] = ()

    def whole(self, content_width: float, beside: int = 1) -> float:
        if self.kind == "table":
            return self.lead + sum(self.rows) + self.after
        if self.kind != "image":
            return self.height
        if not (self.width and self.height):
            return min(240.0, 0.55 * content_width)
        shown = min(self.width, (content_width - PAIR_GAP) / beside if beside > 1 else content_width)
        return self.height * shown / self.width

    def beginning(self, content_width: float) -> float:
        if self.kind == "table":
            return self.lead + sum(self.rows[:2]) + self.after
        return self.whole(content_width) if self.kind == "image" else self.leading

    def heads(self) -> bool:
        """Does it stay with what follows?"""
        return self.kind == "heading" and not self.break_before

    def without_lead(self) -> Block:
        less = 0.0 if self.kind in ("table", "image") else self.lead
        return self._replace(height=self.height - less, leading=self.leading - less, lead=0.0)


Piece = tuple[int, int, int, int | None, int | None, float]


@dataclass
class Pager:
    """Puts blocks on pages as they come. What hangs on blocks that are not there yet waits in ``held``: headings at
    the end, images at the end, and a short text at the end, which may be the caption of a table."""

    content: float
    width: float
    page: int = 0
    used: float = 0.0
    filled: bool = False
    title: bool = False
    picture: bool = False
    held: list[Block] = field(default_factory=list)

    def feed(self, blocks: list[Block], complete: bool = False) -> Iterator[Piece]:
        """The pieces (ord, piece, page, first row, last row, height) that are settled once these blocks are there."""
        self.held += blocks
        at = 0
        while at < len(self.held) and (complete or self._settled(at)):
            at = yield from self._place(at)
        del self.held[:at]

    def _run(self, at: int) -> int:
        """Behind the headings, or the images of one alignment, that begin at a place."""
        first, end = self.held[at], at + 1
        while end < len(self.held):
            b = self.held[end]
            if not (b.heads() if first.kind == "heading" else b.kind == "image" and not b.break_before and b.align == first.align):
                break
            end += 1
        return end

    def _settled(self, at: int) -> bool:
        b = self.held[at]
        if b.break_before or b.kind in ("table", "drawing"):
            return True
        if b.kind == "heading" or b.kind == "image":
            return self._run(at) < len(self.held)
        return b.solid > CAPTION or at + 1 < len(self.held)

    def _turn(self) -> None:
        if self.filled:
            self.page += 1
        self.used, self.filled, self.title, self.picture = 0.0, False, False, False

    def _over(self, height: float) -> bool:
        return self.filled and self.used + height > self.content

    def _put(self, block: Block, piece: int, height: float, first: int | None = None, last: int | None = None) -> Piece:
        if self._over(height):
            self._turn()
        self.filled, self.used = True, self.used + height
        self.title |= block.kind == "title"
        self.picture |= block.kind == "image"
        return block.ord, piece, self.page, first, last, height

    def _kept(self, at: int, b: Block) -> float:
        """What has to fit on the page together with the block at a place; 0 where nothing does."""
        after = self.held[at + 1] if at + 1 < len(self.held) else None
        if b.kind in TEXTS and b.solid <= CAPTION and after is not None and after.kind == "table":
            table = after.whole(self.width)
            return b.whole(self.width) + (table if table <= self.content else after.beginning(self.width))
        if b.heads() and (end := self._run(at)) < len(self.held):
            return sum(h.whole(self.width) for h in self.held[at:end]) + self.held[end].beginning(self.width)
        return 0.0

    def _place(self, at: int) -> Iterator[Piece]:
        """Settles the block at a place (and the images after it); returns the place behind."""
        b = self.held[at]
        if b.kind != "drawing" and b.lead > 0 and self.filled and b.lead >= self.content - self.used:
            self._turn()
            b = b.without_lead()
        if b.break_before and b.kind != "table":  # a break is an empty paragraph: nothing of it is shown
            self._turn()
            if b.kind != "drawing":
                return at + 1
        if b.kind == "drawing":
            yield self._put(b, 0, 0.0)
            return at + 1
        if (kept := self._kept(at, b)) and self._over(kept):
            self._turn()
        if b.kind == "table":
            if self.title and self.picture:  # a cover ends before a table
                self._turn()
            if b.rows and (b.whole(self.width) > self.content or self._over(b.whole(self.width))):
                yield from self._parts(b)
            else:
                yield self._put(b, 0, b.whole(self.width), *((0, len(b.rows) - 1) if b.rows else ()))
            return at + 1
        if b.kind == "image":
            end = self._run(at)
            yield from self._images([b, *self.held[at + 1 : end]])
            return end
        yield self._put(b, 0, b.whole(self.width))
        return at + 1

    def _parts(self, b: Block) -> Iterator[Piece]:
        at, piece = 0, 0
        while at < len(b.rows):
            if self.filled and self.content - self.used < TABLE_REST:
                self._turn()
            lead = b.lead if piece == 0 else 0.0
            room = max(0.0, self.content - self.used - lead)
            end, height = at + 1, b.rows[at]
            while end < len(b.rows) and height + b.rows[end] <= room:
                height += b.rows[end]
                end += 1
            after = min(b.after, max(0.0, room - height)) if end == len(b.rows) else 0.0
            yield self._put(b, piece, lead + height + after, at, end - 1)
            if end < len(b.rows):
                self._turn()
            at, piece = end, piece + 1

    def _images(self, images: list[Block]) -> Iterator[Piece]:
        """Rows of one or two images, in groups as high as the page's rest; each image is a piece, its number the row's."""
        most = min(PAIR_MOST, PAIR_SHARE * self.width)
        small = [0 < b.width <= most for b in images]
        rows, at = [], 0
        while at < len(images):
            pair = at + 1 < len(images) and small[at] and small[at + 1] and images[at].width + images[at + 1].width + PAIR_GAP <= self.width
            rows.append(images[at : at + 1 + pair])
            at += 1 + pair
        group: list[tuple[int, list[Block], float]] = []
        total = IMAGE_MARGIN
        for number, row in enumerate(rows):
            height = max(b.whole(self.width, len(row)) for b in row) + IMAGE_GAP * bool(group)
            if group and self.used + total + height > self.content:
                yield from self._group(group, total)
                group, total = [], IMAGE_MARGIN
            group.append((number, row, height))
            total += height
        yield from self._group(group, total)

    def _group(self, group: list[tuple[int, list[Block], float]], total: float) -> Iterator[Piece]:
        if self._over(total):
            self._turn()
        self.filled, self.used, self.picture = True, self.used + total, True
        for number, row, height in group:
            for b in row:
                yield b.ord, number, self.page, None, None, height


def block_of(row: dict[str, Any]) -> Block:
    """A block from a row's values; nulls are the defaults, null heights of rows are 0."""
    given = {k: row[k] for k in ("ord", *NAMES) if row.get(k) is not None}
    if "rows" in given:
        given["rows"] = tuple(0.0 if h is None else float(h) for h in given["rows"])
    return Block(**{"kind": "paragraph", **given})


def paged(blocks: DataFrame, key: str, content: float = 931.0, width: float = 554.0) -> DataFrame:
    """(key, ord, piece, page, first_row, last_row, height): where the blocks (key, ord and BLOCK's columns) come.

    A table that does not fit goes on over pages in parts of whole rows (piece counts them), an image is a piece of its
    group. A heading stays with the next block's beginning, a short text with the table after it; spacing that would
    fill the rest of a page is dropped. A block that is a page break has no row. Each document is sorted and read as a
    stream in one task that holds what is not settled: headings and images in a row.
    """
    names = [x.split()[0] for x in PIECE.split(", ")]
    own = blocks.select(key, F.col("ord").cast("long").alias("ord"), *NAMES)
    kinds = [to_arrow_type(own.schema[key].dataType), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[key, "ord", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pager, started = None, None, False
        for batch in batches:
            out: list[tuple] = []
            rows = (dict(zip(batch.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for k, own in groupby(rows, key=itemgetter(key)):
                if not started or k != now:
                    out += [(now, *p) for p in pager.feed([], True)] if started else []
                    now, pager, started = k, Pager(content, width), True
                out += [(k, *p) for p in pager.feed([block_of(r) for r in own])]
            yield told(out)
        if started:
            yield told([(now, *p) for p in pager.feed([], True)])

    return own.repartition(key).sortWithinPartitions(key, "ord").mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, ord long, {PIECE}")


def covers(pieces: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, page, cover): is a page a cover, with a title and an image and no table?"""
    kinds = pieces.select(key, "ord", "page").distinct().join(blocks.select(key, F.col("ord").cast("long").alias("ord"), "kind"), [key, "ord"])
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    return kinds.groupBy(key, "page").agg((has("title") & has("image") & ~has("table")).alias("cover"))


def measured(blocks: DataFrame, keys: list[str], content: Column, slack: float = 120.0, tolerance: float = 1.0) -> DataFrame:
    """(keys, ord, piece, page, first_line, last_line, height): measured blocks of a source page on pages.

    blocks has keys, ord, kind ('paragraph', 'table' or others), height, parts: a splittable paragraph's lines or a
    table's rows as heights (null: not to be split), and original_rows of a table that is a part (null: its own). A
    source page whose blocks are at most ``slack`` higher than the content stays one page. Else a block begins a new
    page where it would end more than ``tolerance`` below; a paragraph is split at ends of lines and a table that is
    higher than 0.6 of the content, or is a part, between rows.
    """
    w = Window.partitionBy(*keys)
    names = [*keys, "ord", "kind", "height", "parts", "original_rows"]
    own = blocks.withColumns({"content": content.cast("double"), "total": F.sum("height").over(w)}).select(*names, "content", "total")
    schema = ", ".join([*(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys), "ord long, piece int, page int, first_line int, last_line int, height double"])

    def page_of(rows: list[dict]) -> Iterator[tuple]:
        most = rows[0]["content"] + tolerance
        page, used, filled = 0, 0.0, False
        for r in rows:
            parts = list(enumerate(r["parts"] or []))
            if r["total"] <= rows[0]["content"] + slack:
                yield r["ord"], 0, 0, None, None, r["height"]
                continue
            lines = r["kind"] == "paragraph" and len(parts) > 1 and used + r["height"] > most
            cut = r["kind"] == "table" and parts and (r["height"] > 0.6 * rows[0]["content"] or (r["original_rows"] or 0) > len(parts))
            if not (lines or cut):
                if filled and used + r["height"] > most:
                    page, used = page + 1, 0.0
                filled, used = True, used + r["height"]
                yield r["ord"], 0, page, None, None, r["height"]
                continue
            piece, first, height = 0, 0, 0.0
            for i, h in parts:
                # a paragraph's first line may stand alone on what is left of a page only if it fits; a table's first row turns it when it is put
                if (i > first or lines and filled) and used + height + h > most:
                    if i > first:
                        if filled and used + height > most:
                            page, used = page + 1, 0.0
                        yield r["ord"], piece, page, first, i - 1, height
                        piece, first, height = piece + 1, i, 0.0
                    page, used, filled = page + 1, 0.0, False
                height += h
            if filled and used + height > most:
                page, used = page + 1, 0.0
            filled, used = True, used + height
            yield r["ord"], piece, page, first, len(parts) - 1, height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in whole_groups(batches, keys):
            out = [(*key, *p) for p in page_of(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

    fields = StructType.fromDDL(schema).fields
    kinds, columns = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]
    return own.withColumn("ord", F.col("ord").cast("long")).repartition(*keys).sortWithinPartitions(*keys, "ord").mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """(key, rows) of sorted batches; a group may lie in several."""
    held: list[dict] = []
    last: tuple = ()
    for batch in batches:
        rows = (dict(zip(batch.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, own in groupby(rows, key=itemgetter(*keys)):
            key = key if isinstance(key, tuple) else (key,)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held += own
    if held:
        yield last, held


def pages_near(pieces: DataFrame, asked: DataFrame, key: str, around: int = 1) -> DataFrame:
    """(key, ord, page, first, last) of asked blocks (key, ord): the page on which a block begins, and so many around it.

    A block without a page (a break) has no row.
    """
    own = pieces.groupBy(key, "ord").agg(F.min("page").alias("page"))
    most = pieces.groupBy(key).agg(F.max("page").alias("_most"))
    found = asked.join(own, [key, "ord"]).join(most, key)
    return found.select(key, "ord", "page", F.greatest(F.lit(0), F.col("page") - around).alias("first"), F.least("_most", F.col("page") + around).alias("last"))
