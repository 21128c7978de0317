"""Documents as blocks: paragraphs, statistics, outlines, numbering, byte batches and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from quireframe.functions import text as T

CHUNK_BYTES = 256 << 10
LEVELS = range(9)


def lines_of(text: Column) -> Column:
    """array<string>: the paragraphs of a text that are not empty after cleaning."""
    return F.filter(F.transform(F.split(T.normalize(F.coalesce(text, F.lit(""))), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, text): the paragraphs that are not empty, numbered from 0. Nothing is shuffled."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("ord", "text"))


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraphs, table_rows, text_length, outline_items) of each document, computed inside its row."""
    p = docs.select(key, lines_of(F.col(text)).alias("p"))
    solid = F.transform("p", lambda x: F.struct(x.alias("text"), T.solid_length(x).alias("solid")))
    heading = F.filter(F.transform(solid, lambda b, i: T.role(b["text"], i, solid=b["solid"])), lambda r: r != "body")
    return p.select(
        key, F.size("p").alias("paragraphs"), F.size(F.filter("p", lambda x: T.is_table_line(x))).alias("table_rows"),
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("text_length"), F.size(heading).alias("outline_items"),
    )


def render_weight(paragraphs: Column, table_rows: Column, images: Column, drawings: Column, text_length: Column) -> Column:
    return (paragraphs + 4 * table_rows + 20 * images + 30 * drawings + F.ceil(text_length / 2000)).cast("long")


def profile(weight: Column, outline_items: Column, pages: Column) -> tuple[Column, Column]:
    """How a document is to be shown: (outline, pages), 'virtual' or 'windowed' beyond the limits, else 'normal'."""
    return F.when(outline_items > 200, "virtual").otherwise("normal"), F.when((pages >= 60) | (weight >= 3000), "windowed").otherwise("normal")


def outline(items: DataFrame, key: str) -> DataFrame:
    """items (key, ord, level, id) with parent_id: the nearest item before with a smaller level; null for roots.

    For each level the last item before is carried along in one window; the latest of those with a smaller level counts.
    """
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct("ord", "id")), ignorenulls=True).over(before) for n in LEVELS]
    carried = items.withColumn("_last", F.array(*last))
    parent = F.array_max(F.filter("_last", lambda s, n: s.isNotNull() & (n < F.col("level"))))
    return carried.withColumn("parent_id", parent["id"]).drop("_last")


def outline_rows(tree: DataFrame, key: str) -> DataFrame:
    """tree (key, id, ord, parent_id) with sibling_index (from 1), sibling_count and has_next."""
    siblings = Window.partitionBy(key, "parent_id")
    count, index = F.count("*").over(siblings), F.row_number().over(siblings.orderBy("ord"))
    return tree.withColumns({"sibling_index": index, "sibling_count": count.cast("int"), "has_next": index < count})


def numbering(items: DataFrame, key: str, start: Column | None = None) -> DataFrame:
    """items (key, ord, level) with counters (array<int>): the counters of levels 0 to the item's own.

    A level's counter starts anew after an item of a smaller level. So a level-n counter is the number of its items so
    far without those up to the last such item. Levels that were not seen since count as start. All windows have one
    order, so the items are sorted once.
    """
    upto = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    first = F.lit(1) if start is None else start
    df = items.withColumns({f"_all{n}": F.count(F.when(F.col("level") == n, 1)).over(upto) for n in LEVELS})
    df = df.withColumns({f"_before{n}": F.last(F.when(F.col("level") < n, F.col(f"_all{n}")), ignorenulls=True).over(upto) for n in LEVELS})
    counters = [(F.greatest(F.col(f"_all{n}") - F.coalesce(f"_before{n}", F.lit(0)), F.lit(1)) - 1 + first).cast("int") for n in LEVELS]
    df = df.withColumn("_counters", F.array(*counters)).withColumn("counters", F.slice("_counters", F.lit(1), F.col("level") + 1))
    return df.drop("_counters", *[f"_{x}{n}" for n in LEVELS for x in ("all", "before")])


def number_text(counters: Column, level: Column, kinds: tuple[str, ...] = ("decimal", "lower_letter", "roman")) -> Column:
    """The last counter in its level's kind (roman, upper_letter, lower_letter, chinese or decimal; kinds take turns)."""
    from quireframe.functions import a1

    n = F.element_at(counters, -1)
    shown = {"roman": T.roman(n), "upper_letter": a1.column_label(n), "lower_letter": F.lower(a1.column_label(n)), "chinese": T.chinese(n), "decimal": n.cast("string")}
    out = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        out = F.when(level % len(kinds) == i, shown[kind]).otherwise(out)
    return out


@pandas_udf(ArrayType(IntegerType()))
def _greedy(sizes: pd.Series, budget: pd.Series) -> pd.Series:
    """The number (from 0) of each item's batch: a new one begins where the sum would exceed the budget."""

    def one(row, most):
        out, batch, used = [], 0, 0
        for size in () if row is None else row:
            if used and used + size > most:
                batch, used = batch + 1, 0
            used += size
            out.append(batch)
        return out

    return pd.Series([one(row, most) for row, most in zip(sizes, budget, strict=True)])


def greedy_batches(sizes: Column, budget: int) -> Column:
    """array<int> for an array of positive sizes in order: batches of at most the budget; a larger item stands alone.

    The sizes lie in one row, so a document is neither exploded nor gathered for this.
    """
    return _greedy(sizes.cast("array<double>"), F.lit(budget))


def chunks(docs: DataFrame, key: str, text: str, budget: int = CHUNK_BYTES) -> DataFrame:
    """(key, ord, chunk): the paragraphs' batches of at most budget bytes, two for each character."""
    p = docs.select(key, lines_of(F.col(text)).alias("p"))
    sized = p.withColumn("size", F.transform("p", lambda x: 2 * F.greatest(F.char_length(x), F.lit(1))))
    return sized.withColumn("chunk", greedy_batches(F.col("size"), budget)).select(key, F.posexplode("chunk").alias("ord", "chunk"))


def pages(docs: DataFrame, key: str, text: str, height: float = 931.0, width: float = 554.0) -> DataFrame:
    """(key, ord, role, height, page): paragraphs put on pages one after the other by their estimated heights.

    A page is full where the next paragraph would exceed the height; a paragraph higher than a page stands alone.
    """
    p = docs.select(key, lines_of(F.col(text)).alias("p"))
    # in steps, so that the length and the role are worked out once for each paragraph
    solid = F.transform("p", lambda x: F.struct(x.alias("text"), T.solid_length(x).alias("solid")))
    roles = F.transform(solid, lambda b, i: F.struct(b["text"].alias("text"), T.role(b["text"], i, solid=b["solid"]).alias("role")))
    sized = p.select(key, F.transform(roles, lambda b: F.struct(b["role"].alias("role"), T.paragraph_height(b["text"], b["role"], width).alias("height"))).alias("b"))
    placed = sized.withColumn("page", _greedy(F.col("b.height"), F.lit(height))).select(key, F.posexplode(F.arrays_zip("b", "page")).alias("ord", "z"))
    return placed.select(key, "ord", "z.b.role", F.round("z.b.height", 4).alias("height"), "z.page")


def page_breaks(events: DataFrame, key: str, order: list[str], breaks: Column) -> DataFrame:
    """The rows with page (from 0): a row for which ``breaks`` holds begins a page, but the first of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    flagged = events.withColumn("_break", (breaks & ~first).cast("int"))
    return flagged.withColumn("page", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_break")


def merge_adjacent(rows: DataFrame, key: str, order: str, same: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, run, first, rows, same, text): neighbours that are alike in ``same`` as one row, their texts joined in order."""
    w = Window.partitionBy(key).orderBy(order)
    new = ~F.lag(same).over(w).eqNullSafe(F.col(same)) | (F.row_number().over(w) == 1)
    runs = rows.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator)
    return runs.groupBy(key, F.col("run").cast("int").alias("run")).agg(F.min(order).alias("first"), F.count("*").alias("rows"), F.min(same).alias(same), joined.alias(text))


def vertical_spans(cells: DataFrame, keys: list[str], row: str, restart: Column, goes_on: Column) -> DataFrame:
    """The cells that stay, with row_span: a cell that goes on extends the restart above it, in its column.

    A cell that goes on without a restart directly above counts as a cell of its own.
    """
    upto = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    marked = cells.withColumns({"_restart": restart, "_on": goes_on})
    island = Window.partitionBy(*keys, "_island")
    whole = F.max(F.col("_restart").cast("int")).over(island) == 1
    spans = marked.withColumn("_island", F.count(F.when(~F.col("_on"), 1)).over(upto)).withColumns({"_whole": whole, "_n": F.count("*").over(island)})
    kept = spans.where(~(F.col("_on") & F.col("_whole"))).withColumn("row_span", F.when(F.col("_whole"), F.col("_n")).otherwise(1).cast("int"))
    return kept.drop("_restart", "_on", "_island", "_whole", "_n")


def dominant(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, rows): the value that most rows have; of equal ones the one that came first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("rows"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "rows"), F.struct("rows", -F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{value}", "b.rows")


def texts_before_images(blocks: DataFrame, key: str, order: str, kind: Column) -> DataFrame:
    """blocks with place (from 0): directly after a table, texts of a run of 'text' and 'image' blocks come before its images.

    kind is 'table', 'image', 'text' or anything else; a run ends at the first block of another kind.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumn("_kind", kind).withColumn("_stop", F.count(F.when(~F.col("_kind").isin("image", "text"), 1)).over(upto))
    # what a run follows is the block that stopped the one before
    after = F.first("_kind").over(Window.partitionBy(key, "_stop").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.when((after == "table") & (F.col("_kind") == "image"), 2).when((after == "table") & (F.col("_kind") == "text"), 1).otherwise(0)
    ranked = marked.withColumn("_rank", rank)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_stop", F.when(F.col("_kind").isin("image", "text"), F.col("_rank")).otherwise(-1), order)) - 1
    return ranked.withColumn("place", place).drop("_kind", "_stop", "_rank")


def overflow_pages(blocks: DataFrame, key: str, order: str, spacer: Column, full: Column, least: int = 2) -> DataFrame:
    """blocks with page (from 0): a block that fills a page begins a new one if one was there before and ``least`` spacers or more stand directly before it."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumns({"_spacer": spacer, "_full": full}).withColumn("_n", F.row_number().over(w))
    # place of the last block before that is no spacer: all after it are
    solid = F.coalesce(F.max(F.when(~F.col("_spacer"), F.col("_n"))).over(before), F.lit(0))
    earlier = F.coalesce(F.max(F.col("_full").cast("int")).over(before), F.lit(0)) == 1
    cut = (F.col("_full") & earlier & (F.col("_n") - 1 - solid >= least)).cast("int")
    return marked.withColumn("_cut", cut).withColumn("page", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_spacer", "_full", "_n", "_cut")


def page_starts(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """blocks with page (from 0), the one on which a block's beginning stands; blocks that are only a break have null.

    blocks have rendered (where the file says a page began when it was last shown), explicit (a break stands in it),
    alone (nothing but a break), section (it ends a section) and table_breaks (rows of a table before which a page
    begins). A page begins before a block that was rendered so, but not where the one before ended with an explicit
    break, which says the same; behind a block with an explicit break or the end of a section; before the rows of a
    table. A boundary without a block on the page before begins none.
    """
    w = Window.partitionBy(key).orderBy(order)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = F.coalesce(F.size("table_breaks"), F.lit(0))
    said = yes("explicit") & ~yes("section") | yes("alone")
    doubled = F.coalesce(F.lag(said).over(w), F.lit(False))
    before = yes("rendered") & (rows <= 0) & ~doubled
    after = yes("alone") | yes("section") | yes("explicit")
    shown = ~yes("alone")
    marked = blocks.withColumns({"_before": before, "_after": after, "_shown": shown, "_rows": F.greatest(rows, F.lit(0)), "_first": F.coalesce(F.get("table_breaks", F.lit(0)) == 0, F.lit(False)) & (rows > 0)})
    # something stands on the page before if a block that shows came since the last boundary
    boundary = F.col("_before") | F.coalesce(F.lag("_after").over(w), F.lit(False)) | F.col("_first")
    marked = marked.withColumn("_cut", boundary)
    run = marked.withColumn("_run", F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # pages that begin inside a table, behind its first row
    inner = F.when(F.col("_shown"), F.col("_rows") - F.col("_first").cast("int")).otherwise(0)
    has = run.groupBy(key, "_run").agg(F.max(F.col("_shown").cast("int")).alias("_has"), F.sum(inner).alias("_inner"))
    upto = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    has = has.withColumn("_page", F.coalesce(F.sum(F.col("_has") + F.col("_inner")).over(upto), F.lit(0)))
    placed = run.join(has.select(key, "_run", "_page"), [key, "_run"]).withColumn("_passed", F.coalesce(F.sum(inner).over(Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    page = F.when(F.col("_shown"), F.col("_page") + F.col("_passed")).cast("int")
    return placed.withColumn("page", page).drop("_before", "_after", "_shown", "_rows", "_first", "_cut", "_run", "_page", "_passed")


def object_statistics(blocks: DataFrame, key: str) -> DataFrame:
    """(key, paragraphs, table_rows, text_length, outline_items, images, drawings) of blocks (key, block_id, kind, text,
    outline_level, image_ids, drawing_ids), those inside tables and shapes being rows of their own.

    A block that comes again (kind 'paragraph', 'table_row' or others) counts once, and so does each picture and drawing
    of a document, whatever blocks show it.
    """
    once = blocks.groupBy(key, "block_id").agg(F.min(F.struct("kind", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), "outline_level")).alias("b"))
    sums = once.groupBy(key).agg(
        F.count_if(F.col("b.kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("b.kind") == "table_row").alias("table_rows"), F.sum("b.chars").cast("long").alias("text_length"), F.count_if(F.col("b.outline_level").isNotNull()).alias("outline_items")
    )
    ids = lambda c: blocks.select(key, F.explode(c).alias("id")).where("id IS NOT NULL").groupBy(key).agg(F.count_distinct("id").alias(c[:-4] + "s"))
    out = sums.join(ids("image_ids"), key, "left").join(ids("drawing_ids"), key, "left")
    return out.select(key, "paragraphs", "table_rows", "text_length", "outline_items", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("images", "drawings")])
