"""Queries of cells, axes and merges over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import a1, numbers
from quireframe.operators import axis, grid, merges
from quireframe.plans.registry import query, table

COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_day"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_day"]


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a workbook with a sheet for each supplier."""
    lines = table(spark, sf_dir, "lineitem").withColumn("l_day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return grid.to_cells(lines, "l_suppkey", ORDER, COLUMNS)


LINES_SQL = f"""
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ORDER)}) + 1 AS INT) AS row_index
  FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS l_day FROM lineitem)
), cells AS (
""" + "\n  UNION ALL ".join(
    f"SELECT CAST(l_suppkey AS VARCHAR) AS sheet_id, row_index, {i} AS column_index, '{'s' if c in ORDER[-3:] else 'n'}' AS type,"
    f" {f'{c}' if c in ORDER[-3:] else 'NULL'} AS text_value, {'NULL' if c in ORDER[-3:] else f'CAST({c} AS DOUBLE)'} AS num_value FROM numbered"
    for i, c in enumerate(COLUMNS, 1)
) + "\n)"


@query(
    "grid_range",
    f"""WITH {LINES_SQL}
SELECT sheet_id, row_index, CAST(column_index AS INT) AS column_index, chr(64 + column_index) || row_index AS ref,
  CASE WHEN type = 's' THEN text_value ELSE format('{{:,.2f}}', round(num_value, 2)) END AS value
FROM cells WHERE row_index BETWEEN 2 AND 41 AND column_index BETWEEN 1 AND 11""",
)
def grid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-RANGE, FLT-RANGE, FN-MKREF, FN-FMT: a window of cells of every sheet with the text they show."""
    cells = grid.in_range(line_cells(spark, sf_dir), (2, 41), (1, 11))
    shown = F.when(F.col("type") == "s", F.col("raw_value")).otherwise(numbers.display(F.col("num_value"), "#,##0.00"))
    return cells.select("sheet_id", "row_index", "column_index", a1.cell_ref(F.col("row_index"), F.col("column_index")).alias("ref"), shown.alias("value"))


@query(
    "grid_tiles",
    f"""WITH {LINES_SQL}
SELECT sheet_id, CAST((row_index - 1) // 200 AS INT) AS row_tile, CAST((column_index - 1) // 50 AS INT) AS column_tile, count(*) AS cells,
  min(row_index) AS first_row, max(row_index) AS last_row, count(*) FILTER (coalesce(text_value, CAST(num_value AS VARCHAR), '') <> '') AS filled
FROM cells GROUP BY ALL""",
)
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-TILES, FN-TILE: the tiles of all sheets."""
    return grid.tiles(line_cells(spark, sf_dir))


@query(
    "used_range",
    """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS sheet_id, o_orderstatus, o_totalprice,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS row_index FROM orders),
cells AS (SELECT sheet_id, row_index, 1 AS column_index, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS v FROM n
  UNION ALL SELECT sheet_id, row_index, 2, CASE WHEN o_totalprice > 150000 THEN 'x' END FROM n)
SELECT sheet_id, CAST(coalesce(max(row_index) FILTER (v IS NOT NULL), 0) AS INT) AS rows, CAST(coalesce(max(column_index) FILTER (v IS NOT NULL), 0) AS INT) AS columns,
  CAST(max(row_index) AS INT) AS declared_rows, CAST(max(column_index) AS INT) AS declared_columns FROM cells GROUP BY sheet_id""",
)
def used_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-USED-RANGE, FLT-OCCUPIED: a sheet for each customer, cells of some orders left blank."""
    orders = table(spark, sf_dir, "orders")
    blanked = orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 150000, F.lit("x")).alias("large"))
    cells = grid.to_cells(blanked, "o_custkey", ["o_orderkey"], ["status", "large"])
    return grid.used_range(cells, grid.occupied(F.col("raw_value")))


@query(
    "dense_grid",
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS sheet_id, CAST(turn + 1 AS INT) AS row_index,
  CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS column_index, CAST(length(text) AS VARCHAR) AS v FROM conversations),
s AS (SELECT sheet_id, max(row_index) AS rows, max(column_index) AS columns FROM c GROUP BY sheet_id)
SELECT s.sheet_id, CAST(r AS INT) AS row_index, CAST(k AS INT) AS column_index, coalesce(v, '') AS value
FROM s, unnest(range(1, rows + 1)) AS a(r), unnest(range(1, columns + 1)) AS b(k) LEFT JOIN c ON c.sheet_id = s.sheet_id AND c.row_index = r AND c.column_index = k""",
)
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-MATERIALIZE, SRC-XLSX-GRID: conversations as sheets, turns by roles, blanks filled in."""
    turns = table(spark, sf_dir, "conversations")
    column = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    cells = turns.select(F.col("conv_id").cast("string").alias("sheet_id"), (F.col("turn") + 1).cast("int").alias("row_index"), column.alias("column_index"), F.char_length("text").cast("string").alias("raw_value"))
    sheets = cells.groupBy("sheet_id").agg(F.max("row_index").alias("rows"), F.max("column_index").alias("columns"))
    return grid.materialize(sheets, cells)


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of sheets of 1000: sizes are heights, those of a third of the sizes the default, every seventh other size is hidden."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rows = parts.select(
        F.floor(key / 1000).cast("string").alias("sheet_id"), F.lit("row").alias("axis"), (key % 1000 + 1).cast("int").alias("idx"),
        F.when(F.col("p_size") % 3 == 0, 20.0).otherwise(F.col("p_size").cast("double")).alias("size"), ((F.col("p_size") % 3 != 0) & (F.col("p_size") % 7 == 0)).alias("hidden"), F.lit(20.0).alias("default_size"),
    )
    return rows


PARTS_SQL = """o AS (SELECT CAST(p_partkey // 1000 AS VARCHAR) AS sheet_id, 'row' AS axis, CAST(p_partkey % 1000 + 1 AS INT) AS idx,
  CASE WHEN p_size % 3 = 0 THEN 20.0::DOUBLE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS size FROM part),
s AS (SELECT *, (idx - 1) * 20.0::DOUBLE + coalesce(sum(size - 20) OVER (PARTITION BY sheet_id, axis ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)"""


@query("axis_offsets", f"WITH {PARTS_SQL} SELECT sheet_id, axis, idx, size, start, start + size AS \"end\" FROM s")
def axis_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-AXIS: offsets of rows with sizes of their own."""
    return axis.offsets(part_rows(spark, sf_dir)).select("sheet_id", "axis", "idx", "size", "start", "end")


@query(
    "axis_lookup",
    f"""WITH {PARTS_SQL},
full_ AS (SELECT h.sheet_id, r AS idx, coalesce(o.size, 20.0) AS size FROM (SELECT DISTINCT sheet_id FROM o) h CROSS JOIN unnest(range(1, 1001)) AS t(r) LEFT JOIN o ON o.sheet_id = h.sheet_id AND o.idx = r),
ends AS (SELECT sheet_id, idx, sum(size) OVER (PARTITION BY sheet_id ORDER BY idx) AS e FROM full_),
q AS (SELECT DISTINCT CAST(l_partkey // 1000 AS VARCHAR) AS sheet_id, CAST(l_quantity * 400 AS DOUBLE) AS x FROM lineitem)
SELECT q.sheet_id, 'row' AS axis, x, CAST(least(1000, coalesce((SELECT min(idx) FROM ends WHERE ends.sheet_id = q.sheet_id AND e > x), 1000)) AS BIGINT) AS idx
FROM q WHERE q.sheet_id IN (SELECT sheet_id FROM o)""",
)
def axis_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-AXIS inverse: the row at an offset."""
    sized = axis.offsets(part_rows(spark, sf_dir))
    asked = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 1000).cast("string").alias("sheet_id"), (F.col("l_quantity") * 400).alias("x")).distinct()
    known = sized.select("sheet_id").distinct()
    points = asked.join(known, "sheet_id", "left_semi").select("sheet_id", F.lit("row").alias("axis"), "x", F.lit(20.0).alias("default_size"), F.lit(1000).alias("count"))
    return axis.find(sized, points)


def order_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged ranges from orders: a sheet for every 500 keys, place and size from the key and the customer."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    row, column = key % 500 + 1, customer % 60 + 1
    return table(spark, sf_dir, "orders").select(
        F.floor(key / 500).cast("string").alias("sheet_id"), key.alias("merge_id"), row.cast("int").alias("start_row"), column.cast("int").alias("start_column"),
        (row + customer % 3).cast("int").alias("end_row"), (column + key % 4).cast("int").alias("end_column"),
    )


MERGES_SQL = """m AS (SELECT CAST(o_orderkey // 500 AS VARCHAR) AS sheet_id, o_orderkey AS merge_id, CAST(o_orderkey % 500 + 1 AS INT) AS start_row, CAST(o_custkey % 60 + 1 AS INT) AS start_column,
  CAST(o_orderkey % 500 + 1 + o_custkey % 3 AS INT) AS end_row, CAST(o_custkey % 60 + 1 + o_orderkey % 4 AS INT) AS end_column FROM orders)"""
RANGES_SQL = """r AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY merge_id) AS n, merge_id AS range_id, start_row, start_column, start_row + 2 AS end_row, start_column + 3 AS end_column FROM m)"""


GROWN_SQL = """g(sheet_id, range_id, a, b, c, d, step) AS (
  SELECT sheet_id, range_id, start_row, start_column, end_row, end_column, 0 FROM r
  UNION ALL
  SELECT * FROM (SELECT g.sheet_id, g.range_id, least(g.a, min(m.start_row)) AS a, least(g.b, min(m.start_column)) AS b, greatest(g.c, max(m.end_row)) AS c, greatest(g.d, max(m.end_column)) AS d, g.step + 1
    FROM g JOIN m ON g.sheet_id = m.sheet_id AND m.start_row <= g.c AND g.a <= m.end_row AND m.start_column <= g.d AND g.b <= m.end_column
    GROUP BY g.sheet_id, g.range_id, g.a, g.b, g.c, g.d, g.step HAVING min(m.start_row) < g.a OR min(m.start_column) < g.b OR max(m.end_row) > g.c OR max(m.end_column) > g.d))"""


def ranges_at(merged: DataFrame) -> DataFrame:
    """Ranges of three rows and four columns that begin where the merges do."""
    return merged.select("sheet_id", F.col("merge_id").alias("range_id"), "start_row", "start_column", (F.col("start_row") + 2).alias("end_row"), (F.col("start_column") + 3).alias("end_column"))


@query(
    "merge_cover",
    f"""WITH {MERGES_SQL}
SELECT sheet_id, CAST(i AS INT) AS row_index, CAST(k AS INT) AS column_index,
  CAST(CASE WHEN i = start_row AND k = start_column THEN end_row - start_row + 1 ELSE 1 END AS INT) AS row_span,
  CAST(CASE WHEN i = start_row AND k = start_column THEN end_column - start_column + 1 ELSE 1 END AS INT) AS column_span, NOT (i = start_row AND k = start_column) AS hidden_by_merge
FROM m, unnest(range(start_row, end_row + 1)) AS a(i), unnest(range(start_column, end_column + 1)) AS b(k)""",
)
def merge_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-APPLYMERGE: all cells of all merges with spans and flags."""
    return merges.cover(order_merges(spark, sf_dir))


@query(
    "merge_points",
    f"""WITH {MERGES_SQL}, c AS (SELECT DISTINCT CAST(l_orderkey // 500 AS VARCHAR) AS sheet_id, CAST(l_orderkey % 500 + 1 AS INT) AS row_index, CAST(l_partkey % 60 + 1 AS INT) AS column_index FROM lineitem)
SELECT c.sheet_id, row_index, column_index, merge_id, start_row, start_column, end_row, end_column
FROM c JOIN m ON c.sheet_id = m.sheet_id AND row_index BETWEEN start_row AND end_row AND column_index BETWEEN start_column AND end_column""",
)
def merge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-MERGE-POINT: the merges that hold a cell."""
    key = F.col("l_orderkey")
    cells = table(spark, sf_dir, "lineitem").select(F.floor(key / 500).cast("string").alias("sheet_id"), (key % 500 + 1).cast("int").alias("row_index"), (F.col("l_partkey") % 60 + 1).cast("int").alias("column_index")).distinct()
    return merges.containing(cells, order_merges(spark, sf_dir))


@query(
    "merge_overlap",
    f"""WITH {MERGES_SQL}, {RANGES_SQL}
SELECT r.sheet_id, range_id, merge_id, m.start_row AS m_start_row, m.start_column AS m_start_column, m.end_row AS m_end_row, m.end_column AS m_end_column FROM r JOIN m ON r.sheet_id = m.sheet_id
  AND m.start_row <= r.end_row AND r.start_row <= m.end_row AND m.start_column <= r.end_column AND r.start_column <= m.end_column""",
)
def merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-MERGE-ISECT: the merges that a range touches."""
    merged = order_merges(spark, sf_dir)
    return merges.overlapping(ranges_at(merged), merged)


@query(
    "merge_expand",
    f"""WITH RECURSIVE {MERGES_SQL}, {RANGES_SQL},
{GROWN_SQL}
SELECT sheet_id, range_id, arg_max(a, step) AS start_row, arg_max(b, step) AS start_column, arg_max(c, step) AS end_row, arg_max(d, step) AS end_column FROM g GROUP BY sheet_id, range_id""",
)
def merge_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-MERGE-EXPAND: ranges grown until no merge is cut."""
    merged = order_merges(spark, sf_dir)
    return merges.expand(ranges_at(merged), merged)


ASKED_SQL = f"""{MERGES_SQL}, r AS (SELECT sheet_id, merge_id AS range_id, least(start_row, 498) AS start_row, least(start_column, 60) AS start_column, least(start_row + 2, 498) AS end_row, least(start_column + 3, 60) AS end_column FROM m),
{GROWN_SQL}, x AS (SELECT sheet_id, range_id, least(arg_max(a, step), 498) AS start_row, least(arg_max(b, step), 60) AS start_column, least(arg_max(c, step), 498) AS end_row, least(arg_max(d, step), 60) AS end_column FROM g GROUP BY sheet_id, range_id)"""


def asked_ranges(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Ranges at all merges over sheets of 498 rows and 60 columns, with the lines of the sheets' orders as cells."""
    merged, key = order_merges(spark, sf_dir), F.col("o_orderkey")
    sheets = merged.select("sheet_id").distinct().select("sheet_id", F.lit(498).alias("rows"), F.lit(60).alias("columns"), F.lit(20).alias("row_size"), F.lit(64).alias("column_size"))
    sizes = table(spark, sf_dir, "orders").select(F.floor(key / 500).cast("string").alias("sheet_id"), F.lit("row").alias("axis"), (key % 500 + 1).cast("int").alias("idx"), (F.col("o_custkey") % 30 + 10).cast("int").alias("size"), (F.col("o_custkey") % 13 == 0).alias("hidden"))
    line = F.col("l_orderkey")
    cells = table(spark, sf_dir, "lineitem").groupBy(F.floor(line / 500).cast("string").alias("sheet_id"), (line % 500 + 1).cast("int").alias("row_index"), (F.col("l_partkey") % 60 + 1).cast("int").alias("column_index")).agg(F.max("l_linenumber").alias("value"))
    return grid.range_query(ranges_at(merged), sheets, cells, sizes, merged)


@query(
    "range_cells",
    f"""WITH RECURSIVE {ASKED_SQL}, c AS (SELECT CAST(l_orderkey // 500 AS VARCHAR) AS sheet_id, CAST(l_orderkey % 500 + 1 AS INT) AS row_index, CAST(l_partkey % 60 + 1 AS INT) AS column_index, max(l_linenumber) AS value FROM lineitem GROUP BY ALL)
SELECT x.sheet_id, range_id, row_index, column_index, value FROM x JOIN c ON c.sheet_id = x.sheet_id AND row_index BETWEEN start_row AND end_row AND column_index BETWEEN start_column AND end_column""",
)
def range_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-RANGE: the cells of many ranges, clamped and grown by merges."""
    return asked_ranges(spark, sf_dir)["cells"]


@query(
    "range_axes",
    f"""WITH RECURSIVE {ASKED_SQL}, s AS (SELECT CAST(o_orderkey // 500 AS VARCHAR) AS sheet_id, CAST(o_orderkey % 500 + 1 AS INT) AS idx, CAST(o_custkey % 30 + 10 AS INT) AS size, o_custkey % 13 = 0 AS hidden FROM orders)
SELECT x.sheet_id, range_id, 'row' AS axis, CAST(i AS INT) AS idx, coalesce(size, CAST(20 AS INT)) AS size, coalesce(hidden, false) AS hidden FROM x, unnest(range(start_row, end_row + 1)) AS t(i) LEFT JOIN s ON s.sheet_id = x.sheet_id AND s.idx = i
UNION ALL SELECT sheet_id, range_id, 'column', CAST(i AS INT), CAST(64 AS INT), false FROM x, unnest(range(start_column, end_column + 1)) AS t(i)""",
)
def range_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-RANGE: the sizes of all rows and columns of many ranges."""
    return asked_ranges(spark, sf_dir)["axis"]


@query(
    "merge_reject",
    f"""WITH RECURSIVE {MERGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY merge_id) AS n FROM m),
k(sheet_id, n, kept) AS (
  SELECT sheet_id, 1::BIGINT, [struct_pack(i := merge_id, a := start_row, b := start_column, c := end_row, d := end_column)] FROM o WHERE n = 1
  UNION ALL
  SELECT k.sheet_id, o.n, CASE WHEN len(list_filter(kept, lambda x: x.a <= o.end_row AND o.start_row <= x.c AND x.b <= o.end_column AND o.start_column <= x.d)) > 0 THEN kept
    ELSE list_append(kept, struct_pack(i := merge_id, a := start_row, b := start_column, c := end_row, d := end_column)) END FROM k JOIN o ON o.sheet_id = k.sheet_id AND o.n = k.n + 1),
z AS (SELECT sheet_id, unnest(arg_max(kept, n)) AS x FROM k GROUP BY sheet_id)
SELECT sheet_id, x.i AS merge_id, x.a AS start_row, x.b AS start_column, x.c AS end_row, x.d AS end_column FROM z""",
)
def merge_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-OVERLAP-REJECT: the merges that overlap none that came before and stays."""
    return merges.drop_overlapping(order_merges(spark, sf_dir))


@query(
    "visible_cells",
    """WITH n AS (SELECT CAST(c_nationkey * 1000 + c_custkey % 1000 AS VARCHAR) AS sheet_id, c_custkey, c_mktsegment, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey * 1000 + c_custkey % 1000 ORDER BY c_custkey) + 1 AS INT) AS row_index FROM customer),
c AS (SELECT sheet_id, row_index, 1 AS column_index, CAST(c_custkey AS VARCHAR) AS raw_value FROM n UNION ALL SELECT sheet_id, row_index, 2, c_mktsegment FROM n UNION ALL SELECT sheet_id, row_index, 3, c_mktsegment FROM n)
SELECT sheet_id, row_index, CAST(column_index AS INT) AS column_index, raw_value, CAST(dense_rank() OVER (PARTITION BY sheet_id ORDER BY row_index) AS INT) AS visible_row, CAST(dense_rank() OVER (PARTITION BY sheet_id ORDER BY column_index) AS INT) AS visible_column
FROM c WHERE row_index % 3 <> 0 AND column_index <> 2""",
)
def visible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-VISIBLE, FLT-HIDDEN-AXIS: cells without those of hidden rows and columns, places counted anew."""
    key = F.col("c_nationkey") * 1000 + F.col("c_custkey") % 1000
    customers = table(spark, sf_dir, "customer").select(key.cast("string").alias("sheet"), "c_custkey", "c_mktsegment", F.col("c_mktsegment").alias("again"))
    cells = grid.to_cells(customers, "sheet", ["c_custkey"], ["c_custkey", "c_mktsegment", "again"]).drop("type", "num_value")
    return grid.visible(cells, F.col("row_index") % 3 == 0, F.col("column_index") == 2)


@query(
    "cell_overflow",
    """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS sheet_id, CAST(1 AS INT) AS row_index, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS column_index,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS value, CASE o_orderkey % 5 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN 'justify' END AS align, CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 'n' END AS type, 10.0 + o_orderkey % 7 AS w FROM orders),
x AS (SELECT *, coalesce(sum(w) OVER b, 0) AS upto FROM c WINDOW b AS (PARTITION BY sheet_id, row_index ORDER BY column_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, last_value(CASE WHEN value <> '' THEN column_index END IGNORE NULLS) OVER b AS previous_column, last_value(CASE WHEN value <> '' THEN upto + w END IGNORE NULLS) OVER b AS pe,
  first_value(CASE WHEN value <> '' THEN column_index END IGNORE NULLS) OVER a AS next_column, first_value(CASE WHEN value <> '' THEN upto END IGNORE NULLS) OVER a AS ns FROM x
  WINDOW b AS (PARTITION BY sheet_id, row_index ORDER BY column_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY sheet_id, row_index ORDER BY column_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT sheet_id, row_index, column_index, value, previous_column, next_column,
  CASE align WHEN 'right' THEN 'left' WHEN 'center' THEN 'both' WHEN 'justify' THEN 'none' ELSE CASE WHEN type = 's' THEN 'right' ELSE 'none' END END AS direction,
  CAST(upto - pe AS DOUBLE) AS left_free, CAST(ns - (upto + w) AS DOUBLE) AS right_free FROM y WHERE value <> ''""",
)
def cell_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-ROLLOVERFLOW: free widths beside the texts of a row; a row for each customer, a cell for each order."""
    from pyspark.sql.window import Window

    key = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("sheet_id"), F.lit(1).alias("row_index"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("column_index"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("value"), F.when(key % 5 == 0, "center").when(key % 5 == 1, "right").when(key % 5 == 2, "justify").alias("align"),
        F.when(key % 2 == 0, "s").otherwise("n").alias("type"), (10.0 + key % 7).alias("w"),
    )
    out = grid.overflow(cells, F.col("w"), F.col("align"), F.col("type"))
    return out.select("sheet_id", "row_index", "column_index", "value", "previous_column", "next_column", "direction", "left_free", "right_free")
