"""Queries of dictionaries, cascades, priority lookups, ranges and runs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import lookup
from quireframe.plans.registry import query, table


@query(
    "shared_strings",
    """WITH d AS (SELECT p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INT) AS i FROM (SELECT DISTINCT p_brand, p_type FROM part))
SELECT p.p_partkey, p.p_brand, CAST(p_partkey % 12 AS INT) AS string_index, coalesce(d.p_type, '') AS value FROM part p LEFT JOIN d ON d.p_brand = p.p_brand AND d.i = p_partkey % 12""",
)
def shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-SST, JN-SST-SEMI: a dictionary of strings for each brand, and cells that refer to it by index."""
    parts = table(spark, sf_dir, "part")
    entries = lookup.dictionary(parts, ["p_brand"], "p_type")
    cells = parts.select("p_partkey", "p_brand", (F.col("p_partkey") % 12).cast("int").alias("string_index"))
    return lookup.resolve(cells, entries, ["p_brand"], "string_index").select("p_partkey", "p_brand", "string_index", "value")


@query(
    "style_cascade",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'red' END, CASE WHEN n_nationkey % 3 = 0 THEN 'nation ' || n_nationkey END, CASE WHEN r_regionkey % 2 = 0 THEN 'region ' || r_regionkey END) AS fill,
  coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS font FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-STYLE, JN-XF, FN-MERGEMAP, PRJ-STYLE-COMPACT: fields from the customer, its nation or its region, the nearest first."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    keyed = table(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey")), "c_nationkey")
    own = keyed.select("c_custkey", "c_nationkey", "r_regionkey", F.when(F.col("c_acctbal") < 0, "red").alias("fill"))
    regions = region.select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("region "), "r_regionkey")).alias("fill"), F.col("r_name").alias("font"))
    nations = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("nation "), "n_nationkey")).alias("fill"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("font"))
    return lookup.cascade(own, [(regions, ["r_regionkey"]), (nations, ["c_nationkey"])], ["fill", "font"]).select("c_custkey", "fill", "font")


@query(
    "placeholder_priority",
    """WITH e AS (SELECT 'n:' || 2 * n_nationkey AS name, n_name AS style FROM nation UNION ALL SELECT 'r:' || (2 * r_regionkey + 1), r_name FROM region),
a AS (SELECT s_suppkey, [ 'n:' || s_nationkey, 'n:' || (s_nationkey + 1), 'r:' || (s_nationkey % 5)] AS l FROM supplier),
t AS (SELECT s_suppkey, unnest(l) AS alias, generate_subscripts(l, 1) AS rank FROM a), h AS (SELECT s_suppkey, rank, alias, style FROM t JOIN e ON alias = name)
SELECT s.s_suppkey, (SELECT arg_min(alias, rank) FROM h WHERE h.s_suppkey = s.s_suppkey) AS matched, (SELECT arg_min(style, rank) FROM h WHERE h.s_suppkey = s.s_suppkey) AS style FROM supplier s""",
)
def placeholder_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-PLACEHOLDER: the first of several names that has a style."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    styles = nation.select(F.concat(F.lit("n:"), F.col("n_nationkey") * 2).alias("name"), F.col("n_name").alias("style"))
    styles = styles.unionByName(region.select(F.concat(F.lit("r:"), F.col("r_regionkey") * 2 + 1).alias("name"), F.col("r_name").alias("style")))
    n = F.col("s_nationkey")
    aliases = F.array(F.concat(F.lit("n:"), n), F.concat(F.lit("n:"), n + 1), F.concat(F.lit("r:"), n % 5))
    return lookup.by_priority(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), aliases, styles, ["s_suppkey"], "name", "style").select("s_suppkey", "matched", "style")


@query(
    "ole_anti_union",
    """SELECT doc_id, 'drawing' AS kind, n_chars AS size FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT doc_id, 'ole', CAST(quality AS BIGINT) FROM labels""",
)
def ole_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-OLE-ANTI, ST-UNION, ST-EXCEPT: pictures that no embedded object replaces, and all objects."""
    drawings = table(spark, sf_dir, "documents").select("doc_id", F.lit("drawing").alias("kind"), F.col("n_chars").alias("size"))
    objects = table(spark, sf_dir, "labels").select("doc_id", F.lit("ole").alias("kind"), F.col("quality").cast("long").alias("size"))
    return lookup.anti_union(drawings, objects, ["doc_id"])


SPANS_SQL = """s AS (SELECT s_nationkey AS sheet, CAST(s_suppkey % 40 + 1 AS INT) AS f, CAST(s_suppkey % 40 + 1 + s_suppkey % 9 AS INT) AS t, s_suppkey AS ord, CAST(round(s_acctbal, 0) AS BIGINT) AS width FROM supplier),
c AS (SELECT c_custkey, c_nationkey AS sheet, CAST(c_custkey % 50 + 1 AS INT) AS column_index FROM customer)"""


@query(
    "column_ranges",
    f"""WITH {SPANS_SQL}
SELECT c_custkey, c.sheet, column_index, (SELECT arg_min(width, ord) FROM s WHERE s.sheet = c.sheet AND column_index BETWEEN f AND t) AS first_width,
  (SELECT arg_max(width, ord) FROM s WHERE s.sheet = c.sheet AND column_index BETWEEN f AND t) AS last_width FROM c""",
)
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-COLINFO, JN-COLSPAN-LAST: the setting of the first and of the last range that holds a column."""
    key = F.col("s_suppkey")
    spans = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("sheet"), (key % 40 + 1).cast("int").alias("first"), (key % 40 + 1 + key % 9).cast("int").alias("last"), key.alias("ord"),
        F.round("s_acctbal", 0).cast("long").alias("first_width"), F.round("s_acctbal", 0).cast("long").alias("last_width"),
    )
    cells = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") % 50 + 1).cast("int").alias("column_index"))
    found = lookup.column_setting(cells, spans, ["sheet"], "first_width")
    return lookup.column_setting(found, spans, ["sheet"], "last_width", last=True).select("c_custkey", "sheet", "column_index", "first_width", "last_width")


RUNS_SQL = """t AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
p AS (SELECT conv_id, turn AS piece_id, e - n AS s, e FROM t), w AS (SELECT conv_id, max(e) AS e FROM t GROUP BY conv_id),
r AS (SELECT conv_id, i * 37 AS s, least(i * 37 + 30, e) AS e, 'style ' || i % 4 AS style FROM w, unnest(range(0, CAST(e // 37 + 1 AS BIGINT))) AS x(i) WHERE i * 37 < e)"""


def turn_pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations as pieces of one text, and runs of 30 characters with gaps of 7 between them."""
    from pyspark.sql.window import Window

    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n"))
    pieces = turns.withColumn("end", F.sum("n").over(upto)).select("conv_id", F.col("turn").alias("piece_id"), (F.col("end") - F.col("n")).alias("start"), "end")
    ends = pieces.groupBy("conv_id").agg(F.max("end").alias("e")).where("e > 0")
    runs = ends.select("conv_id", "e", F.explode(F.sequence(F.lit(0), F.floor((F.col("e") - 1) / 37))).alias("i"))
    return pieces, runs.select("conv_id", (F.col("i") * 37).alias("start"), F.least(F.col("i") * 37 + 30, "e").alias("end"), F.concat(F.lit("style "), F.col("i") % 4).alias("style"))


@query(
    "style_runs",
    f"""WITH {RUNS_SQL}, b AS (SELECT conv_id, s AS pos FROM p UNION SELECT conv_id, e FROM p UNION SELECT conv_id, s FROM r UNION SELECT conv_id, e FROM r),
g AS (SELECT conv_id, pos AS s, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) AS e FROM b)
SELECT g.conv_id, p.piece_id, CAST(g.s AS BIGINT) AS "start", CAST(g.e AS BIGINT) AS "end", r.style FROM g JOIN p ON p.conv_id = g.conv_id AND p.s <= g.s AND g.e <= p.e AND p.s < p.e LEFT JOIN r ON r.conv_id = g.conv_id AND r.s <= g.s AND g.e <= r.e""",
)
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-INTERVAL-RUN: text pieces cut at the borders of style runs."""
    pieces, runs = turn_pieces(spark, sf_dir)
    return lookup.style_runs(pieces, runs, "conv_id", "style")


@query(
    "asof_style",
    """WITH r AS (SELECT conv_id, turn AS ord, length(text) AS n, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS s FROM conversations WHERE length(text) > 0),
q AS (SELECT DISTINCT conv_id, CAST(turn * 61 AS BIGINT) AS position FROM conversations)
SELECT q.conv_id, position, (SELECT arg_max(role, s) FROM r WHERE r.conv_id = q.conv_id AND s <= position) AS style FROM q""",
)
def asof_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-ASOF-STYLE, JN-ANCHOR: the style at a character, by the lengths of the runs before it."""
    turns = table(spark, sf_dir, "conversations")
    runs = turns.select("conv_id", F.col("turn").alias("ord"), F.char_length("text").alias("count"), F.col("role").alias("style"))
    points = turns.select("conv_id", (F.col("turn") * 61).alias("position")).distinct()
    return lookup.style_at(points, runs, "conv_id", "style")


@query(
    "style_inherit",
    """WITH RECURSIVE s AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey % 10 <> 1 THEN p_partkey - 1 END AS based_on, CASE WHEN p_size % 4 = 0 THEN p_size END AS level, CASE WHEN p_size % 6 = 0 THEN p_brand END AS font FROM part),
u(style_id, up, level, font, n) AS (SELECT style_id, based_on, level, font, 0 FROM s UNION ALL SELECT u.style_id, s.based_on, coalesce(u.level, s.level), coalesce(u.font, s.font), n + 1 FROM u JOIN s ON s.style_id = u.up)
SELECT style_id, max(level) AS level, max(font) AS font FROM (SELECT style_id, level, font, n, max(n) OVER (PARTITION BY style_id) AS deepest FROM u) WHERE n = deepest GROUP BY style_id""",
)
def style_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-INHERIT: fields from the nearest style up the chain."""
    key = F.col("p_partkey")
    styles = table(spark, sf_dir, "part").select(key.alias("style_id"), F.when(key % 10 != 1, key - 1).alias("based_on"), F.when(F.col("p_size") % 4 == 0, F.col("p_size")).alias("level"), F.when(F.col("p_size") % 6 == 0, F.col("p_brand")).alias("font"))
    return lookup.inherit(styles, ["level", "font"])


@query(
    "edit_chain",
    """SELECT CAST(user_id % 50 AS BIGINT) AS file_id, CAST(event_id % 97 AS BIGINT) AS persist_id, arg_min(value, 1000000 - event_id) AS "offset" FROM events GROUP BY ALL""",
)
def edit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-EDITCHAIN: of all edits of an object the newest counts."""
    edits = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("file_id"), (F.col("event_id") % 97).alias("persist_id"), F.col("event_id").alias("edit_id"), F.col("value").alias("offset"))
    depth = edits.select("edit_id", (1000000 - F.col("edit_id")).alias("depth"))
    keyed = edits.withColumn("key", F.struct("file_id", "persist_id"))
    return lookup.newest_first(depth, keyed, "key").select("key.file_id", "key.persist_id", "offset")


@query(
    "distinct_warnings",
    "SELECT user_id, event_type AS code, min(event_id) AS first, count(*) AS times FROM events GROUP BY ALL",
)
def distinct_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-WARN-DISTINCT, ST-DISTINCT: each warning of a file once."""
    warned = table(spark, sf_dir, "events")
    return warned.groupBy("user_id", F.col("event_type").alias("code")).agg(F.min("event_id").alias("first"), F.count("*").alias("times"))


@query("strict_strings", "SELECT c_custkey, c_name AS value FROM customer")
def strict_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-SST-STRICT: every cell's shared string by its index; an index without an entry fails the query."""
    names = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("file_id"), "c_custkey", "c_name")
    entries = lookup.dictionary(names, ["file_id"], "c_name")
    cells = names.join(entries.withColumnRenamed("value", "c_name"), ["file_id", "c_name"]).select("file_id", "c_custkey", "index")
    return lookup.resolve(cells, entries, ["file_id"], "index", missing=None).select("c_custkey", "value")
