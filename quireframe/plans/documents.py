"""Queries of documents as blocks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import text as T
from quireframe.operators import documents, revisions
from quireframe.plans.registry import query, table

CLEAN = r"trim(regexp_replace(regexp_replace(translate(text, chr(7) || chr(11) || chr(13), '|' || chr(10) || chr(10)), '[\x{1}-\x{8}\x{c}\x{e}-\x{1f}\x{7f}]', '', 'g'), '[ \t]+', ' ', 'g'))"
LINES_SQL = rf"""l AS (SELECT doc_id, list_filter(list_transform(string_split({CLEAN}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
p AS (SELECT doc_id, CAST(i - 1 AS INT) AS ord, p[i] AS text FROM l, unnest(range(1, len(p) + 1)) AS t(i))"""
ROLE_SQL = r"""CASE WHEN ord = 0 AND length(regexp_replace(text, '\s+', '', 'g')) <= 24 THEN 'title'
  WHEN length(regexp_replace(text, '\s+', '', 'g')) BETWEEN 1 AND 18 AND NOT regexp_matches(text, '[|:\x{ff1a}]') AND NOT regexp_matches(text, '[0-9]{4,}') THEN 'heading' ELSE 'body' END"""


ORDERED_SQL = r"^\s*(?:\(?[0-9A-Za-z]{1,3}\)?[.)、？]|[（(][一二三四五六七八九十]{1,3}[）)])\s+(.+)$"
BULLETED_SQL = r"^\s*[•●○■◆*-]\s+(.+)$"


@query("paragraphs", f"WITH {LINES_SQL} SELECT doc_id, ord, text FROM p")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-NORMTEXT, PRJ-PARAS: the paragraphs of documents."""
    return documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("paragraph_roles", f"WITH {LINES_SQL} SELECT doc_id, ord, {ROLE_SQL} AS role FROM p")
def paragraph_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-ROLE, PRJ-OUTLINE, PRJ-TITLE: title, heading or body."""
    p = documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select("doc_id", "ord", T.role(F.col("text"), F.col("ord")).alias("role"))


@query(
    "list_lines",
    rf"""WITH {LINES_SQL}, k AS (SELECT doc_id, ord, text, CASE ord % 4 WHEN 0 THEN (ord + 1) || '. ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '(a) ' || text ELSE text || '|x' END AS line FROM p)
SELECT doc_id, ord, CASE WHEN regexp_matches(line, '{ORDERED_SQL}') THEN 'ordered' WHEN regexp_matches(line, '{BULLETED_SQL}') THEN 'bulleted' END AS kind,
  CASE WHEN regexp_matches(line, '{ORDERED_SQL}') THEN regexp_extract(line, '{ORDERED_SQL}', 1) WHEN regexp_matches(line, '{BULLETED_SQL}') THEN regexp_extract(line, '{BULLETED_SQL}', 1) END AS item,
  len(list_filter(string_split(line, '|'), lambda c: trim(c) <> '')) >= 2 AS is_table FROM k""",
)
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-LISTLINE, FN-TABLELINE: list marks before some paragraphs, bars after others."""
    p, n = documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text"), F.col("ord")
    line = F.when(n % 4 == 0, F.concat(n + 1, F.lit(". "), "text")).when(n % 4 == 1, F.concat(F.lit("- "), "text")).when(n % 4 == 2, F.concat(F.lit("(a) "), "text")).otherwise(F.concat("text", F.lit("|x")))
    marked = p.select("doc_id", "ord", line.alias("line"))
    return marked.select("doc_id", "ord", T.list_kind(F.col("line")).alias("kind"), T.list_text(F.col("line")).alias("item"), T.is_table_line(F.col("line")).alias("is_table"))


@query(
    "document_stats",
    rf"""WITH {LINES_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (len(list_filter(string_split(text, '|'), lambda c: trim(c) <> '')) >= 2) AS t, sum(length(text)) AS c, count(*) FILTER (({ROLE_SQL}) <> 'body') AS o FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS paragraphs, CAST(coalesce(t, 0) AS INT) AS table_rows, CAST(coalesce(c, 0) AS BIGINT) AS text_length, CAST(coalesce(o, 0) AS INT) AS outline_items FROM documents d LEFT JOIN s USING (doc_id)""",
)
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-WORDSTATS."""
    return documents.statistics(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "document_profile",
    rf"""WITH {LINES_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (len(list_filter(string_split(text, '|'), lambda c: trim(c) <> '')) >= 2) AS t, sum(length(text)) AS c, count(*) FILTER (({ROLE_SQL}) <> 'body') AS o FROM p GROUP BY doc_id),
w AS (SELECT source, CAST(sum(n + 4 * t + ceil(c / 2000.0)) AS BIGINT) AS weight, CAST(sum(o) AS BIGINT) AS items FROM documents JOIN s USING (doc_id) GROUP BY source)
SELECT source, weight, items, CASE WHEN items > 200 THEN 'virtual' ELSE 'normal' END AS outline_mode, CASE WHEN weight >= 3000 THEN 'windowed' ELSE 'normal' END AS page_mode FROM w""",
)
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-WORDWEIGHT, AG-WORDPROFILE: how heavy each source's documents are to show."""
    docs = table(spark, sf_dir, "documents")
    stats = documents.statistics(docs.withColumn("key", F.struct("doc_id", "source")), "key", "text")
    zero = F.lit(0)
    weight = documents.render_weight(F.col("paragraphs"), F.col("table_rows"), zero, zero, F.col("text_length"))
    sums = stats.groupBy("key.source").agg(F.sum(weight).alias("weight"), F.sum("outline_items").cast("long").alias("items"))
    outline_mode, page_mode = documents.profile(F.col("weight"), F.col("items"), zero)
    return sums.select("source", "weight", "items", outline_mode.alias("outline_mode"), page_mode.alias("page_mode"))


ITEMS_SQL = "i AS (SELECT user_id AS book, event_id AS id, ts, CAST(event_id * 7 % 11 % 5 AS INT) AS level, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ord FROM events)"


def outline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as headings of a book for each user, levels 0 to 4."""
    from pyspark.sql.window import Window

    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("id"), (F.col("event_id") * 7 % 11 % 5).cast("int").alias("level"), ord_.alias("ord"))


@query(
    "outline_tree",
    f"""WITH {ITEMS_SQL} SELECT a.book, a.id, a.level, a.ord, (SELECT arg_max(b.id, b.ord) FROM i b WHERE b.book = a.book AND b.ord < a.ord AND b.level < a.level) AS parent_id FROM i a""",
)
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-OUTLINE, QR-OUTLINE: the parent of each heading."""
    return documents.outline(outline_items(spark, sf_dir), "book").select("book", "id", "level", "ord", "parent_id")


@query(
    "outline_rows",
    f"""WITH {ITEMS_SQL}, t AS (SELECT a.book, a.id, a.ord, (SELECT arg_max(b.id, b.ord) FROM i b WHERE b.book = a.book AND b.ord < a.ord AND b.level < a.level) AS parent_id FROM i a),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY book, parent_id ORDER BY ord) AS INT) AS sibling_index, CAST(count(*) OVER (PARTITION BY book, parent_id) AS INT) AS sibling_count FROM t)
SELECT book, id, parent_id, sibling_index, sibling_count, sibling_index < sibling_count AS has_next FROM s""",
)
def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-FLATTENTREE: place among siblings."""
    tree = documents.outline(outline_items(spark, sf_dir), "book")
    return documents.outline_rows(tree, "book").select("book", "id", "parent_id", "sibling_index", "sibling_count", "has_next")


@query(
    "list_numbering",
    f"""WITH {ITEMS_SQL}, k AS (SELECT a.book, a.id, a.level, a.ord, CAST(x AS INT) AS l FROM i a, unnest(range(0, a.level + 1)) AS t(x)),
s AS (SELECT k.*, coalesce((SELECT max(c.ord) FROM i c WHERE c.book = k.book AND c.ord <= k.ord AND c.level < k.l), 0) AS since FROM k),
n AS (SELECT s.*, greatest(1, (SELECT count(*) FROM i b WHERE b.book = s.book AND b.ord <= s.ord AND b.ord >= s.since AND b.level = s.l)) AS c FROM s)
SELECT book, id, level, string_agg(c, '.' ORDER BY l) AS counters FROM n GROUP BY book, id, level""",
)
def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-NUMBERING: multi-level list numbers."""
    numbered = documents.numbering(outline_items(spark, sf_dir), "book")
    return numbered.select("book", "id", "level", F.array_join(F.transform("counters", lambda c: c.cast("string")), ".").alias("counters"))


# Roman numerals of ones, tens and hundreds.
ROMAN_SQL = """['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]"""


@query(
    "counter_texts",
    f"""WITH n AS (SELECT p_partkey, p_partkey % 999 + 1 AS n FROM part) SELECT p_partkey, {ROMAN_SQL} AS roman,
  CASE WHEN n >= 100 THEN ['一', '二', '三', '四', '五', '六', '七', '八', '九'][n // 100] || '百' ELSE '' END ||
  CASE WHEN n // 10 % 10 = 0 THEN CASE WHEN n >= 100 AND n % 10 > 0 THEN '零' ELSE '' END WHEN n < 20 THEN '十' ELSE ['一', '二', '三', '四', '五', '六', '七', '八', '九'][n // 10 % 10] || '十' END ||
  CASE WHEN n % 10 > 0 THEN ['一', '二', '三', '四', '五', '六', '七', '八', '九'][n % 10] ELSE '' END AS chinese FROM n""",
)
def counter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-ROMAN, FN-CHINESE: counters in words."""
    n = F.col("p_partkey") % 999 + 1
    return table(spark, sf_dir, "part").select("p_partkey", T.roman(n).alias("roman"), T.chinese(n).alias("chinese"))


@query(
    "document_chunks",
    f"""WITH RECURSIVE {LINES_SQL}, z AS (SELECT doc_id, ord, 2 * greatest(1, length(text)) AS b FROM p),
f(doc_id, ord, used, chunk) AS (SELECT doc_id, ord, b, CAST(0 AS INT) FROM z WHERE ord = 0
  UNION ALL SELECT z.doc_id, z.ord, CASE WHEN f.used + b > 2048 THEN b ELSE f.used + b END, CASE WHEN f.used + b > 2048 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN z ON z.doc_id = f.doc_id AND z.ord = f.ord + 1)
SELECT doc_id, ord, chunk FROM f""",
)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-CHUNK, AG-BATCHBYTES: paragraphs in batches of at most 2 KiB."""
    return documents.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 2048)


HEIGHT_SQL = r"""greatest(18.0::DOUBLE, CASE WHEN (length(text) - length(h)) + 0.55::DOUBLE * length(h) <= cap THEN 1 ELSE 1 + ceil(((length(text) - length(h)) + 0.55::DOUBLE * length(h) - cap) / cap) END * font * high + aft)"""


@query(
    "document_pages",
    rf"""WITH RECURSIVE {LINES_SQL}, r AS (SELECT doc_id, ord, text, {ROLE_SQL} AS role, regexp_replace(text, '[\x{{4e00}}-\x{{9fa5}}]', '', 'g') AS h FROM p),
t AS (SELECT *, CASE role WHEN 'title' THEN 22.0 WHEN 'heading' THEN 16.0 ELSE 14.0 END::DOUBLE AS font, CASE role WHEN 'title' THEN 1.45 WHEN 'heading' THEN 1.65 ELSE 1.8 END::DOUBLE AS high, CASE role WHEN 'title' THEN 18.0 WHEN 'heading' THEN 14.0 ELSE 12.0 END::DOUBLE AS aft FROM r),
z AS (SELECT doc_id, ord, role, {HEIGHT_SQL} AS b FROM (SELECT *, greatest(8, floor(554.0::DOUBLE / (font * 0.95::DOUBLE))) AS cap FROM t)),
f(doc_id, ord, role, b, used, page) AS (SELECT doc_id, ord, role, b, b, CAST(0 AS INT) FROM z WHERE ord = 0
  UNION ALL SELECT z.doc_id, z.ord, z.role, z.b, CASE WHEN f.used + z.b > 931 THEN z.b ELSE f.used + z.b END, CASE WHEN f.used + z.b > 931 THEN f.page + 1 ELSE f.page END FROM f JOIN z ON z.doc_id = f.doc_id AND z.ord = f.ord + 1)
SELECT doc_id, ord, role, round(b, 4) AS height, page FROM f""",
)
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGINATE-DOC, FN-PARAHEIGHT, FN-LINECOUNT, QR-PAGES: paragraphs on pages by estimated heights."""
    return documents.pages(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "page_breaks",
    """SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS page
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""",
)
def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGEBREAK: events as blocks, errors begin pages."""
    found = documents.page_breaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return found.select("user_id", "event_id", "page")


@query(
    "adjacent_merge",
    """WITH a AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS INT) AS run, min(event_id) AS first, count(*) AS rows, min(event_type) AS event_type, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id) AS text FROM r GROUP BY user_id, run""",
)
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-CUMSTYLE: neighbours of one type as one."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("text"))
    return documents.merge_adjacent(events, "user_id", "event_id", "event_type", "text")


@query(
    "vertical_spans",
    """WITH c AS (SELECT o_custkey AS grid, o_orderkey AS id, o_orderkey % 5 = 0 AS restart, o_orderkey % 5 IN (1, 2) AS goes_on FROM orders),
i AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY grid ORDER BY id ROWS UNBOUNDED PRECEDING) AS island FROM c),
w AS (SELECT *, bool_or(restart) OVER (PARTITION BY grid, island) AS whole, count(*) OVER (PARTITION BY grid, island) AS n FROM i)
SELECT grid, id, CAST(CASE WHEN whole THEN n ELSE 1 END AS INT) AS row_span FROM w WHERE NOT (goes_on AND whole)""",
)
def vertical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-VMERGE: cells that go on extend the restart above them."""
    key = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grid"), key.alias("id"))
    return documents.vertical_spans(cells, ["grid"], "id", F.col("id") % 5 == 0, (F.col("id") % 5).isin(1, 2))


@query(
    "dominant_value",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, first(event_type ORDER BY n DESC, f) AS event_type, max(n) AS rows FROM c GROUP BY user_id""",
)
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-DOMINANT: the most frequent value, of equal ones the first seen."""
    return documents.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    "revision_upsert",
    """WITH c AS (SELECT user_id AS key, event_id AS revision, value FROM events WHERE event_id % 3 <> 0), n AS (SELECT user_id AS key, event_id AS revision, value FROM events WHERE event_id % 3 = 0),
a AS (SELECT key, max(revision) AS revision, arg_max(value, revision) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY key) SELECT key, revision, value FROM a""",
)
def revision_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CA-REV, SM-STALE, SM-TWOREV: changes applied to what is newer than they are not."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), "value")
    return revisions.upsert(rows.where("revision % 3 <> 0"), rows.where("revision % 3 = 0"), ["key"])


@query(
    "block_pages",
    "SELECT user_id % 97 AS block_id, max(event_id) AS revision, arg_max(CAST(floor(value) AS BIGINT) % 60, event_id) AS page FROM events GROUP BY ALL",
)
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-BLOCKPAGE: the page of each block by its latest revision."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("block_id"), F.col("event_id").alias("revision"), (F.col("value").cast("long") % 60).alias("page"))
    return revisions.newest(rows, ["block_id"])
