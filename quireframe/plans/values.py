"""Queries of the scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import a1, chart, fields, numbers, units
from quireframe.functions import text as T
from quireframe.plans.registry import query, table


@query(
    "a1_functions",
    """WITH n AS (SELECT p_partkey AS k, CAST(p_partkey % 18278 + 1 AS INT) AS i FROM part),
l AS (SELECT k, i, CASE WHEN i <= 26 THEN chr(64 + i) WHEN i <= 702 THEN chr(65 + (i - 27) // 26) || chr(65 + (i - 27) % 26) ELSE chr(65 + (i - 703) // 676) || chr(65 + (i - 703) // 26 % 26) || chr(65 + (i - 703) % 26) END AS label FROM n)
SELECT k, label, i AS column_index, '$' || label || '$' || k || ':' || label || (k + 5) AS range_text, CAST(k AS INT) AS start_row, i AS start_column, CAST(k + 5 AS INT) AS end_row, i AS end_column FROM l""",
)
def a1_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-COL2IDX, FN-IDX2COL, FN-PARSEREF, FN-PARSERANGE, FN-MKREF: letters and references, there and back."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), a1.column_label((F.col("p_partkey") % 18278 + 1).cast("int")).alias("label"))
    parts = parts.withColumn("range_text", F.concat(F.lit("$"), "label", F.lit("$"), "k", F.lit(":"), "label", F.col("k") + 5))
    r = a1.parse_range(F.col("range_text"))
    return parts.select("k", "label", a1.column_index(F.col("label")).alias("column_index"), "range_text", *[r[c].alias(c) for c in ("start_row", "start_column", "end_row", "end_column")])


MONEY, FORMATS = "$#,##0.00_);($#,##0.00)", ["#,##0", "0.00", "0%", "General"]


@query(
    "number_format",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '($' || format('{:,.2f}', -c_acctbal) || ')' ELSE '$' || format('{:,.2f}', c_acctbal) END AS money,
  regexp_replace(CAST(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(38, 12)) AS VARCHAR), '\\.?0+$', '') AS plain,
  CAST(CAST(round(CAST(c_acctbal AS DECIMAL(28, 12)) * 100, 1) AS DECIMAL(38, 1)) AS VARCHAR) || '%' AS percent,
  CASE c_nationkey % 4 WHEN 0 THEN CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,}', CAST(round(CAST(abs(c_acctbal) AS DECIMAL(38, 12)), 0) AS BIGINT))
    WHEN 1 THEN CAST(CAST(c_acctbal AS DECIMAL(38, 2)) AS VARCHAR) WHEN 2 THEN CAST(CAST(round(CAST(c_acctbal AS DECIMAL(28, 12)) * 100, 0) AS BIGINT) AS VARCHAR) || '%'
    ELSE regexp_replace(CAST(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(38, 12)) AS VARCHAR), '\\.?0+$', '') END AS by_row FROM customer""",
)
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-FMT, FN-FMT-GENERAL, FN-FMT-BUILTIN: balances in several formats, one of them by row."""
    x = F.col("c_acctbal")
    fmt = F.element_at(F.array(*map(F.lit, FORMATS)), F.col("c_nationkey") % 4 + 1)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", numbers.display(x, MONEY).alias("money"), numbers.display(x, "General").alias("plain"), numbers.display(x, "0.0%").alias("percent"), numbers.display_by(x, fmt, FORMATS).alias("by_row")
    )


@query(
    "fraction_format",
    """WITH p AS (SELECT p_partkey, p_size / 8.0::DOUBLE AS x FROM part), f AS (SELECT p_partkey, x, floor(x) AS w, x - floor(x) AS r FROM p),
c AS (SELECT p_partkey, w, d, floor(r * d + 0.5) AS n, abs(r - floor(r * d + 0.5) / d) AS e FROM f, unnest(range(1, 10)) AS t(d)),
b AS (SELECT p_partkey, w, first(d ORDER BY e, d) AS d, first(n ORDER BY e, d) AS n FROM c GROUP BY p_partkey, w)
SELECT p_partkey, CASE WHEN n = 0 THEN CAST(CAST(w AS BIGINT) AS VARCHAR) ELSE CASE WHEN w <> 0 THEN CAST(CAST(w AS BIGINT) AS VARCHAR) || ' ' ELSE '' END || CAST(CAST(n AS BIGINT) AS VARCHAR) || '/' || d END AS shown FROM b""",
)
def fraction_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-FMT-FRACTION, TK-BESTFRACTION: eighths of part sizes as fractions of up to ninths."""
    return table(spark, sf_dir, "part").select("p_partkey", numbers.display(F.col("p_size") / F.lit(8.0), "# ?/?").alias("shown"))


@query(
    "serial_dates",
    """WITH s AS (SELECT o_orderkey, o_orderdate, date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE)) + 1 AS d, date_diff('day', DATE '1904-01-01', CAST(o_orderdate AS DATE)) AS d4,
  (hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)) / 86400.0::DOUBLE AS t FROM orders)
SELECT o_orderkey, round(d + t, 6) AS serial, round(d4 + t, 6) AS serial_1904, date_trunc('second', o_orderdate) AS back, date_trunc('second', o_orderdate) AS back_1904,
  strftime(o_orderdate, '%-d-%b-%y') AS short_date, strftime(o_orderdate, '%Y-%m-%d %I:%M %p') AS with_time, strftime(CAST(o_orderdate AS DATE), '%Y/%-m/%-d') AS chart_text FROM s""",
)
def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-SERIAL2TS, FN-SERIAL2TS-CHART, FN-FMTDATE, FN-ISDATE, FN-CHARTFMT: order dates as serials and back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", numbers.date_serial(F.col("o_orderdate")).alias("s"), numbers.date_serial(F.col("o_orderdate"), True).alias("s4"))
    s, s4 = F.col("s"), F.col("s4")
    return orders.select(
        "o_orderkey", F.round(s, 6).alias("serial"), F.round(s4, 6).alias("serial_1904"), numbers.serial_timestamp(s).alias("back"), numbers.serial_timestamp(s4, True).alias("back_1904"),
        numbers.display(s, "d-mmm-yy").alias("short_date"), numbers.display(s, "yyyy-mm-dd hh:mm AM/PM").alias("with_time"), numbers.chart_date(s, "yyyy/m/d").alias("chart_text"),
    )


@query(
    "exponent_format",
    """WITH e AS (SELECT o_orderkey, o_totalprice, CAST(floor((o_orderkey / 7.0::DOUBLE) * 86400 + 0.5) AS BIGINT) AS t FROM orders)
SELECT o_orderkey, regexp_replace(printf('%.2E', o_totalprice), 'E([+-])0(\\d)$', 'E\\1\\2') AS shown, CAST(t // 3600 AS VARCHAR) || format(':{:02d}:{:02d}', t % 3600 // 60, t % 60) AS elapsed FROM e""",
)
def exponent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-FMT exponents and elapsed times of more than a day."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", numbers.display(F.col("o_totalprice"), "0.00E+00").alias("shown"), numbers.display(F.col("o_orderkey") / F.lit(7.0), "[h]:mm:ss").alias("elapsed"))


@query(
    "unit_lengths",
    """SELECT p_partkey, p_size * 9525 * 96.0::DOUBLE / 914400 AS emu, p_size * 96.0::DOUBLE / 1440 AS twip, p_size * 96.0::DOUBLE / 72 AS point, p_size * 96.0::DOUBLE / 576 AS master,
  CAST(greatest(1, floor(p_size * 96.0::DOUBLE / 72 + 0.5)) AS INT) AS row_px, CAST(greatest(1, floor(floor(p_size / 4.0::DOUBLE * 256 + 18) / 256 * 7)) AS INT) AS column_px FROM part""",
)
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-UNITS, FN-COLWIDTH, FN-LINEHEIGHT: part sizes as lengths."""
    x = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", units.to_px(x * 9525, "emu").alias("emu"), units.to_px(x, "twip").alias("twip"), units.to_px(x, "point").alias("point"), units.to_px(x, "master").alias("master"),
        units.row_height_px(x).alias("row_px"), units.column_width_px(x / F.lit(4.0)).alias("column_px"),
    )


@query(
    "colour_tint",
    """WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey // 7 % 256 AS g, p_size * 5 AS b, (p_size - 25) / 32.0::DOUBLE AS t FROM part),
x AS (SELECT p_partkey, r, g, b, t, [CASE WHEN t < 0 THEN v * (1 + t) WHEN t > 0 THEN v + (255 - v) * t ELSE v END FOR v IN [r, g, b]] AS o FROM c)
SELECT p_partkey, format('#{:02x}{:02x}{:02x}', CAST(r AS INT), CAST(g AS INT), CAST(b AS INT)) AS base, format('#{:02x}{:02x}{:02x}', CAST(floor(o[1] + 0.5) AS INT), CAST(floor(o[2] + 0.5) AS INT), CAST(floor(o[3] + 0.5) AS INT)) AS tinted FROM x""",
)
def colour_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-COLOR-TINT, FN-COLOR-RGB: colours made darker and lighter."""
    base = units.colour(F.array(F.col("p_partkey") % 256, F.floor(F.col("p_partkey") / 7) % 256, F.col("p_size") * 5))
    parts = table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), ((F.col("p_size") - 25) / F.lit(32.0)).alias("t"))
    return parts.select("p_partkey", "base", units.tint(F.col("base"), F.col("t")).alias("tinted"))


@query(
    "chart_rules",
    """WITH p AS (SELECT p_partkey, p_size, p_retailprice AS x, p_partkey % 360 AS a FROM part)
SELECT p_partkey, (CASE WHEN x / 10.0::DOUBLE ** floor(log10(x)) <= 2 THEN 2 WHEN x / 10.0::DOUBLE ** floor(log10(x)) <= 5 THEN 5 ELSE 10 END) * 10.0::DOUBLE ** floor(log10(x)) AS axis_max,
  ((90 - a) % 360 + 360) % 360 AS start_angle, greatest(6.0::DOUBLE, least(42.0::DOUBLE, sqrt(p_size::DOUBLE) * 6)) AS bubble,
  CAST(greatest(6, least(46, floor(72 / (p_size % 5 + 1 - (p_size % 3) * 0.25::DOUBLE * (p_size % 5) + p_size / 100.0::DOUBLE) + 0.5))) AS INT) AS bar,
  greatest(0.0::DOUBLE, least(least(58.0::DOUBLE, p_size + 20) - 4, floor(p_size / (p_size + 20.0::DOUBLE) * least(58.0::DOUBLE, p_size + 20) + 0.5))) AS rose_inner FROM p""",
)
def chart_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-PIEANGLE, FN-BUBBLE, FN-BARWIDTH, FN-ROSE, AG-RADARMAX's scale."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", chart.nice_max(F.col("p_retailprice")).alias("axis_max"), chart.pie_start(F.col("p_partkey") % 360).alias("start_angle"), chart.bubble_size(size).alias("bubble"),
        chart.bar_width(size, size % 5 + 1, size % 3 * 25).alias("bar"), chart.rose_radius(size, size + F.lit(20.0))["inner"].alias("rose_inner"),
    )


@query(
    "text_measures",
    r"""WITH d AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\x{4e00}-\x{9fa5}]', '', 'g')) AS o, length(regexp_replace(text, '[\x{10000}-\x{10ffff}]', '', 'g')) AS b, length(regexp_replace(text, '[A-Za-z0-9]', '', 'g')) AS p FROM documents)
SELECT doc_id, round(CAST(n - o AS DOUBLE) + o * 0.55::DOUBLE, 4) AS weighted, CAST(n + n - b AS INT) AS utf16, CAST(n - p AS INT) AS plain_chars FROM d""",
)
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-WLEN and lengths in UTF-16 units of whole documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.weighted_length(t), 4).alias("weighted"), T.utf16_length(t).alias("utf16"), T.matches(t, "[A-Za-z0-9]").alias("plain_chars"))


@query(
    "decode_score",
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '\x{fffd}', '', 'g') AS t, length(text) AS n FROM documents), b AS (SELECT doc_id, -12.0::DOUBLE * (n - length(t)) AS s, t, regexp_replace(t, '[\x{1}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]', '', 'g') AS u FROM a),
c AS (SELECT doc_id, s - 3.0 * (length(t) - length(u)) AS s, u AS t, regexp_replace(u, '[A-Za-z0-9]', '', 'g') AS u FROM b), d AS (SELECT doc_id, s + 1.2 * (length(t) - length(u)) AS s, u AS t, regexp_replace(u, '\p{Han}', '', 'g') AS u FROM c),
e AS (SELECT doc_id, s + 3.5 * (length(t) - length(u)) AS s, u AS t, regexp_replace(u, '[\t\n\x{b}\f\r ]', '', 'g') AS u FROM d), f AS (SELECT doc_id, s + 0.2 * (length(t) - length(u)) AS s, u AS t, regexp_replace(u, '[.,:;!?()_/|-]', '', 'g') AS u FROM e)
SELECT doc_id, round(CAST(s + 0.5 * (length(t) - length(u)) + 0.3 * length(u) AS DOUBLE), 3) AS score FROM f""",
)
def decode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-SCORE: how well decoded the documents look."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.decode_score(F.col("text")), 3).alias("score"))


@query(
    "field_texts",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'to ' || c_name || '.' WHEN 1 THEN chr(8) || c_name WHEN 2 THEN c_mktsegment || c_name || '!' ELSE c_name END AS text FROM customer",
)
def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-FIELDS: fields with a result, with an anchor only, inside each other, and a text without any."""
    key, name, mark = F.col("c_custkey"), F.col("c_name"), lambda n: F.chr(F.lit(n))
    linked = F.concat(F.lit("to "), mark(19), F.lit(" LINK x "), mark(20), name, mark(21), F.lit("."))
    shape = F.concat(mark(19), F.lit(" SHAPE "), mark(8), mark(21), name)
    nested = F.concat(mark(19), F.lit(" IF "), mark(19), F.lit(" PAGE "), mark(20), F.lit("1"), mark(21), mark(20), F.col("c_mktsegment"), mark(19), F.lit(" REF "), mark(20), name, mark(21), mark(21), F.lit("!"))
    text = F.when(key % 4 == 0, linked).when(key % 4 == 1, shape).when(key % 4 == 2, nested).otherwise(name)
    return table(spark, sf_dir, "customer").select("c_custkey", T.field_results(text).alias("text"))


@query(
    "slide_fields",
    """WITH o AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 17 - 1 AS k, o_custkey % 2 = 1 AS zh, CASE WHEN hour(o_orderdate) < 12 THEN '上午' ELSE '下午' END AS half,
  list_extract(['星期日', '星期一', '星期二', '星期三', '星期四', '星期五', '星期六'], CAST(dayofweek(o_orderdate) + 1 AS INT)) AS wd FROM orders)
SELECT o_orderkey, CASE k WHEN -1 THEN CAST(o_orderkey AS VARCHAR) WHEN 14 THEN 'was' WHEN 15 THEN 'was'
  WHEN 0 THEN CASE WHEN zh THEN strftime(d, '%Y/%m/%d %H:%M') ELSE strftime(d, '%m/%d/%Y %H:%M') END WHEN 1 THEN CASE WHEN zh THEN strftime(d, '%Y/%m/%d') ELSE strftime(d, '%m/%d/%Y') END
  WHEN 2 THEN CASE WHEN zh THEN strftime(d, '%Y年%-m月%d日') || wd ELSE strftime(d, '%A, %B %d, %Y') END WHEN 3 THEN CASE WHEN zh THEN strftime(d, '%Y年%-m月%d日') ELSE strftime(d, '%d %B %Y') END
  WHEN 4 THEN CASE WHEN zh THEN strftime(d, '%Y年%-m月%d日') ELSE strftime(d, '%B %d, %Y') END WHEN 5 THEN CASE WHEN zh THEN strftime(d, '%d日-%-m月-%y年') ELSE strftime(d, '%d-%b-%y') END
  WHEN 6 THEN CASE WHEN zh THEN strftime(d, '%Y年%-m月') ELSE strftime(d, '%B %y') END WHEN 7 THEN CASE WHEN zh THEN strftime(d, '%y年%-m月') ELSE strftime(d, '%b-%y') END
  WHEN 8 THEN CASE WHEN zh THEN strftime(d, '%Y/%m/%d ') || half || strftime(d, '%I:%M') ELSE strftime(d, '%m/%d/%Y %I:%M %p') END
  WHEN 9 THEN CASE WHEN zh THEN strftime(d, '%Y/%m/%d ') || half || strftime(d, '%I:%M:%S') ELSE strftime(d, '%m/%d/%Y %I:%M:%S %p') END
  WHEN 10 THEN strftime(d, '%H:%M') WHEN 11 THEN strftime(d, '%H:%M:%S') WHEN 12 THEN CASE WHEN zh THEN half || strftime(d, '%I:%M') ELSE strftime(d, '%I:%M %p') END
  WHEN 13 THEN CASE WHEN zh THEN half || strftime(d, '%I:%M:%S') ELSE strftime(d, '%I:%M:%S %p') END END AS text FROM o""",
)
def slide_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-FIELDDATE: order dates as the fields of slides, in English and Chinese."""
    k = F.col("o_orderkey") % 17 - 1
    kind = F.when(k == -1, "slidenum").when(k == 0, "DateTime").when(k == 15, "other").when(k < 14, F.concat(F.lit("datetime"), k.cast("string")))
    shown = fields.slide_field(kind, F.lit("was"), F.col("o_orderkey"), F.col("o_orderdate"), F.when(F.col("o_custkey") % 2 == 1, "zh-CN").otherwise("en-US"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("text"))


@query(
    "best_decode",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '你好' WHEN 1 THEN c_name ELSE c_name || 'plain, text' END AS text FROM customer",
)
def best_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-DECODE, TK-BESTDECODE: bytes of an unknown code page, some GBK."""
    key, name = F.col("c_custkey"), F.encode("c_name", "UTF-8")
    raw = F.when(key % 3 == 0, F.concat(name, F.unhex(F.lit("C4E3BAC3")))).when(key % 3 == 1, name).otherwise(F.concat(name, F.encode(F.lit("plain, text"), "UTF-8")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.best_decoded(raw).alias("text"))


@query(
    "code_pages",
    """SELECT c_custkey, c_name || CASE c_custkey % 6 WHEN 0 THEN 'ÄãºÃ' WHEN 1 THEN '你好' WHEN 2 THEN '斕疑' WHEN 3 THEN 'ﾄ羲ﾃ' WHEN 4 THEN '콱봤' ELSE 'ÄãºÃ' END AS text,
  CASE WHEN c_custkey % 6 = 5 THEN 'code page 437 is read as 1252' END AS warning FROM customer""",
)
def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-CODEPAGE: the same bytes in several code pages."""
    page = F.element_at(F.array(*map(F.lit, (1252, 936, 950, 932, 949, 437))), (F.col("c_custkey") % 6 + 1).cast("int"))
    raw = F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("C4E3BAC3")))
    found = table(spark, sf_dir, "customer").select("c_custkey", T.decode_page(raw, page).alias("d"))
    return found.select("c_custkey", "d.text", "d.warning")


@query(
    "html_strip",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x{b}\f\r]+', ' ', 'g')) AS text FROM pages""",
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-STRIP-HTML: pages without their tags, by patterns."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(
    "html_escape",
    "SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS text FROM benchmark",
)
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-ESCAPE."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.escape_html(F.col("text")).alias("text"))


@query(
    "line_widths",
    r"""WITH a AS (SELECT conv_id, turn, text, regexp_replace(text, '[ \t\n\x{b}\f\r]', '', 'g') AS t FROM conversations), b AS (SELECT *, 0.25::DOUBLE * (length(text) - length(t)) AS s, regexp_replace(t, '[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}]', '', 'g') AS u FROM a),
c AS (SELECT *, s + 1.0 * (length(t) - length(u)) AS s1, regexp_replace(u, '[MW]', '', 'g') AS v FROM b), d AS (SELECT *, s1 + 0.9 * (length(u) - length(v)) AS s2, regexp_replace(v, '[CDGOQ]', '', 'g') AS w FROM c),
e AS (SELECT *, s2 + 0.75 * (length(v) - length(w)) AS s3, regexp_replace(w, '[PFLT]', '', 'g') AS x FROM d), f AS (SELECT *, s3 + 0.57 * (length(w) - length(x)) AS s4, regexp_replace(x, '[IJ]', '', 'g') AS y FROM e), g AS (SELECT *, s4 + 0.36 * (length(x) - length(y)) AS s5, regexp_replace(y, '[A-Z]', '', 'g') AS z FROM f)
SELECT conv_id, turn, round(CAST((s5 + 0.66 * (length(y) - length(z)) + 0.5 * length(z)) * 12 AS DOUBLE), 3) AS width FROM g""",
)
def line_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-TEXTWIDTH: estimated widths of the turns of conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(T.text_width(F.col("text"), F.lit(12.0)), 3).alias("width"))


@query(
    "json_properties",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(coalesce(json_extract(replace(replace(props, '"', '?quot;'), '?quot;', '"'), '$.k'), '0') AS BIGINT) AS repaired FROM events""",
)
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-JSONPROP: a property of JSON text, also where its quotes were written as ?quot;."""
    schema = "k long"
    read = lambda c: F.from_json(c, schema)["k"]
    spoilt = F.replace(F.col("props"), F.lit('"'), F.lit("?quot;"))
    repaired = F.coalesce(read(spoilt), read(F.replace(spoilt, F.lit("?quot;"), F.lit('"'))), F.lit(0).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", read(F.col("props")).alias("k"), repaired.alias("repaired"))


@query(
    "detect_kind",
    r"""WITH n AS (SELECT page_id, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '([^/]*)$', 1) AS name FROM pages),
k AS (SELECT page_id, name || CASE page_id % 5 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.xls' WHEN 2 THEN '.wps' WHEN 3 THEN '.pptx' ELSE '' END AS name FROM n)
SELECT page_id, name, CASE WHEN lower(name) LIKE '%.docx' THEN 'docx' WHEN lower(name) LIKE '%.xlsx' THEN 'xlsx' WHEN lower(name) LIKE '%.pptx' THEN 'pptx' WHEN lower(name) LIKE '%.doc' OR lower(name) LIKE '%.wps' THEN 'doc' WHEN lower(name) LIKE '%.xls' THEN 'xls' WHEN lower(name) LIKE '%.ppt' THEN 'ppt' END AS kind FROM k""",
)
def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-DETECT, SRC-NAME: the file name in a url and its kind by extension."""
    from quireframe.sources.names import file_name, kind_of

    more = F.element_at(F.array(*map(F.lit, (".DOCX", ".xls", ".wps", ".pptx", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(file_name(F.col("url")), more).alias("name"))
    return named.withColumn("kind", kind_of(F.col("name")))
