"""The queries of this subpackage: one per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.llm import embeddings, html, licenses, pii, toxicity, warc
from quireframe.llm.audio import audio_round_trip
from quireframe.llm.common import Cut, table
from quireframe.llm.dialogues import repair
from quireframe.llm.merkle import manifest
from quireframe.llm.mixing import mix, tempered
from quireframe.llm.packing import pack
from quireframe.llm.simhash import near_duplicates
from quireframe.llm.topk import top_k

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    """The tokenizer that the queries take; the operators have it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Cut(spark)(pii.candidates(docs).select(F.struct("row.doc_id").alias("row"), "found"), "found")
    return pii.digest(found, pii.train(found))


@query
def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_round_trip(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index, counted = toxicity.fit_and_count(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index) if counted is None else toxicity.score_counted(counted, index)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights: the square root of each source's rows, in whole thousandths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, tempered(docs))


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


@query
def op13_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_matches, licenses): the matches of each document as name:start:end:coverage, joined by commas."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], F.format_number(m["coverage"], 4)))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(shown, ",").alias("licenses"))


# Each character of base 32 is five bits of the hexadecimal digest, which lie in two of its digits.
ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last, [position(c IN '0123456789abcdef') - 1 FOR c IN string_split(sha1(html), '')] AS h FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((h[5 * i // 4 + 1] * 16 + h[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) % 32 + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d"""

# The test pages all have one article element of paragraphs and a heading.
ORACLES["op1_html"] = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, [regexp_replace(part, '<[^>]*>', ' ', 'g') FOR part IN parts] AS parts FROM a),
c AS (SELECT page_id, url, [replace(replace(replace(replace(part, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') FOR part IN parts] AS parts FROM b),
d AS (SELECT page_id, url, list_filter([trim(regexp_replace(part, '\s+', ' ', 'g')) FOR part IN parts], lambda x: x <> '') AS parts FROM c)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, length(array_to_string(parts, chr(10) || chr(10))) AS n_chars FROM d"""

ORACLES["op8_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.9),
r(id, component) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.component FROM r JOIN l ON l.a = r.id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(component) AS component_id, v.vec_id = min(component) AS kept FROM v JOIN r ON r.id = v.vec_id GROUP BY v.vec_id"""

# CRC-32 by bits. A node's path has its left and right siblings at each level, and a fold goes through it.
ORACLES["op12_merkle"] = """
WITH RECURSIVE c AS (SELECT *, list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v // 2, 3988292384 * (v % 2)))) AS crc FROM documents),
f AS (SELECT doc_id, source, [coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS v,
    [coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN [CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END]] AS w FROM c),
d AS (SELECT doc_id, source, sha256(array_to_string(v, '')) AS leaf, sha256(array_to_string(v[:4] || w, '')) AS shown FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
a(source, level, pos, n, digest) AS (SELECT source, 0, pos, n, leaf FROM p UNION ALL SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY source, level, pos // 3, n),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b(level, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM s UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY level, pos // 3, n),
e AS (SELECT source, level, pos, n, digest FROM a UNION ALL SELECT NULL, 1000 + level, pos, n, digest FROM b),
g AS (SELECT x.source, x.level, x.pos, string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos) AS l, string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos) AS r
    FROM e x JOIN e y ON x.source IS NOT DISTINCT FROM y.source AND x.level = y.level AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL),
h AS (SELECT p.doc_id, p.source, p.pos, p.leaf, p.shown, s.subroot, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY level) FILTER (level IS NOT NULL) AS path
    FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN g ON level < 1000 AND g.source IS NOT DISTINCT FROM p.source AND g.pos = p.pos // CAST(pow(3, level) AS BIGINT)
      OR level >= 1000 AND g.pos = s.pos // CAST(pow(3, level - 1000) AS BIGINT) GROUP BY ALL),
k AS (SELECT *, (SELECT digest FROM b WHERE n = 1) AS root, list_reduce(list_prepend(shown, coalesce(path, [])), lambda t, x: sha256(split_part(x, '|', 1) || t || split_part(x, '|', 2))) AS folded_root FROM h)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM k"""

# v has the best {c: cost, a: audit, o: repaired rows} for the grammar's states (nothing, after s, u, a) from row i on.
ORACLES["op13_dialogues"] = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v // 2, 3988292384 * (v % 2)))), 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r(conv_id, i, v) AS (
  SELECT conv_id, n, [{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}, {'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}, {'c': 5, 'a': 'I', 'o': ['assistant:']}, {'c': 0, 'a': '', 'o': []}] FROM n
  UNION ALL
  SELECT conv_id, i - 1, [list_min([x, CASE WHEN q <> 2 THEN {'c': 5 + w[3].c, 'a': 'I' || w[3].a, 'o': list_prepend('user:', w[3].o)} ELSE x END]) FOR x, q IN w] FROM (
    SELECT conv_id, i, [list_min([x, CASE q WHEN 3 THEN {'c': 5 + u[4].c, 'a': 'I' || u[4].a, 'o': list_prepend('assistant:', u[4].o)} WHEN 4 THEN {'c': 5 + u[3].c, 'a': 'I' || u[3].a, 'o': list_prepend('user:', u[3].o)} ELSE x END]) FOR x, q IN u] AS w FROM (
      SELECT r.conv_id, r.i, [list_min([{'c': 2 + v[q].c, 'a': 'D' || v[q].a, 'o': v[q].o},
        CASE WHEN fault IN ('blank', 'duplicate') THEN {'c': 2 + v[q].c, 'a': 'D' || v[q].a, 'o': v[q].o}
          WHEN q = 3 THEN {'c': 1 + e + v[4].c, 'a': 'R' || v[4].a, 'o': list_prepend('assistant:' || text, v[4].o)} ELSE {'c': 1 + e + v[3].c, 'a': 'R' || v[3].a, 'o': list_prepend('user:' || text, v[3].o)} END,
        CASE WHEN fault IN ('blank', 'duplicate') OR t = 0 THEN {'c': 2 + v[q].c, 'a': 'D' || v[q].a, 'o': v[q].o} ELSE {'c': e + v[t].c, 'a': 'K' || v[t].a, 'o': list_prepend(role || ':' || text, v[t].o)} END]) FOR t, q IN ts] AS u
      FROM r JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS e, CASE c WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS g FROM f) f
        ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i, LATERAL (SELECT g AS ts)))),
z AS (SELECT conv_id, v[1] AS z FROM r WHERE i = 0)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(z.c, 0) AS BIGINT) AS cost,
  coalesce(z.a, '') AS audit, sha256(coalesce(array_to_string(z.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES["op11_topk"] = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_dot_product(q.e, c.e), 0) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.i ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.i <> c.i AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM s WHERE rank <= 5"""
