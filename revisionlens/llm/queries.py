"""The registered queries of this subpackage and their DuckDB SQL.

Each query derives its columns from the operator's real outputs, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisionlens.llm import decontam, htmltext, kneserney, licenses, linededup, mixing, neardup, prefixtrie, rules, simhash, tokenalign, tokens, urls
from revisionlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


@query("op1_near_duplicates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_line_dedup", r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, coalesce(c.last <> k.doc_id, false) AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


@query("op5_mix_sources", r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
           / (CASE WHEN quality >= 1 THEN 2.0 WHEN quality <= 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS stop FROM s0),
s2 AS (SELECT *, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s1 WINDOW o AS (ORDER BY stop / w, source NULLS LAST)),
s3 AS (SELECT arg_min(level, place) AS level FROM s2 WHERE stop / w >= level),
s AS (SELECT source, source_size, least(stop, (SELECT level FROM s3) * w) AS target FROM s2),
e AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
f AS (
  SELECT *, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM e)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN prefix + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM f""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_decontaminate", r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item_id, l, array_to_string(w[j:j + l - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT doc_id, l, j, array_to_string(w[j:j + l - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS j FROM t, (SELECT DISTINCT l FROM v) WHERE len(w) >= l)),
m AS (SELECT g.doc_id, g.j, g.l, v.item_id FROM g JOIN v ON g.l = v.l AND g.phrase = v.phrase),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + l)) AS pos FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), "contaminated")


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


@query("op2_token_ids")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(table(spark, sf_dir, "documents"))


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query("op8_kneser_ney_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


@query("op12_simhash_groups")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op13_align_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align_tokens(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", r"""
WITH RECURSIVE t AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1))) AS b
  FROM (SELECT DISTINCT conv_id FROM t)),
h AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, b), lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 9 AS h
  FROM bits),
r AS (
  SELECT h.conv_id, t.pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
s AS (
  SELECT h.conv_id, coalesce(q.turns, []) AS turns, coalesce(q.size, []) AS size
  FROM h LEFT JOIN (SELECT conv_id, list(sha256(role || chr(0) || text) ORDER BY pos) AS turns, list(strlen(text) ORDER BY pos) AS size FROM r GROUP BY conv_id) q USING (conv_id)),
p AS (SELECT conv_id, len(turns) AS total, d, array_to_string(turns[1:d], ',') AS key, CASE WHEN d > 0 THEN array_to_string(turns[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN size[d] ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (
  SELECT d, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = d), '')) AS ends_sha256
  FROM p GROUP BY d, key),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
a AS (
  SELECT d AS top_d, key AS top, d, key, up, saved, n_children FROM m
  UNION ALL SELECT m.d, m.key, a.d, a.key, m.up, a.saved, a.n_children FROM a JOIN m ON m.d = a.top_d - 1 AND m.key = a.up),
u AS (SELECT top_d AS d, top AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, v.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (d, key) LEFT JOIN n v ON v.d = m.d - 1 AND v.key = m.up""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))
