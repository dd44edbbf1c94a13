"""DuckDB SQL that states each operator's result directly (the correctness oracle).

These strings run on the pre-registered views of the given tables.  They
follow the plain definitions (all word pairs of a block, ranking windows,
outer joins) rather than the Spark plans, so an agreement checks the plans'
shortcuts too.  Doubles are rounded to 4 digits on both sides.
"""

from __future__ import annotations

from revisionlens.functions import constants as K


def with_(*ctes: tuple[str, str], select: str, recursive: bool = False) -> str:
    if recursive:
        return "WITH RECURSIVE" + with_(*ctes, select=select)[4:]
    body = ",\n".join(f"{n} AS (\n{q}\n)" for n, q in ctes)
    sel = select.lstrip()
    if sel[:5].upper() == "WITH ":          # the final query has CTEs of its own: one list
        return f"WITH {body},\n{sel[5:]}"
    return f"WITH {body}\n{select}"


def _lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SENT_RE = K.SENTENCE_PATTERN.replace("\n", "\\n")
TOKEN_RE = K.TOKEN_PATTERN


def sentence_array(text: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all(replace({text}, '</p><p>', chr(10)), "
            f"'{SENT_RE}'), lambda s: trim(s)), lambda s: s <> '')")


def tokens_of(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN_RE}')"


# ---------------------------------------------------------------- inputs
ARTICLES = ("articles", """
SELECT CAST(conv_id AS BIGINT) AS entry_id, CAST(turn AS INTEGER) AS version, text AS summary,
       'conversations' AS source
FROM conversations""")

SENTENCES = ("sentences", f"""
SELECT source, entry_id, version, CAST(u.i - 1 AS INTEGER) AS sent_idx, u.s AS sentence
FROM (SELECT source, entry_id, version, {sentence_array('summary')} AS arr FROM articles),
     unnest(arr) WITH ORDINALITY AS u(s, i)""")

REV_BASE = ("rev_base", f"""
SELECT doc_id AS entry_id, source, CAST(u.i - 1 AS INTEGER) AS i, u.s AS s
FROM (SELECT doc_id, source, {sentence_array('text')} AS arr FROM documents),
     unnest(arr) WITH ORDINALITY AS u(s, i)""")

REV_KEYED = ("rev_keyed", """
SELECT entry_id, source, 0 AS version, CAST(i AS DOUBLE) AS k, s AS sentence FROM rev_base
UNION ALL
SELECT entry_id, source, ver, CASE WHEN (i + entry_id) % 17 = 8 THEN i - 3.5 ELSE i END,
       CASE WHEN (i + entry_id) % 9 = 2 THEN 'Update ' || s ELSE s END
FROM rev_base, (VALUES (1), (2)) t(ver)
WHERE (i + entry_id) % 11 <> 4 AND NOT (ver = 2 AND (i + entry_id) % 13 = 6)
UNION ALL
SELECT entry_id, source, ver, i + 0.5, 'Added line ' || entry_id || ' ' || i || '.'
FROM rev_base, (VALUES (1), (2)) t(ver)
WHERE (i + entry_id) % 10 = 7""")

REV_SENTENCES = ("sentences", """
SELECT source, entry_id, CAST(version AS INTEGER) AS version,
       CAST(row_number() OVER (PARTITION BY entry_id, version ORDER BY k, sentence) - 1 AS INTEGER) AS sent_idx,
       sentence
FROM rev_keyed""")


def sentences_ctes(fixture: str) -> list[tuple[str, str]]:
    if fixture == "conversations":
        return [ARTICLES, SENTENCES]
    return [REV_BASE, REV_KEYED, REV_SENTENCES]


TOKENS = ("tokens", f"""
WITH t AS (
  SELECT source, entry_id, version, sent_idx, CAST(len(tk) AS BIGINT) AS num_words,
         CAST(u.p - 1 AS INTEGER) AS pos, u.t AS token
  FROM (SELECT *, {tokens_of('sentence')} AS tk FROM sentences),
       unnest(tk) WITH ORDINALITY AS u(t, p)),
o AS (
  SELECT source, entry_id, version, sent_idx,
         CAST(coalesce(sum(num_words) OVER (PARTITION BY source, entry_id, version ORDER BY sent_idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS off
  FROM (SELECT DISTINCT source, entry_id, version, sent_idx, num_words FROM t))
SELECT t.*, CAST(o.off + t.pos AS INTEGER) AS word_idx FROM t JOIN o USING (source, entry_id, version, sent_idx)""")

LEXICON = ("lexicon", f"""
WITH vocab AS (SELECT DISTINCT token FROM tokens),
tri AS (
  SELECT token, substr('<' || token || '>', r.pos, 3) AS tg
  FROM vocab, LATERAL (SELECT unnest(range(1, length('<' || token || '>') - 1)) AS pos) r
),
b AS (
  SELECT token, CAST(('0x' || substr(md5(tg), 1, 8)) AS BIGINT) % (SELECT max(vec_id) + 1 FROM embeddings) AS bucket FROM tri
),
e AS (
  SELECT vec_id AS bucket, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
dims AS (
  SELECT b.token, g.d, sum(e.e[g.d + 1]) AS v
  FROM b JOIN e USING (bucket), LATERAL (SELECT unnest(range(0, 64)) AS d) g
  GROUP BY b.token, g.d
),
vecs AS (SELECT token, list(v ORDER BY d) AS v FROM dims GROUP BY token)
SELECT token, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector
FROM vecs""")


def near_pairs_cte(cutoff: float | None) -> tuple[str, str]:
    """Distinct token pairs of consecutive versions under the cutoff (all pairs, then filter)."""
    if cutoff is None:
        return ("near", """
SELECT DISTINCT x.source, x.entry_id, x.version AS version_x, y.version AS version_y,
       x.token AS token_x, y.token AS token_y, 0.0::DOUBLE AS distance
FROM (SELECT DISTINCT source, entry_id, version, token FROM tokens) x
JOIN (SELECT DISTINCT source, entry_id, version, token FROM tokens) y
  ON x.source = y.source AND x.entry_id = y.entry_id AND y.version = x.version + 1 AND x.token = y.token""")
    return ("near", f"""
WITH v AS (SELECT DISTINCT t.source, t.entry_id, t.version, t.token, l.vector
           FROM tokens t JOIN lexicon l USING (token)),
p AS (
  SELECT x.source, x.entry_id, x.version AS version_x, y.version AS version_y,
         x.token AS token_x, y.token AS token_y,
         CASE WHEN x.token = y.token THEN 0.0 ELSE list_distance(x.vector, y.vector) END AS distance
  FROM v x JOIN v y ON x.source = y.source AND x.entry_id = y.entry_id AND y.version = x.version + 1
)
SELECT * FROM p WHERE distance < {cutoff}""")


WORD_PAIRS = ("word_pairs", """
SELECT n.source, n.entry_id, n.version_x, n.version_y,
       tx.sent_idx AS sent_idx_x, ty.sent_idx AS sent_idx_y,
       tx.word_idx AS word_idx_x, ty.word_idx AS word_idx_y, tx.num_words AS num_words_x, ty.num_words AS num_words_y,
       n.token_x, n.token_y, n.distance
FROM near n
JOIN tokens tx ON tx.source = n.source AND tx.entry_id = n.entry_id AND tx.version = n.version_x AND tx.token = n.token_x
JOIN tokens ty ON ty.source = n.source AND ty.entry_id = n.entry_id AND ty.version = n.version_y AND ty.token = n.token_y""")

PAIRK = "source, entry_id, version_x, version_y"


def m1_cte(side: str) -> tuple[str, str]:
    return (f"m1_{side}", f"""
SELECT {PAIRK}, sent_idx_x, sent_idx_y, word_idx_{side},
       min(num_words_{side}) AS num_words_total_list, min(distance) AS min_word_distance
FROM word_pairs GROUP BY {PAIRK}, sent_idx_x, sent_idx_y, word_idx_{side}""")


def m2_cte(side: str, cutoff: float) -> tuple[str, str]:
    return (f"m2_{side}", f"""
SELECT {PAIRK}, sent_idx_x, sent_idx_y,
       (sum(min_word_distance) + {cutoff} * (min(num_words_total_list) - count(*)))
         / min(num_words_total_list) AS avg_sentence_distance
FROM m1_{side} GROUP BY {PAIRK}, sent_idx_x, sent_idx_y""")


def m3_cte(side: str) -> tuple[str, str]:
    o = "y" if side == "x" else "x"
    return (f"m3_{side}", f"""
SELECT {PAIRK}, sent_idx_{side}, sent_idx_{o}, avg_sentence_distance FROM (
  SELECT *, row_number() OVER (PARTITION BY {PAIRK}, sent_idx_{side}
                               ORDER BY round(avg_sentence_distance, 6), sent_idx_{o}) AS rn
  FROM m2_{side}) WHERE rn = 1""")


def m4_cte(side: str, threshold: float, suffix: str = "") -> tuple[str, str]:
    o = "y" if side == "x" else "x"
    return (f"m4_{side}{suffix}", f"""
SELECT {PAIRK}, sent_idx_{side},
       CASE WHEN avg_sentence_distance < {threshold} THEN sent_idx_{o} END AS sent_idx_{o},
       CASE WHEN avg_sentence_distance < {threshold} THEN avg_sentence_distance END AS avg_sentence_distance_{side}
FROM m3_{side}""")


M5 = ("m5", f"""
SELECT coalesce(a.source, b.source) AS source, coalesce(a.entry_id, b.entry_id) AS entry_id,
       coalesce(a.version_x, b.version_x) AS version_x, coalesce(a.version_y, b.version_y) AS version_y,
       coalesce(a.sent_idx_x, b.sent_idx_x) AS sent_idx_x, coalesce(a.sent_idx_y, b.sent_idx_y) AS sent_idx_y,
       a.avg_sentence_distance_x, b.avg_sentence_distance_y
FROM m4_x a FULL OUTER JOIN m4_y b
  ON a.source = b.source AND a.entry_id = b.entry_id AND a.version_x = b.version_x
 AND a.version_y = b.version_y AND a.sent_idx_x = b.sent_idx_x AND a.sent_idx_y = b.sent_idx_y""")

PAIRS_PRESENT = ("pairs", """
SELECT DISTINCT a.source, a.entry_id, a.version AS version_x, a.version + 1 AS version_y
FROM (SELECT DISTINCT source, entry_id, version FROM sentences) a
JOIN (SELECT DISTINCT source, entry_id, version FROM sentences) b
  ON a.source = b.source AND a.entry_id = b.entry_id AND b.version = a.version + 1""")

M6 = ("m6", f"""
SELECT * FROM m5
UNION ALL
SELECT p.source, p.entry_id, p.version_x, p.version_y, s.sent_idx, NULL, NULL, NULL
FROM pairs p JOIN sentences s ON s.source = p.source AND s.entry_id = p.entry_id AND s.version = p.version_x
WHERE NOT EXISTS (SELECT 1 FROM m5 WHERE m5.source = p.source AND m5.entry_id = p.entry_id
                  AND m5.version_x = p.version_x AND m5.version_y = p.version_y AND m5.sent_idx_x = s.sent_idx)
UNION ALL
SELECT p.source, p.entry_id, p.version_x, p.version_y, NULL, s.sent_idx, NULL, NULL
FROM pairs p JOIN sentences s ON s.source = p.source AND s.entry_id = p.entry_id AND s.version = p.version_y
WHERE NOT EXISTS (SELECT 1 FROM m5 WHERE m5.source = p.source AND m5.entry_id = p.entry_id
                  AND m5.version_x = p.version_x AND m5.version_y = p.version_y AND m5.sent_idx_y = s.sent_idx)""")

ARC_SELECT = """SELECT source, entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
       round(avg_sentence_distance_x, 4) AS avg_sentence_distance_x,
       round(avg_sentence_distance_y, 4) AS avg_sentence_distance_y"""


def match_ctes(fixture: str = "conversations", cutoff: float = K.WORD_DISTANCE_CUTOFF,
               threshold: float = K.SENTENCE_SIM_THRESH, lexicon: bool = False) -> list[tuple[str, str]]:
    """CTEs up to ``m6`` (the completed arc table) for a fixture."""
    ctes = sentences_ctes(fixture) + [TOKENS]
    if lexicon:
        ctes.append(LEXICON)
    ctes += [near_pairs_cte(cutoff if lexicon else None), WORD_PAIRS]
    for s in ("x", "y"):
        ctes += [m1_cte(s), m2_cte(s, cutoff), m3_cte(s), m4_cte(s, threshold)]
    return ctes + [M5, PAIRS_PRESENT, M6]


def matched_sql(fixture: str = "conversations", cutoff: float = K.WORD_DISTANCE_CUTOFF,
                threshold: float = K.SENTENCE_SIM_THRESH, lexicon: bool = False) -> str:
    return with_(*match_ctes(fixture, cutoff, threshold, lexicon), select=f"{ARC_SELECT} FROM m6")


# ---------------------------------------------------------------- text helpers
def words_sql(s: str) -> str:
    return f"(CASE WHEN trim({s}) = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim({s}), '\\s+') END)"


def is_dateline_sql(s: str) -> str:
    w = words_sql(s)
    return (f"(len({w}) < {K.DATELINE_MAX_WORDS} AND "
            f"len(list_filter({w}, lambda w: upper(w) = w AND lower(w) <> w)) > 0)")


def boilerplate_sql(s: str) -> str:
    phrases = _lit_list(sorted({p.lower() for p in K.BOILERPLATE_PHRASES}))
    return f"list_bool_or(list_transform({phrases}, lambda p: instr(lower({s}), p) > 0))"


def template_sql(s: str) -> str:
    parts = [f"starts_with({s}, '{p.replace(chr(39), chr(39) * 2)}')" for p in K.TEMPLATE_STARTS_WITH]
    parts += [f"instr({s}, '{p.replace(chr(39), chr(39) * 2)}') > 0" for p in K.TEMPLATE_CONTAINS]
    parts += [f"ends_with({s}, '{p.replace(chr(39), chr(39) * 2)}')" for p in K.TEMPLATE_ENDS_WITH]
    return "(" + " OR ".join(parts) + ")"


def content_words_sql(tokens_list: str) -> str:
    stop = _lit_list(K.STOPWORDS)
    punct = "'" + K.PUNCTUATION.replace("'", "''") + "'"
    return (f"list_filter(list_transform({tokens_list}, lambda t: lower(t)), "
            f"lambda t: NOT list_contains({stop}, t) AND instr({punct}, t) = 0 AND t <> '')")


def display_sql(s: str) -> str:
    return (f"trim(replace(replace(replace(translate({s}, '{K.ACCENTED_CHARS}', '{K.ACCENT_BASES}'), "
            f"'\"', ''''''), '<p>', ''), '</p>', ''))")


DOC_ARTICLES = ("articles", """
SELECT CAST(doc_id AS BIGINT) AS entry_id, 0 AS version, text AS summary, source FROM documents""")

PAGE_ARTICLES = ("articles", """
SELECT CAST(page_id AS BIGINT) AS entry_id, 0 AS version, html AS summary, 'pages' AS source FROM pages""")


def split_sql(array_expr: str, src: str = "articles") -> str:
    return (f"SELECT source, entry_id, CAST(version AS INTEGER) AS version, CAST(u.i - 1 AS INTEGER) AS sent_idx, "
            f"u.s AS sentence FROM (SELECT source, entry_id, version, {array_expr} AS arr FROM {src}), "
            f"unnest(arr) WITH ORDINALITY AS u(s, i)")


def clean_markup_select(src: str = "articles") -> str:
    """T1 over ``src(entry_id, version, summary, source)`` -> same columns, cleaned summary."""
    last, ver = K.LAST_LINE_PATTERN, K.VERSION_LINE_PATTERN
    return f"""
SELECT entry_id, version, source, regexp_replace(c4, '{K.ESCAPED_TAG_PATTERN}', '', 'g') AS summary FROM (
 SELECT *, CASE WHEN ends_with(c3, '</p>') THEN substr(c3, 1, length(c3) - 4) ELSE c3 END AS c4 FROM (
  SELECT *, CASE WHEN starts_with(j, '<p>') THEN substr(j, 4) ELSE j END AS c3 FROM (
   SELECT *, array_to_string(l3, '</p><p>') AS j FROM (
    SELECT *, CASE WHEN len(l2) > 0 AND regexp_matches(l2[1], '{ver}') THEN l2[2:] ELSE l2 END AS l3 FROM (
     SELECT *, CASE WHEN len(l1) > 0 AND starts_with(l1[1], '{K.FIRST_LINE_LINK_PREFIX}') THEN l1[2:] ELSE l1 END AS l2 FROM (
      SELECT *, CASE WHEN len(l0) > 0 AND regexp_matches(l0[-1], '{last}') THEN l0[1:len(l0) - 1] ELSE l0 END AS l1 FROM (
       SELECT entry_id, version, source, string_split(summary, '</p><p>') AS l0 FROM {src}
      )))))))"""


def dateline_array_sql(text: str) -> str:
    """T4 sentence array of one text (no country table)."""
    arr = sentence_array(text)
    for dash in reversed(K.DATELINE_DASHES):
        head = f"split_part({text}, '{dash}', 1)"
        tail = f"trim(substr({text}, instr({text}, '{dash}') + 1))"
        arr = (f"(CASE WHEN instr({text}, '{dash}') > 0 AND {is_dateline_sql(head)} "
               f"THEN [trim({head})] || {sentence_array(tail)} ELSE {arr} END)")
    return arr


def dateline_merge_sql(arr: str) -> str:
    a = f"list_filter(list_transform({arr}, lambda s: trim(s)), lambda s: s <> '')"
    return (f"(SELECT CASE WHEN len(a) > 0 AND {is_dateline_sql('a[1]')} "
            f"THEN [array_to_string(a[1:2], '{K.DATELINE_DASHES[0]}')] || a[3:] ELSE a END "
            f"FROM (SELECT {a} AS a))")


def arcs_ctes(threshold: float, suffix: str) -> list[tuple[str, str]]:
    """m4/m5/m6 again at another threshold, named with a suffix (m1-m3 are shared)."""
    out = [m4_cte("x", threshold, suffix), m4_cte("y", threshold, suffix)]
    m5 = M5[1].replace("m4_x a", f"m4_x{suffix} a").replace("m4_y b", f"m4_y{suffix} b")
    m6 = M6[1].replace("m5", f"m5{suffix}")
    return out + [(f"m5{suffix}", m5), (f"m6{suffix}", m6)]
