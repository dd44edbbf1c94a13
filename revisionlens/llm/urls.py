"""URL filter: fixed rules first, a path-template tree for the rest.

The tree is built per host.  Level by level, a path segment stays as it is or
becomes ``*`` where it varies: segments that look like ids (digits, hexadecimal,
long mixed) at once, others where a node has many different children for its
number of urls.  Branches whose share of blocked labelled urls doesn't differ
significantly from their siblings' (two-proportion test) are merged into ``*`` too.
A template is rejected when its labelled purity, smoothed towards its parents' (the branches above it, its
host, the hosts of one suffix, the whole table), reaches ``BLOCK_SHARE``.  A template without a labelled url is judged by
the path branch it hangs from, if that holds ``BRANCH_LABELS`` labelled urls; else it is allowed: labels of
other branches of a host say nothing against a branch of its own.  Labels are the urls that a rule decides, and
any table of labels that is given.

Everything is a grouped count over (host, template) with map-side sums; the
nodes of a host are far fewer than its urls, as id-like segments are generalised
before the first shuffle.  A round skips the segments that all paths of a node share, and a node of one path, or
without labelled urls, is closed in one step (its template ends in ``**`` if paths are left), so there are as many rounds as
labelled paths branch one below another, not as many as the longest path has segments.  Every url has a template.

Nulls and odd input: a null url, or one without ``://``, has an empty host and
path and is judged like any other (no rule fits it); repeated rows are judged each,
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import ascii_lower, prepare, written

#: (rule, verdict): host, then the path it starts with.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MANY_CHILDREN, CHILD_SHARE = 8, 0.2      # a node's children are one wildcard from so many, and so many a url
SMOOTHING = 10.0                         # labelled urls that a parent's share counts as
BLOCK_SHARE = 0.75
BRANCH_LABELS = 10               # labelled urls of a branch that speak for a template without any
Z = 1.96


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _segment(s: Column) -> Column:
    """``*`` for a segment that looks like an id."""
    stem = F.regexp_replace(s, r"\.[A-Za-z]{2,5}$", "")
    looks = stem.rlike(r"^[0-9]+$|^[0-9a-fA-F-]{8,}$|[0-9]{4,}|^(?=.*[0-9])(?=.*[A-Za-z]).{16,}$")
    return F.when(looks, F.lit("*")).otherwise(s)


def _smoothed(blocked: Column, labelled: Column, up: Column, levels: Column | None = None) -> Column:
    """The share of blocked urls drawn towards ``up``; over several levels of one child each in closed form."""
    if levels is None:
        return (blocked + SMOOTHING * up) / (labelled + SMOOTHING)
    own = blocked / F.greatest(labelled, F.lit(1))
    return F.when(labelled > 0, own + (up - own) * F.pow(SMOOTHING / (labelled + SMOOTHING), levels)).otherwise(up)


def _host_shares(urls: DataFrame) -> DataFrame:
    """Per host its share of blocked urls, smoothed towards its suffix's and the whole table's."""
    hosts = urls.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = written(hosts.withColumn("suffix", F.substring_index("host", ".", -1)), "hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"))
    labelled, blocked = suffixes.agg(F.sum("sl"), F.sum("sb")).first()               # two numbers
    every = F.lit(((blocked or 0) + 0.5) / ((labelled or 0) + 1.0))
    suffixes = suffixes.select("suffix", _smoothed(F.col("sb"), F.col("sl"), every).alias("up"))
    return hosts.join(suffixes, "suffix").select("host", _smoothed(F.col("b"), F.col("l"), F.col("up")).alias("share"))


def _branched(nodes: DataFrame) -> DataFrame:
    """One level down: a node's children are counted, generalised and merged, and its smoothed share is handed to them."""
    nodes = nodes.withColumn("segment", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
    child = nodes.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.first("share").alias("up"))
    node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    child = child.join(node, ["host", "template"])
    rest_l, rest_b = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    p = (F.col("all_blocked") + 0.5) / (F.col("all_labelled") + 1.0)
    spread = F.sqrt(p * (1 - p) * (1 / F.greatest(F.col("labelled"), F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
    differs = (F.col("labelled") > 0) & (rest_l > 0) & (F.abs(F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1))) > Z * spread)
    varies = (F.col("children") >= MANY_CHILDREN) & (F.col("children") >= CHILD_SHARE * F.col("all_n"))
    same_labels = (F.col("labelled") > 0) & (rest_l > 0) & ~differs
    general = F.when((F.col("segment") == "") | (F.col("children") == 1), F.col("segment")).when(varies | same_labels, F.lit("*")).otherwise(F.col("segment"))
    child = child.withColumn("name", F.concat("template", F.lit("/"), general))
    merged = child.groupBy("host", "template", "name").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    spoken = F.when((F.col("template") != "") & (F.col("all_labelled") >= BRANCH_LABELS), F.col("all_labelled")).otherwise(0)
    shares = child.select("host", "template", "segment", "name", "up", spoken.alias("branch")).join(merged, ["host", "template", "name"])
    shares = shares.select("host", "template", "segment", "name", _smoothed(F.col("b"), F.col("l"), F.col("up")).alias("new"), F.when(F.col("l") > 0, F.col("l")).otherwise(F.col("branch")).alias("known"))
    nodes = nodes.join(shares, ["host", "template", "segment"])
    rest = F.when(F.col("segment") == "", F.col("rest")).otherwise(F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))))
    return nodes.select("host", "segments", rest.alias("rest"), "n", "labelled", "blocked", F.col("new").alias("share"), F.col("name").alias("template"), F.col("known").alias("evidence"))


def template_shares(urls: DataFrame) -> DataFrame:
    """``urls``: host, segments (generalised ids), n, labelled, blocked.  Returns host, segments, share, template and evidence."""
    nodes = urls.join(_host_shares(urls), "host").withColumn("template", F.lit("")).withColumn("evidence", F.lit(0).cast("long")).withColumn("rest", F.col("segments"))
    done: list[DataFrame] = []
    while True:
        same = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))          # 0: one path
        group = nodes.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        group = group.select("host", "template", "l", "b", (same == 0).alias("single"), F.when(same == 0, F.size("low")).otherwise(same.cast("int") - 1).alias("shared"), "low")
        group = group.withColumn("shared_path", F.slice("low", F.lit(1), F.col("shared"))).drop("low")
        nodes = nodes.join(group, ["host", "template"])
        path = F.when(F.col("shared") > 0, F.concat(F.lit("/"), F.array_join("shared_path", "/"))).otherwise("")
        closed = F.col("single") | (F.col("l") == 0)
        template = F.concat("template", path, F.when(F.col("single"), F.lit("")).otherwise(F.when(closed, F.lit("/**")).otherwise("")))
        share = _smoothed(F.col("b"), F.col("l"), F.col("share"), F.col("shared"))
        evidence = F.when(F.col("l") > 0, F.col("l")).otherwise(F.col("evidence"))
        rest = F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest") - F.col("shared"), F.lit(0)))
        nodes = nodes.select("host", "segments", rest.alias("rest"), "n", "labelled", "blocked", share.alias("share"), template.alias("template"), evidence.alias("evidence"), closed.alias("closed"))
        nodes = written(nodes, f"level{len(done)}")
        done.append(nodes.filter("closed").select("host", "segments", "share", "template", "evidence"))
        nodes = nodes.filter("not closed").drop("closed")
        if not nodes.head(1):
            break
        nodes = written(_branched(nodes), f"branches{len(done)}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, template, share``.

    ``labels``: optional ``url, blocked`` (0 or 1) beside the urls that rules decide.
    """
    prepare(pages.sparkSession)
    verdict_of = F.create_map(*[F.lit(x) for r in rules for x in r])
    segments = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), _segment)

    def parsed(df: DataFrame, *columns: str) -> DataFrame:
        df = df.select(*columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        return df.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), segments.alias("segments"))

    p = written(parsed(pages, "page_id"), "urls")
    decided = F.col("rule").isNotNull()
    counts = p.select("host", "segments", decided.cast("long").alias("labelled"), (decided & (F.element_at(verdict_of, F.coalesce("rule", F.lit(rules[0][0]))) == "block")).cast("long").alias("blocked"))
    if labels is not None:
        counts = counts.unionByName(parsed(labels.filter("blocked is not null"), "blocked").select("host", "segments", F.lit(1).cast("long").alias("labelled"), F.col("blocked").cast("long").alias("blocked")))
    counts = counts.groupBy("host", "segments").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    shares = template_shares(counts)
    out = p.join(shares, ["host", "segments"], "left")
    method = F.when((F.col("share") >= BLOCK_SHARE) & (F.col("evidence") > 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.element_at(verdict_of, F.col("rule")), method).alias("verdict"), "template", F.round("share", 6).alias("share"))
