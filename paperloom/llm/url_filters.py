"""URL filters: rules by host and path, and a tree of path templates judged by labelled purity.

Everything is DataFrame expressions. Rules come first: a rule ``host/path`` fits its host and all subdomains where the
path starts with the rule's; the longest that fits decides. Other URLs are judged by a template tree:

1. per host, a path segment is kept where its value occurs ``SUPPORT`` times at that depth, however large the host;
   all others are variable and become ``*``;
2. the nodes of the tree are the prefixes of these templates; each counts its labelled pages and the bad ones;
3. a branch whose bad share does not differ significantly from that of its siblings is merged with all such
   siblings: they share one count;
4. from the root down, a node's bad share is smoothed towards its parent's (the root's towards that of all labels) with the weight of ``PRIOR`` pages,
   unless it holds no other labels than its parent; a template whose smoothed share of good labels is below ``PURITY`` is blocked.

Counts are aggregated before they are shuffled. Segments meet their counts by (host, depth, value), so a large host is
as spread as its segments are, and no list per host is gathered; adaptive execution splits a segment that most URLs
have. A template is made once per distinct host and path; only blocked templates are joined at the end.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged as such; pages without
a label count in templates but not in purity; several labels of one page count once, bad if any is; repeated
rows are judged each; empty tables give an empty result, no labels allow everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# A segment that so many URLs of a host have at one depth is no variable one.
SUPPORT = 5
# A branch differs from its siblings beyond so many standard errors.
DIFFERS = 1.96
PRIOR = 10.0
PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        own, at = text.split("/", 1)
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{at}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(act)).otherwise(verdict)
    return rule, verdict


def _templates(urls: DataFrame, support: int) -> DataFrame:
    """(host, path, template) of every distinct URL: segments that are rare for their host and depth become ``*``."""
    segments = urls.select("host", "path", F.posexplode("segments").alias("depth", "value"))
    counts = segments.groupBy("host", "depth", "value").agg(F.count("*").alias("n"))
    kept = counts.filter(F.col("n") >= support).select("host", "depth", "value", F.col("value").alias("own"))
    each = urls.select("host", "path", "segments").dropDuplicates(["host", "path"])
    each = each.select("host", "path", F.posexplode("segments").alias("depth", "value"))
    met = each.join(kept, ["host", "depth", "value"], "left")
    listed = F.sort_array(F.collect_list(F.struct("depth", F.coalesce("own", F.lit("*")).alias("name"))))
    return met.groupBy("host", "path").agg(F.array_join(F.transform(listed, lambda x: x["name"]), "/").alias("template"))


def _blocked(templates: DataFrame, overall: float, prior: float, purity: float) -> DataFrame:
    """(host, template) of the templates to block, from one row per template with its labelled and bad pages."""
    parts = F.split("template", "/")
    levels = F.sequence(F.lit(0), F.size(parts))
    nodes = templates.withColumn("level", F.explode(levels)).withColumn(
        "node", F.array_join(F.slice(parts, 1, F.col("level")), "/")
    )
    stats = nodes.groupBy("host", "level", "node").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    up = F.when(F.instr("node", "/") > 0, F.regexp_extract("node", "^(.*)/[^/]*$", 1)).otherwise("")
    stats = stats.withColumn("parent", F.when(F.col("level") > 0, up))
    above = stats.select(
        "host", (F.col("level") + 1).alias("level"), F.col("node").alias("parent"),
        F.col("n").alias("all_n"), F.col("b").alias("all_b"),
    )
    stats = stats.join(above, ["host", "level", "parent"], "left")
    other_n, other_b = F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")
    pooled = (F.col("all_b") + 1) / (F.col("all_n") + 2)
    gap = (F.col("b") + 1) / (F.col("n") + 2) - (other_b + 1) / (other_n + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("n") + 2) + 1 / (other_n + 2)))
    alike = (F.col("level") > 0) & (F.abs(gap) < DIFFERS * error)
    stats = stats.withColumn("alike", F.coalesce(alike, F.lit(False)))
    merged = stats.filter("alike").groupBy("host", "level", "parent")
    merged = merged.agg(F.sum("n").alias("merged_n"), F.sum("b").alias("merged_b"))
    stats = stats.join(merged, ["host", "level", "parent"], "left").select(
        "host", "level", "node",
        F.when(F.col("alike"), F.col("merged_n")).otherwise(F.col("n")).alias("n"),
        F.when(F.col("alike"), F.col("merged_b")).otherwise(F.col("b")).alias("b"),
    )
    lines = nodes.select("host", "template", "level", "node").join(stats, ["host", "level", "node"])
    lines = lines.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "n", "b"))).alias("line"))
    start = F.struct(F.lit(float(overall)).alias("p"), F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("b"))

    def step(above: Column, x: Column) -> Column:
        same = (above["n"] == x["n"]) & (above["b"] == x["b"])
        p = F.when(same, above["p"]).otherwise((x["b"] + F.lit(prior) * above["p"]) / (x["n"] + F.lit(prior)))
        return F.struct(p.alias("p"), x["n"].alias("n"), x["b"].alias("b"))

    bad_share = F.aggregate("line", start, step, lambda last: last["p"])
    scored = lines.withColumn("bad_share", bad_share)
    return scored.filter(1 - F.col("bad_share") < purity).select("host", "template")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules=RULES, support: int = SUPPORT, prior: float = PRIOR, purity: float = PURITY
) -> DataFrame:
    """Per page: page_id, host, path, template, rule and verdict. ``labels``: doc_id, quality, toxic by page_id."""
    host, path = split_url("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    urls = urls.join(_templates(urls, support), ["host", "path"], "left").withColumn("template", F.coalesce("template", F.lit("")))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    known = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    overall = known.agg((F.sum("bad") + 1) / (F.count("*") + 2)).first()[0] or 0.5
    labelled = urls.join(known, "page_id", "left").groupBy("host", "template")
    counted = labelled.agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = _blocked(counted, overall, prior, purity).withColumn("blocked", F.lit(True))
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return urls.join(blocked, ["host", "template"], "left").select(
        "page_id", "host", "path", "template", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged.drop("template")
