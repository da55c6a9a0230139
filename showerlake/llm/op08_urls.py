"""URL filters: explicit rules, and for all else a tree of path templates per host. DataFrame operations only.

Digits in a path segment are generalised first. Then, level by level, the rarer segments of a node whose
pages keep bringing new names become one wildcard, and siblings that do not differ statistically are merged
into one branch: labelled ones by their block rates, all by the shape of what lies below them. A template
is rejected when its smoothed share of blocked labels is high; the labels are the verdicts that the rules
give to the pages they cover, and a node is smoothed towards its parent, up to its host, so that evidence
reaches the templates that no rule covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, Scratch, join_facts, table

#: (verdict, host, path) of the query's rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Levels with a node each; what lies below is one segment, as it is.
DEPTH = 12
#: Children of a node, and share of its pages whose segment comes once, from which its rarer segments are variable.
LEAST_KIDS, NEW = 3, 0.2
#: Labels that a branch needs to be told apart by them, and how many standard errors still count as alike.
LEAST_LABELS, ALIKE = 5, 1.96
#: Pages that a branch needs before its shape counts.
LEAST_PAGES = 5
#: Pseudo-labels, of a purity between even and the parent's (even ones at the host), and the smoothed block share from
#: which a template is rejected. A parent alone never rejects: that takes labels in the template's own, merged branch.
PRIOR, TOWARDS, REJECT = 4.0, 0.5, 0.8
NODE = ["host", "parent"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without `://`."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(text, pattern, 2)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def generalised(path: Column) -> Column:
    """The path without empty segments, each run of digits one `#`."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != ""), "/")


def segments(raw: Column) -> Column:
    """Segments of a generalised path; what lies below DEPTH is one. Each begins with `=`, which names of merged branches do not."""
    parts = F.when(raw == "", F.array().cast("array<string>")).otherwise(F.split(raw, "/"))
    deep = F.concat(F.slice(parts, 1, DEPTH), F.array(F.array_join(F.slice(parts, DEPTH + 1, F.size(parts)), "/")))
    return F.transform(F.when(F.size(parts) > DEPTH, deep).otherwise(parts), lambda x: F.concat(F.lit("="), x))


def _shapes(seen: DataFrame, pooled: DataFrame, kids: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """kids with same_shape: whether what lies below a child is spread as below all children of its node."""
    known = join_facts(seen, pooled, [*NODE, "below"], "of", total).drop("of").join(kids.select(*NODE, "segment", "kn"), [*NODE, "segment"])
    # the chi-square sum, but for the pages of the whole node, which are the same for all its children
    chi = known.groupBy(*NODE, "segment").agg(F.sum(F.col("o") * F.col("o") / (F.col("e") * F.col("kn"))).alias("part"))
    both = join_facts(kids.join(chi, [*NODE, "segment"]), nodes, NODE, "kids", total)
    stat = F.col("part") * F.col("tn") - F.col("kn")
    return both.withColumn("same_shape", (F.col("kn") >= LEAST_PAGES) & (stat <= F.col("freedom") + ALIKE * F.sqrt(2 * F.col("freedom")) + 1e-6))


def _purity(blocked: Column, allowed: Column, prior: Column) -> Column:
    return (blocked + PRIOR * prior) / (blocked + allowed + PRIOR)


def judge_templates(leaves: DataFrame, scratch: Scratch, spread: bool = False) -> DataFrame:
    """(host, raw, template, purity) of each raw template; `leaves` has host, raw, segs, n, blocked, allowed.

    With `spread` evidence reaches branches without labels: they merge with siblings of their shape, and
    nodes are smoothed towards their parents. Else only labelled branches merge, and the pseudo-labels are even.
    """
    even = F.lit(0.5)
    start = leaves.select("host", "raw", "segs", "n", "blocked", "allowed")
    hosts = scratch.keep(start.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("allowed").alias("ha"), F.count("*").alias("of")))
    total = start.count()
    now = scratch.keep(join_facts(start, hosts, ["host"], "of", total).select(*start.columns, (_purity(F.col("hb"), F.col("ha"), even) if spread else even).alias("purity")))
    levels = now.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(levels):
        parent = F.slice("segs", 1, level) if level else F.array().cast("array<string>")
        at = now.filter(F.size("segs") > level).select("*", parent.alias("parent"), F.get("segs", F.lit(level)).alias("segment"))
        below = F.coalesce(F.get("segs", F.lit(level + 1)), F.lit(""))
        sums = [F.sum("n").alias("o"), F.sum("blocked").alias("ob"), F.sum("allowed").alias("oa"), F.count("*").alias("leaves")]
        seen = scratch.keep(at.groupBy(*NODE, "segment", below.alias("below")).agg(*sums))  # all else of the level comes from this
        kids = scratch.keep(seen.groupBy(*NODE, "segment").agg(F.sum("o").alias("kn"), F.sum("ob").alias("kb"), F.sum("oa").alias("ka"), F.sum("leaves").alias("of")))
        pooled = scratch.keep(seen.groupBy(*NODE, "below").agg(F.sum("o").alias("e"), F.count("*").alias("of")))
        labelled = (F.col("kb") + F.col("ka")) >= LEAST_LABELS
        nodes = kids.groupBy(*NODE).agg(
            F.count("*").alias("kids"), F.sum("kn").alias("tn"), F.count(F.when(F.col("kn") == 1, 1)).alias("once"), F.sum(F.when(labelled, F.col("kb"))).alias("tb"), F.sum(F.when(labelled, F.col("ka"))).alias("ta")
        )
        nodes = scratch.keep(nodes.join(pooled.groupBy(*NODE).agg((F.count("*") - 1).alias("freedom")), NODE))
        both = _shapes(seen, pooled, kids, nodes, total) if spread else join_facts(kids, nodes, NODE, "kids", total).withColumn("same_shape", labelled)
        n, m = F.col("kb") + F.col("ka"), F.col("tb") + F.col("ta")
        rate = F.col("tb") / m
        error = F.sqrt(rate * (1 - rate) * (1 / n))
        alike = F.col("same_shape") & (~labelled | F.coalesce(F.abs(F.col("kb") / n - rate) <= ALIKE * error + 1e-9, F.lit(False)))
        variable = (F.col("kids") >= LEAST_KIDS) & (F.col("once") >= NEW * F.col("tn")) & (F.col("kn") * F.col("kids") <= F.col("tn"))
        name = F.when(variable, "*").when((F.col("kids") > 1) & alike, "~").otherwise(F.col("segment"))
        named = scratch.keep(both.select(*NODE, "segment", name.alias("name"), "kb", "ka", "of"))
        branches = scratch.keep(named.groupBy(*NODE, "name").agg(F.sum("kb").alias("nb"), F.sum("ka").alias("na"), F.count("*").alias("kinds")))
        facts = scratch.keep(join_facts(named, branches, [*NODE, "name"], "kinds", total).select(*NODE, "segment", "name", "nb", "na", "of"))
        joined = join_facts(at, facts, [*NODE, "segment"], "of", total)
        segs = F.concat(F.col("parent"), F.array("name"), F.slice("segs", level + 2, DEPTH + 1))
        moved = joined.select("host", "raw", segs.alias("segs"), "n", "blocked", "allowed", _purity(F.col("nb"), F.col("na"), 0.5 + TOWARDS * (F.col("purity") - 0.5) if spread else even).alias("purity"))
        after = scratch.keep(now.filter(F.size("segs") <= level).union(moved.select(*now.columns)))
        for done in (now, seen, kids, pooled, nodes, named, branches, facts):
            scratch.drop(done)
        now = after
    plain = F.transform("segs", lambda x: F.regexp_replace(x, "^=", ""))
    return now.select("host", "raw", F.concat(F.lit("/"), F.array_join(plain, "/")).alias("template"), "purity")


def judge(pages: DataFrame, scratch: Scratch, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    A null url or one without `://` has an empty host and path and no rule; it is judged like any other.
    Templates of hosts without labels are allowed. Equal urls, ties and repeated rows get equal verdicts; an
    empty table gives an empty result; very long paths are read whole; other columns are not read, so their
    names cannot clash. Templates are counted map-side, so a host of any share collapses before the shuffle.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), generalised(F.col("path")).alias("raw"))
    leaves = rows.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"))
    leaves = scratch.keep(leaves)
    found = judge_templates(leaves.withColumn("segs", segments(F.col("raw"))), scratch, spread=True)
    facts = scratch.keep(found.join(leaves.select("host", "raw", "n"), ["host", "raw"]))
    out = join_facts(rows, facts, ["host", "raw"], "n", pages.count())
    by_template = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", "purity")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "op8"))
