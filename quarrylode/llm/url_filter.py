"""URL filtering by path-template trees, natively.

Urls are grouped by host and by the shape of their path (numbers, hashes, dates and long slugs are
classes). Level by level, the segments below a common parent become a wildcard where they vary too
much to be names, or where labelled urls below them and below their siblings show that their block
rates do not differ. A template is rejected by the purity of its labelled urls, smoothed by that of
the branch above it; a host as a whole is taken to be half and half.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.llm.common import lower_ascii, table, written

#: (rule, verdict): a host, a slash and the start of a path. Fixed by the query's contract.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Levels of a tree. The segments below are one last segment together, none of them lost.
DEPTH = 8
#: So many children with so few urls each are values, not names.
VARIED, FEW = 20, 5.0
#: Two-sided 5% point of the normal distribution.
Z = 1.96
#: Purity from which a template is rejected, and how many labelled urls the branch above counts as.
REJECT, PRIOR = 0.8, 2.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and the next /, ?, # or end, with A-Z lower-cased;
    path from there to the next ?, # or end. Both are empty for null or where there is no ://."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(has, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        at = name.partition("/")[0]
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(name[len(at):]))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    return (
        F.when(F.rlike(segment, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), "{date}")
        .when(F.rlike(segment, F.lit(r"^[0-9]+$")), "{num}")
        .when(F.rlike(segment, F.lit(r"^[0-9]+\.[A-Za-z]{1,5}$")), F.concat(F.lit("{num}."), F.substring_index(segment, ".", -1)))
        .when(F.rlike(segment, F.lit(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$")), "{hex}")
        .when((F.length(segment) > 40) | F.rlike(segment, F.lit(r"^[^-_]+([-_][^-_]+){3,}$")), "{slug}")
        .otherwise(segment)
    )


def path_shape(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path, classes for variable ones; empty segments do not count."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shapes = F.transform(parts, _shape)
    rest = F.array_join(F.slice(shapes, depth, F.greatest(F.size(shapes), F.lit(1))), "/")
    return F.when(F.size(shapes) > depth, F.concat(F.slice(shapes, 1, depth - 1), F.array(rest))).otherwise(shapes)


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """From (host, shape, blocked, allowed, n), one row each, the same with each row's template.

    At each level the children of a parent fall into groups by the depth below them. Children that
    vary like values join the group's wildcard, and so do those with labels whose block rate does
    not differ from that of the group's other labels (two-sided test). A child without labels has
    nothing to be like, and stays. Joins and sums only: no pairs of branches are compared.
    """
    t = urls.withColumn("parent", F.lit(""))
    for level in range(depth):
        here = F.size("shape") > level
        t = t.withColumn("seg", F.when(here, F.element_at("shape", level + 1))).withColumn("below", F.when(here, F.size("shape") - level))
        children = t.filter(here).groupBy("host", "parent", "below", "seg").agg(F.sum("n").alias("cn"), F.sum("blocked").alias("cb"), F.sum("allowed").alias("ca"))
        parents = children.groupBy("host", "parent", "below").agg(F.count(F.lit(1)).alias("kids"), F.sum("cn").alias("pn"), F.sum("cb").alias("pb"), F.sum("ca").alias("pa"))
        labelled, others = F.col("cb") + F.col("ca"), F.col("pb") + F.col("pa") - F.col("cb") - F.col("ca")
        rate = (F.col("pb") + 1) / (F.col("pb") + F.col("pa") + 2)
        spread = F.sqrt(rate * (1 - rate) * (1.0 / labelled + 1.0 / others))
        alike = (labelled > 0) & (others > 0) & (F.abs(F.col("cb") / labelled - (F.col("pb") - F.col("cb")) / others) <= Z * spread)
        varies = (F.col("kids") >= VARIED) & (F.col("pn") / F.col("kids") < FEW)
        merged = children.join(parents, ["host", "parent", "below"]).filter((F.col("kids") > 1) & (varies | F.coalesce(alike, F.lit(False)))).select("host", "parent", "below", "seg", F.lit(True).alias("wild"))
        t = t.join(merged, ["host", "parent", "below", "seg"], "left")
        step = F.concat(F.col("parent"), F.lit("/"), F.when(F.col("wild"), "*").otherwise(F.col("seg")))
        t = t.withColumn("parent", F.when(here, step).otherwise(F.col("parent"))).drop("seg", "below", "wild")
        t = written(t)  # the next level reads it twice
    return t.withColumnRenamed("parent", "template")


def purities(trees: DataFrame) -> DataFrame:
    """host, template, purity: the share of blocked labels below each branch, from the top down,
    each smoothed by PRIOR urls of the branch above; the host itself counts as one half."""
    steps = F.split(F.substring("template", 2, 1 << 30), "/", DEPTH)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("prefix")))
    sums = trees.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    each = written(sums.filter("template <> ''").select("host", "template", "b", "a", F.inline(prefixes)))
    above = each.groupBy("host", "prefix").agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"))
    lists = each.join(above, ["host", "prefix"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "pb", "pa"))).alias("levels"))
    purity = F.aggregate("levels", F.lit(0.5), lambda p, x: (x["pb"] + PRIOR * p) / (x["pb"] + x["pa"] + PRIOR))
    return lists.select("host", "template", purity.alias("purity")).unionByName(sums.filter("template = ''").select("host", "template", F.lit(0.5).alias("purity")))


def judge_urls(pages: DataFrame, url: str, rules: Sequence[tuple[str, str]] = RULES, label: str | None = None, reject: float = REJECT) -> DataFrame:
    """Adds host, path, rule, template, purity and verdict to pages; columns so named are replaced.

    Labels are the column label (1 block, 0 allow, null none) or, without one, the rules' verdicts.
    A rule decides for the urls it fits; for the others a template with purity >= reject is blocked.
    Rows are kept one for one. A null url has an empty host and path, whose template judges it.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict")
    kept = [c for c in pages.columns if c not in new]
    host, path = split_url(F.col(url))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_ql_says": says, "_ql_shape": path_shape(F.col("path"))})
    blocked = F.col(label) == 1 if label else F.col("_ql_says") == "block"
    allowed = F.col(label) == 0 if label else F.col("_ql_says") == "allow"
    shapes = rows.groupBy("host", F.col("_ql_shape").alias("shape")).agg(F.count_if(blocked).alias("blocked"), F.count_if(allowed).alias("allowed"), F.count(F.lit(1)).alias("n"))
    deepest = rows.agg(F.coalesce(F.max(F.size("_ql_shape")), F.lit(0))).first()[0]
    trees = templates(shapes, deepest)
    verdicts = trees.select("host", "shape", "template").join(purities(trees), ["host", "template"]).withColumnsRenamed({"host": "_ql_host", "shape": "_ql_key"})
    joined = rows.join(verdicts, (rows["host"] == F.col("_ql_host")) & (rows["_ql_shape"] == F.col("_ql_key")))
    method = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return joined.select(*kept, "host", "path", "rule", "template", "purity", F.coalesce("_ql_says", method).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or by templates that the rules' verdicts label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, "url").select("page_id", "host", "path", "rule", "verdict", "template", "purity")
