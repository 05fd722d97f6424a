"""URL filtering: rules by host and path first, then a tree of path templates for each host.

The tree is judged a level at a time in plain DataFrame steps: every node compares its branches, rare
ones among many and those that look alike become a wildcard, and a template goes if enough of its
URLs are known to be blocked.  What the rules decide are the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

# Parameters of the method, described in `judge`.
DEPTH, VARIETY, SUPPORT, PRIOR, REJECT = 8, 8, 4, 2, 0.8
#: Bounds of the two tests: chi-square at df + CHI * sqrt(2 df), squared normal score.
CHI, Z2 = 3.0, 3.84


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or holds no `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (`host/path`, verdict) that fits, as (rule, verdict), or nulls; of equal ones that with the longer host."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"))):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments with every run of digits as {n}; what lies deeper than DEPTH segments is one segment `**`."""
    segments = F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/")
    # The first entry is what precedes the first slash.
    return F.when(F.size(segments) <= DEPTH + 1, segments).otherwise(F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit("**"))))


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of n (URLs), l (labelled ones) and b (blocked ones)."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "l", "b")])


def templates(counts: DataFrame) -> DataFrame:
    """(host, shape, template) for every distinct shape of counts (host, shape, n, l, b).

    At each node of a host's tree a branch is variable if it has under SUPPORT URLs beside at least
    VARIETY branches.  It is like its siblings if neither what follows (the next segment, words
    alike, and the number of segments left; chi-square against all branches) nor the blocked share
    (against the other branches, where both have labels) tells it apart.  Variable branches become `*`, and so do those that are alike if a node has two of them at least.
    """
    here = counts.select("host", "shape", "n", "l", "b", F.posexplode("shape").alias("level", "branch"))
    prefix, following = F.array_join(F.slice("shape", 1, F.col("level")), "/"), F.get("shape", F.col("level") + 1)
    kind = F.when(following.isNull(), "/").otherwise(F.concat(F.when(F.contains(following, F.lit("{n}")), following).otherwise("w"), F.lit("/"), F.size("shape") - F.col("level")))
    steps = written(_counted(here.filter("level > 0").select("host", "level", prefix.alias("above"), "branch", kind.alias("below"), "n", "l", "b"), "host", "level", "above", "branch", "below"), "steps")
    node = ["host", "level", "above"]
    branches = _counted(steps, *node, "branch")
    below = steps.groupBy(*node, "below").agg(F.sum("n").alias("all_below"))
    nodes = branches.groupBy(*node).agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "l", "b")])
    nodes = nodes.join(below.groupBy(*node).agg((F.count("*") - 1).alias("df")), node)
    squares = spread_join(steps.select(*node, "branch", "below", "n"), below, [*node, "below"], "branch")
    squares = squares.groupBy(*node, "branch").agg(F.sum(F.col("n") * F.col("n") / F.col("all_below")).alias("squares"))
    found = spread_join(branches.join(squares, [*node, "branch"]), nodes, node, "branch")
    chi = F.col("all_n") * F.col("squares") / F.col("n") - F.col("n")
    rest_l, rest_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
    apart = F.pow(F.col("b") * rest_l - rest_b * F.col("l").cast("double"), F.lit(2)) * F.col("all_l")
    level_off = apart > Z2 * F.col("l") * rest_l * F.col("all_b").cast("double") * (F.col("all_l") - F.col("all_b"))
    alike = (chi <= F.col("df") + CHI * F.sqrt(2 * F.col("df"))) & ~level_off
    variable = (F.col("kids") >= VARIETY) & (F.col("n") < SUPPORT)
    judged = found.select(*node, "branch", variable.alias("variable"), alike.alias("alike"))
    several = judged.filter("alike").groupBy(*node).agg((F.count("*") > 1).alias("several")).filter("several")
    judged = spread_join(judged, several, node, "branch", "left")
    wild = F.col("variable") | (F.col("alike") & F.col("several").isNotNull())
    named = written(judged.select(*node, "branch", F.when(wild, "*").otherwise(F.col("branch")).alias("name")), "names")
    walked = here.select("host", "shape", "level", prefix.alias("above"), "branch").filter("level > 0")
    read = walked.join(named, [*node, "branch"])
    ordered = read.groupBy("host", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda s: s["name"]), "/").alias("_tail"))
    return counts.select("host", "shape").join(ordered, ["host", "shape"], "left").select("host", "shape", F.concat_ws("/", F.get("shape", F.lit(0)), "_tail").alias("template"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages (page_id, url).

    The longest rule that fits gives the verdict (allow or block).  Elsewhere a template of the host's tree is
    blocked if its smoothed purity reaches REJECT: the blocked URLs among its labelled ones, where
    PRIOR made-up URLs and all unlabelled ones count with the share that is blocked among all labelled
    URLs.  So a template that hardly any rule touches is allowed.  Rows are counted by shape before
    they meet; a shape's text and nothing else leaves a page's row.  Null urls, and urls without `://`,
    have an empty host and path; null ids and repeated rows are kept; an empty table gives no rows;
    very long paths count by their first DEPTH segments, other columns are ignored.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    seen = split.select("page_id", "host", "path", rule.alias("rule"), says.alias("_says"), shape(F.col("path")).alias("shape"))
    blocked = (F.col("_says") == "block").cast("bigint")
    counts = written(_counted(seen.select("host", "shape", F.lit(1).alias("n"), F.col("_says").isNotNull().cast("bigint").alias("l"), F.coalesce(blocked, F.lit(0)).alias("b")), "host", "shape"), "shapes")
    share = counts.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("l"), F.lit(0)) + 2)).alias("share")).first()[0]
    named = written(templates(counts), "templates")
    held = _counted(named.join(counts, ["host", "shape"]), "host", "template")
    purity = (F.col("b") + F.lit(share) * (F.col("n") - F.col("l") + PRIOR)) / (F.col("n") + PRIOR)
    judged = written(spread_join(named, held.select("host", "template", purity.alias("purity")), ["host", "template"], "shape"), "judged")
    joined = spread_join(seen, judged, ["host", "shape"], "page_id")
    verdict = F.coalesce("_says", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
