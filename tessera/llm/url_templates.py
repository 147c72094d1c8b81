"""URL filter by rules and, where none fits, by a tree of path templates per host.

Everything is DataFrame functions. Paths are first typed (long hexadecimal runs
and digits become placeholders) and counted per host, so that the tree is built
from one row a host and typed path, with the pages that rules allow or block as
labels. Top down, a node with more than ``max_kids`` different segments below
it gets one wildcard branch; segments beyond ``DEPTH`` are one wildcard tail.
Bottom up, sibling branches whose share of blocked pages does not differ
significantly from their parent's are merged. A node's share of blocked pages is
smoothed towards its parent's, ``BACKOFF`` pages strong, from all hosts down to
the host, its branches and the template; a template is rejected if its share is
above one half. So a branch without labelled pages is judged as the host or the
branches beside it are, and a host without any as all labelled pages are.

A hot host or template is only ever aggregated with partial sums; verdicts
return to the pages by a broadcast of the template table if it has at most
``BROADCAST_ROWS`` rows, else by a join that adaptive execution may split.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged as the template of the empty host; a host without a
path has the empty path; rows of the same page_id are all judged; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

DEPTH = 3
MAX_KIDS = 20
Z = 1.96
#: Pages of the parent's share that smoothing adds to a node; pages that it adds
#: to all hosts together: blocked, allowed.
BACKOFF, SMOOTH = 4.0, (1.0, 3.0)
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def typed(path: str = "path") -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{12,}", "<x>"), "[0-9]+", "<n>")


def template_tree(labelled: DataFrame, max_kids: int = MAX_KIDS) -> DataFrame:
    """host, typed, reject for every typed path of ``labelled`` (host, path,
    verdict or null)."""
    levels = [f"t{d}" for d in range(1, DEPTH + 1)]
    segments = F.split("typed", "/")
    paths = (labelled.withColumn("typed", typed()).groupBy("host", "typed")
             .agg(F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b"),
                  F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"))
             .withColumns({t: F.coalesce(F.get(segments, F.lit(d)), F.lit("<none>")) for d, t in enumerate(levels, 1)})
             .withColumn("tail", F.when(F.size(segments) > DEPTH + 1, "**").otherwise("")))
    paths = written(paths, "paths")
    for d, t in enumerate(levels):
        above = ["host", *levels[:d]]
        many = (paths.select(*above, t).distinct().groupBy(*above).agg(F.count(F.lit(1)).alias("kids"))
                .filter(F.col("kids") > max_kids))
        paths = written(paths.join(many, above, "left").withColumn(
            t, F.when(F.col("kids").isNotNull() & (F.col(t) != "<none>"), "*").otherwise(F.col(t))).drop("kids"), "paths")
    for d, t in reversed(list(enumerate(levels))):
        above = ["host", *levels[:d]]
        kids = paths.groupBy(*above, t).agg(F.sum("b").alias("kb"), (F.sum("a") + F.sum("b")).alias("kn")).filter("kn > 0")
        parents = kids.groupBy(*above).agg((F.sum("kb") / F.sum("kn")).alias("p"))
        similar = (kids.join(parents, above)
                   .filter(F.abs(F.col("kb") / F.col("kn") - F.col("p"))
                           <= Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("kn")) + 0.5 / F.col("kn"))
                   .select(*above, t, F.lit("~").alias("merged")))
        paths = written(paths.join(similar, [*above, t], "left").withColumn(t, F.coalesce("merged", t)).drop("merged"), "paths")
    template = ["host", *levels, "tail"]
    known = paths.agg(F.sum("b"), F.sum("a")).first()
    top = ((known[0] or 0) + SMOOTH[0]) / ((known[0] or 0) + (known[1] or 0) + sum(SMOOTH))
    shares = paths.groupBy(*template).agg(F.sum("b").alias("b"), F.sum("a").alias("a")).withColumn("share", F.lit(top))
    for depth in range(1, len(template) + 1):
        node = template[:depth]
        sums = shares.groupBy(*node).agg(F.sum("b").alias("nb"), (F.sum("a") + F.sum("b")).alias("nn"))
        shares = (shares.join(sums, node).withColumn("share", (F.col("nb") + BACKOFF * F.col("share")) / (F.col("nn") + BACKOFF))
                  .drop("nb", "nn"))
    judged = shares.select(*template, (F.col("share") > 0.5).alias("reject"))
    return paths.join(judged, template).select("host", "typed", "reject")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          max_kids: int = MAX_KIDS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    host, path = url_parts(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    tree = written(template_tree(rows, max_kids), "tree")
    if tree.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        tree = F.broadcast(tree)
    return (rows.withColumn("typed", typed()).join(tree, ["host", "typed"], "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict")))
