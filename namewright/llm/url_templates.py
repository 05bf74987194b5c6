"""URL filters by a path-template tree, with DataFrame functions only.

The tree of a host grows a level at a time. A branch is a path segment, with variable parts generalised (numbers, hex,
long identifiers). Sibling branches are merged unless their labelled pages differ by a two-proportion z-test; most merge into
the wildcard ``*``, those that differ from it alike into a wildcard of their own. Templates whose smoothed purity is low are
rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Labelled pages that a branch and its siblings together need; z from which they differ.
LEAST, Z = 5, 2.58
#: Labelled pages that the prior counts as; purity below which a template is rejected.
SMOOTH, PURE = 8.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a url; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda i: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its action), of the longest rule that fits; null if none does. rules: (action, ``host/path``)."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        r_host, slash, r_path = text.partition("/")
        fits = ((host == r_host) | F.endswith(host, F.lit(f".{r_host}"))) & F.startswith(path, F.lit(slash + r_path))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _branch(segment: Column) -> Column:
    """A segment with its variable parts generalised; the extension stays."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(stem.rlike("^[0-9]+$"), "<n>").when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "<h>").when(stem.rlike("[0-9]") | (F.length(stem) > 40), "<v>")
    return F.when(kind.isNotNull(), F.concat(kind, ext)).otherwise(segment)


def _clusters(stats: DataFrame) -> DataFrame:
    """(k_host, k_template, k_branch, k_name): branches in clusters whose members don't differ from one another.

    All branches of a node begin as one cluster. In each round a cluster with branches that differ from its other branches is
    cut in two: those on the side of the one that differs most, and the rest. Both are tested again by themselves, until none
    differs; so branches that differ from the rest alike stay together. A cluster of one branch has its name. The rest of all
    rounds is ``*``, where branches without labels belong too; other clusters are ``*`` and the side taken in each round.
    stats: every branch with labelled pages. Small ones aren't tested, but count in the rest that the others are tested against.
    """
    keys = ("host", "template", "cluster")
    same = lambda prefix: (F.col("host") == F.col(prefix + "host")) & (F.col("template") == F.col(prefix + "template")) & (F.col("cluster") == F.col(prefix + "cluster"))
    named = lambda prefix: [F.col(k).alias(prefix + k) for k in keys]
    stats, done = stats.withColumn("cluster", F.lit("")), None
    while True:
        whole = stats.groupBy(*named("w_")).agg(F.sum("l").alias("wl"), F.sum("b").alias("wb"))
        rest_l, rest_b = F.col("wl") - F.col("l"), F.col("wb") - F.col("b")
        pooled = F.try_divide("wb", "wl")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), rest_l)))
        z = F.coalesce(F.try_divide(F.try_divide("b", "l") - F.try_divide(rest_b, rest_l), spread), F.lit(0.0))
        tested = stats.join(whole, same("w_")).withColumn("z", F.when((F.col("l") >= LEAST) & (rest_l >= LEAST) & (F.abs(z) > Z), z))
        tested = written(tested.select(*keys, "branch", "l", "b", "z"), "tested")
        side = tested.groupBy(*named("s_")).agg(F.signum(F.max_by("z", F.abs("z"))).alias("side"))
        sided = tested.join(side, same("s_"))
        still = sided.filter("side is null").select("host", "template", "branch", "cluster")
        done = still if done is None else done.unionByName(still)
        step = F.when(F.signum("z") == F.col("side"), F.lit("1")).otherwise(F.lit("0"))
        cut = written(sided.filter("side is not null").select("host", "template", "branch", "l", "b", F.concat("cluster", step).alias("cluster")), "branches")
        if cut.isEmpty():
            break
        stats = cut
    sizes = done.groupBy(*named("c_")).agg(F.count("*").alias("members"))
    name = F.when(~F.contains("cluster", F.lit("1")), F.lit("*")).when(F.col("members") == 1, F.col("branch")).otherwise(F.concat(F.lit("*"), F.col("cluster")))
    return done.join(sizes, same("c_")).select(F.col("host").alias("k_host"), F.col("template").alias("k_template"), F.col("branch").alias("k_branch"), name.alias("k_name"))


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, path, template, purity) of distinct (host, path) with n_labelled and n_bad.

    The tree grows to the longest path, or until no node can have a branch that differs: it needs labelled pages for two sides,
    good and bad ones, which nodes below have no more of. All segments further down are ``*``.

    purity: share of good among the template's labelled pages, smoothed towards its host's, that towards that of all.
    """
    segments = F.split(F.regexp_replace(F.col("path"), "^/", ""), "/")
    rows = paths.select("host", "path", "n_labelled", "n_bad", segments.alias("segments"), F.lit("").alias("template"))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    level = 0
    while level < deepest:
        here = F.size("segments") > level
        nodes = rows.filter(here).groupBy("host", "template").agg(F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
        if nodes.filter((F.col("l") >= 2 * LEAST) & (F.col("b") > 0) & (F.col("b") < F.col("l"))).isEmpty():
            break
        rows = rows.withColumn("branch", F.when(here, _branch(F.element_at("segments", level + 1))))
        stats = rows.filter(here).groupBy("host", "template", "branch").agg(F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
        clusters = _clusters(written(stats.filter("l > 0"), "branches"))
        rows = rows.join(clusters, (F.col("host") == F.col("k_host")) & (F.col("template") == F.col("k_template")) & (F.col("branch") == F.col("k_branch")), "left")
        step = F.when(~here, F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("k_name", F.lit("*"))))
        rows = written(rows.select("host", "path", "n_labelled", "n_bad", "segments", step.alias("template")), "level")
        level += 1
    rows = rows.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("segments") - level, F.lit(0)))))
    good = lambda bad, n, prior: (F.col(n) - F.col(bad) + SMOOTH * prior) / (F.col(n) + SMOOTH)
    leaves = rows.groupBy("host", "template").agg(F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
    hosts = leaves.groupBy(F.col("host").alias("h")).agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    total = hosts.agg(F.sum("hl"), F.sum("hb")).first()
    prior = (total[0] - total[1]) / total[0] if total[0] else 1.0
    leaves = leaves.join(hosts, F.col("host") == F.col("h")).select(F.col("host").alias("t_host"), F.col("template").alias("t"), good("b", "l", good("hb", "hl", F.lit(prior))).alias("purity"))
    return rows.join(leaves, (F.col("host") == F.col("t_host")) & (F.col("template") == F.col("t"))).select("host", "path", "template", "purity")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url).

    labelled: (page_id, bad) of some pages; repeated ones count each. The verdict is that of the longest rule that fits, else
    block where the template's purity is below 0.5. Without labels nothing is impure. Null urls and urls without ``://`` have
    an empty host and path and are judged like others; no pages, no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labelled.groupBy(F.col("page_id").alias("l_page")).agg(F.count("bad").alias("n_labelled"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("n_bad"))
    with_marks = found.join(marks, F.col("page_id") == F.col("l_page"), "left")
    paths = with_marks.groupBy("host", "path").agg(F.coalesce(F.sum("n_labelled"), F.lit(0)).alias("n_labelled"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad"))
    tree = template_tree(written(paths, "paths")).select(F.col("host").alias("p_host"), F.col("path").alias("p_path"), "template", "purity")
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = found.join(tree, (F.col("host") == F.col("p_host")) & (F.col("path") == F.col("p_path")))
    own = F.when(F.col("purity") < PURE, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), F.concat("host", "template").alias("template"), "purity")


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): pages whose url ends in the number of a labelled document; bad is low quality or toxic."""
    _, path = host_and_path(F.col("url").cast("string"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z]{1,5})?/?$", 1)
    of = pages.select("page_id", F.nullif(number, F.lit("")).cast("long").alias("document"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.select("doc_id", bad.alias("bad"))
    return of.join(marks, F.col("document") == F.col("doc_id")).select("page_id", "bad")
