"""URL filters: host and path rules, and link-graph propagation for what no rule decides.

Only DataFrame functions are used. A url's host and path are cut out with
string functions; rules meet hosts by an equi-join on every suffix of the
host, and the longest rule whose path is a prefix of the url's wins. Links
between hosts are read from the pages' anchors and summed by host pair.
Trust is personalised PageRank from hosts in proportion to their urls under
allow rules; distrust is the same over reversed links from hosts in
proportion to their urls under block rules. Both follow links until less than
``TOLERANCE`` of the seeds' mass is still on its way. A host whose distrust
less its trust is more than the threshold's part of their sum is blocked, any
other host allowed: a blocked host's distrust is split over all that link to
it, so only the balance of both ranks, not their size, says anything.

Defined results: null url, or url without ``://``, has empty host and path
and is judged as a host without links; of equally long rules the one later
in order wins; null html has no links; links from a host to itself carry no
weight; mass that reaches a host without links ends there; repeated rows are
judged alike but weigh as often as they occur; an empty table gives an empty
result; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
ROUNDS = 12
TOLERANCE = 1e-12
THRESHOLD = 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHOR = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules) -> DataFrame:
    """(rule_host, rules) with the rules of each host, from (action, 'host/path') pairs."""
    rows = [(action, rule, rule[: rule.index("/")], rule[rule.index("/") :]) for action, rule in rules]
    table = spark.createDataFrame(rows, "action string, rule string, rule_host string, rule_path string")
    return table.groupBy("rule_host").agg(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "action", "rule_path")).alias("rules"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) with every rule of the host and of the domains above it."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffix = hosts.where("host <> ''").select("host", F.explode(ends).alias("rule_host"))
    return suffix.join(rules, "rule_host").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): anchors from one host to another."""
    link = F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)))
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), link.alias("link"))
    links = links.where(F.col("link").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(target).alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank over links(kind, src, dst, n) from seeds(kind, host, seed).

    Each round sends on what the last one brought (new); its sum falls by the
    damping at least, so the loop ends. It is tested after every rounds rounds.
    """
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    share = c.saved(links.join(out, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("n") / F.col("all")).alias("w")), "shares")
    base = c.saved(seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank")), "seeds")
    if share.limit(1).count() == 0:
        return base
    rank = base.withColumn("new", F.col("rank"))
    mass = total = base.agg(F.sum("rank")).first()[0] or 0.0
    i = 0
    while mass > TOLERANCE * total:
        sent = rank.where("new > 0").withColumnRenamed("host", "src").join(share, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("new") * F.col("w")).alias("new"))
        both = rank.select("kind", "host", "rank", F.lit(0.0).alias("new")).unionByName(sent.select("kind", "host", F.col("new").alias("rank"), "new"))
        rank = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new"))
        i += 1
        if i % 4 == 0 or i % rounds == 0:
            rank = c.saved(rank, f"rank{i}")
        if i % rounds == 0:
            mass = rank.agg(F.sum("new")).first()[0]
    return rank.select("kind", "host", "rank")


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """pages(page_id, url, html) to (page_id, host, path, rule, verdict, trust, distrust)."""
    spark = pages.sparkSession
    cut = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = rules_by_host(cut.select("host").distinct(), rule_table(spark, rules))
    ruled = cut.select("page_id", "host", "path").join(by_host, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    ruled = c.saved(ruled.withColumn("best", best).select("page_id", "host", "path", "best.rule", "best.action"), "ruled")
    shares = ruled.groupBy("host").agg(*[F.avg(F.when(F.col("action") == a, 1.0).otherwise(0.0)).alias(a) for a in ("allow", "block")])
    seeds = shares.select("host", F.explode(F.map_from_arrays(F.array(F.lit("allow"), F.lit("block")), F.array("allow", "block"))).alias("kind", "seed")).where("seed > 0")
    links = c.saved(host_links(cut), "links")
    forward = links.select(F.lit("allow").alias("kind"), "src", "dst", "n")
    backward = links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    rank = propagate(forward.unionByName(backward), seeds, rounds)
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    judged = c.saved(rank.groupBy("host").agg(pick("allow").alias("trust"), pick("block").alias("distrust")), "judged")
    rows = ruled.join(judged, "host", "left").fillna(0.0, ["trust", "distrust"])
    more, both = F.col("distrust") - F.col("trust"), F.col("distrust") + F.col("trust")
    balance = F.when(both > 0, F.round(more / both, 9)).otherwise(0.0)
    verdict = F.coalesce("action", F.when(balance > threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
