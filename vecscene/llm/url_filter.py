"""URL filters in DataFrame functions only: host and path rules, then trust and distrust over the link graph of hosts.

Where no rule speaks, a host's verdict follows from personalised PageRank: trust flows along links from hosts with allowed
pages, distrust flows against them from hosts with blocked pages (who links to a bad host is suspect).  Edges are the
links of the pages that name a host, of any scheme or none, counted per pair of hosts, and each host's link both ways with
the nearest domain above it that is a host itself.  Steps go on until the scores of all hosts together change by less than
TOLERANCE.  A host is blocked if its distrust exceeds its trust.  Page and link counts are summed before any shuffle, so a
host that holds a third of all pages is one row of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize

#: Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DAMPING, TOLERANCE = 0.85, 1e-6
#: Steps between two tables of scores, of which the last is measured.
STRIDE = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule (struct of n, rule, verdict) that fits a host or its subdomains and the beginning of the path."""
    all_ = F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, v in rules])
    fits = F.filter(all_, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, n: links between different hosts, and of hosts with the nearest domains above them that are hosts."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    links = pages.where("html is not null").select(host_of(F.col("url")).alias("source"), F.explode(found).alias("target"))
    links = links.select("source", F.translate("target", _UPPER, _LOWER).alias("target")).where("source <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    links = materialize(links)
    hosts = links.select("source").unionByName(links.select(F.col("target").alias("source"))).unionByName(pages.select(host_of(F.col("url")).alias("source"))).distinct().where("source <> ''")
    hosts = materialize(hosts)
    parts = F.split("source", r"\.")
    above = hosts.select("source", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("far", "target"))
    steps = above.join(hosts.withColumnRenamed("source", "target"), "target").groupBy("source").agg(F.min_by("target", "far").alias("target"))
    one = F.lit(1).cast("long").alias("n")
    up, down = steps.select("source", "target", one), steps.select(F.col("target").alias("source"), F.col("source").alias("target"), one)
    return links.unionByName(up).unionByName(down).groupBy("source", "target").agg(F.sum("n").alias("n"))


def host_scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from edges (source, target, n) and seeds (host, good, bad: shares that sum to 1 each)."""
    out = edges.groupBy("source").agg(F.sum("n").alias("out"))
    into = edges.groupBy("target").agg(F.sum("n").alias("into"))
    full = edges.join(out, "source").join(into, "target")
    flow = materialize(
        full.select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("n") / F.col("out")).alias("good_share"), F.lit(0.0).alias("bad_share")).unionByName(
            full.select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0.0).alias("good_share"), (F.col("n") / F.col("into")).alias("bad_share"))
        )
    )
    zero = F.lit(0.0)
    hosts = flow.select("host").distinct().join(seeds, "host", "full").select("host", F.coalesce("good", zero).alias("good"), F.coalesce("bad", zero).alias("bad"))
    hosts = materialize(hosts)
    table, score = None, hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    while True:
        for k in range(STRIDE):
            came = flow.join(score.select("host", "trust", "distrust"), "host").groupBy("to").agg(F.sum(F.col("trust") * F.col("good_share")).alias("t"), F.sum(F.col("distrust") * F.col("bad_share")).alias("d"))
            new = hosts.join(came, hosts["host"] == came["to"], "left").select("host", ((1 - damping) * F.col("good") + damping * F.coalesce("t", zero)).alias("trust"), ((1 - damping) * F.col("bad") + damping * F.coalesce("d", zero)).alias("distrust"))
            if k == STRIDE - 1:
                new = new.join(score.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host").select("host", "trust", "distrust", (F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))).alias("moved"))
            score = new
        score = materialize(score)
        discard(table)
        table = score
        if (score.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            discard(flow, hosts)
            return score.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row.

    Urls that are null or have no :// get an empty host and path, no rule, and are allowed.  Hosts out of reach of all
    seeds have neither trust nor distrust and are allowed; so are hosts of equal trust and distrust.  Null html has no
    links, of links in texts of any length all count.  Repeated rows give repeated rows and count as pages of their own,
    an empty table gives none; other columns are not looked at.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))
    per_host = materialize(rows.where("by_rule is not null").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")))
    good, bad = per_host.agg(F.sum("good"), F.sum("bad")).first()
    seeds = per_host.select("host", (F.col("good") / F.lit(float(good or 1))).alias("good"), (F.col("bad") / F.lit(float(bad or 1))).alias("bad"))
    scores = host_scores(host_edges(pages), seeds)
    out = rows.join(scores, "host", "left")
    own = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
