"""Operator 5: URL filter rules, and link-graph propagation for what no rule decides. DataFrame functions only.

Trust starts at hosts by the share of their pages that allow rules fit and follows links, distrust starts by the share
that block rules fit and goes against links (who links to a blocked host is suspect). Both are personalised PageRank: with seeds
that add up to 1, score = (1 - damping) * seed + damping * inflow / degree, until no score moves by the tolerance, so scores add up
to 1 at most however many links there are. A host without pages starts by the share of the different URLs linked to at it.
Scores are given in units of one whole seed's own part, (1 - damping) / sum of the seeds, so that thresholds don't depend on
the size of the web: a host is blocked if its distrust is at least ``threshold`` of that and above its trust.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and verdict allow; null html has
no links; the longest fitting rule wins, of equally long ones the first given; repeated rows are judged each; very long urls and pages are read whole; an empty table
gives an empty result. Input columns other than the three named are left out, so their names can't clash.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, saved, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: More rules than this are joined by host suffix instead of being tried in turn.
INLINE_RULES = 200
BROADCAST_ROWS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules) -> DataFrame:
    """``pages`` (host, path and more) with rule and kind of the longest rule that fits, else nulls."""
    ranked = [(kind, rule, *rule.partition("/")[::2]) for kind, rule in sorted(rules, key=lambda r: -len(r[1]))]
    if len(ranked) <= INLINE_RULES:
        fit = F.lit(None).cast("struct<rule:string,kind:string>")
        for kind, rule, host, tail in reversed(ranked):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{tail}"))
            fit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"))).otherwise(fit)
        return pages.withColumn("_fit", fit).select("*", "_fit.rule", "_fit.kind").drop("_fit")
    spark = pages.sparkSession
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(ranked)], "r_order int, r_kind string, r_rule string, r_host string, r_tail string")
    listed = F.broadcast(listed) if len(ranked) <= BROADCAST_ROWS else listed
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = pages.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes)).join(listed, (F.col("_suffix") == F.col("r_host")) & F.expr("startswith(path, concat('/', r_tail))"))
    best = tried.groupBy("host", "path").agg(F.min_by(F.struct(F.col("r_rule").alias("rule"), F.col("r_kind").alias("kind")), "r_order").alias("_fit"))
    return pages.join(best, ["host", "path"], "left").select("*", "_fit.rule", "_fit.kind").drop("_fit")


def links_of(pages: DataFrame) -> DataFrame:
    """Distinct (src, host, path) of links to other hosts; pages has host and html."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*(\"\s*[a-z][a-z0-9+.-]*://[^\"<>]*|'\s*[a-z][a-z0-9+.-]*://[^'<>]*|[a-z][a-z0-9+.-]*://[^\s>\"']*)"), F.lit(1))
    links = pages.filter(F.contains("html", F.lit("://"))).select(F.col("host").alias("src"), F.explode(F.array_distinct(found)).alias("url"))
    host, path = host_and_path(F.regexp_replace("url", r"[\s\"']+$", ""))
    return links.select("src", F.regexp_replace(host, r"(?s)[\s\"'>].*$", "").alias("host"), path.alias("path")).filter("src <> '' and host <> '' and src <> host").distinct()


def propagated(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """Personalised PageRank (host, score) from seeds (host, seed) along edges src -> dst, in units of a whole seed's own part; a node passes
    its score on in equal shares. It ends when no score moves by the tolerance in these units, since what moves shrinks by damping a
    round; raises if ``rounds`` are given and don't suffice."""
    if not (0 <= damping < 1 and tolerance > 0):
        raise ValueError("damping must be in [0, 1) and tolerance above 0")
    total = seeds.agg(F.sum("seed").alias("n")).first()["n"] or 1.0
    unit = (1 - damping) / total
    own = saved(seeds.select("host", (F.col("seed") * unit).alias("part")), "url-seed")
    shares = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = saved(edges.join(shares, "src"), "url-weighted")
    score = saved(own.select("host", F.col("part").alias("score")), "url-score")
    for k in count():
        if k == rounds:
            raise RuntimeError(f"scores still change after {rounds} rounds")
        flow = weighted.join(score, weighted.src == score.host).groupBy("dst").agg((damping * F.sum(F.col("score") / F.col("degree"))).alias("flow"))
        both = own.join(flow, own.host == flow.dst, "full_outer").select(F.coalesce("host", "dst").alias("host"), (F.coalesce("part", F.lit(0.0)) + F.coalesce("flow", F.lit(0.0))).alias("score"))
        old, score = score, saved(both, "url-score")
        moved = score.join(old.select("host", F.col("score").alias("was")), "host", "left").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))).alias("d")).first()["d"]
        discard(old)
        if (moved or 0) < tolerance * unit:
            break
    discard(weighted)
    return score.select("host", (F.col("score") / unit).alias("score"))


def judged_hosts(pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4, threshold: float = 0.5) -> DataFrame:
    """host, trust, distrust, blocked, for pages with host, html and kind. One saved row per host."""
    share = lambda k: F.avg(F.when(F.col("kind") == k, 1.0).otherwise(0.0))
    seeds = saved(pages.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "url-seeds")
    links = saved(links_of(pages), "url-links")
    edges = saved(links.select("src", F.col("host").alias("dst")).distinct(), "url-edges")
    if edges.isEmpty():
        scores = seeds
    else:
        targets = links.select("host", "path").distinct().join(seeds.select("host"), "host", "left_anti")
        linked = with_rules(targets, rules).groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
        seeds = saved(seeds.unionByName(linked), "url-seeds")
        trust = propagated(edges, seeds.filter("trust > 0").select("host", F.col("trust").alias("seed")), damping, rounds, tolerance)
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        distrust = propagated(back, seeds.filter("distrust > 0").select("host", F.col("distrust").alias("seed")), damping, rounds, tolerance)
        scores = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full_outer")
        scores = scores.select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    return saved(scores.withColumn("blocked", (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))), "url-hosts")


def filter_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row."""
    host, path = host_and_path(F.col(url))
    seen = with_rules(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html")), rules)
    hosts = judged_hosts(seen, rules, **options).select(F.col("host").alias("_host"), "trust", "distrust", "blocked")
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    joined = seen.drop("html").join(hosts, F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("kind", method).alias("verdict"), "trust", "distrust")


def op5_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


#: Hosts, paths, rules and the verdicts that follow from a host's own pages. Propagation is left out: this holds for pages without absolute
#: links to other hosts, as the given ones are; with links the operator is held against brute force in its tests.
OP5_SQL = r"""
with r(place, kind, rule, rhost, tail) as (values (1, 'allow', 'example.com/en/7', 'example.com', '/en/7'), (2, 'block', 'example.net/de/8', 'example.net', '/de/8'),
        (3, 'block', 'com/en/', 'com', '/en/'), (4, 'allow', 'net/de/', 'net', '/de/'), (5, 'block', 'org/es/', 'org', '/es/')),
u as (select page_id, row_number() over () as n, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select n, min_by(rule, place) as rule, min_by(kind, place) as kind from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, tail) group by n),
f as (select h.*, m.rule, m.kind from h left join m using (n)),
s as (select host, avg((kind is not null and kind = 'allow')::int)::double as trust, avg((kind is not null and kind = 'block')::int)::double as distrust from f where host <> '' group by host)
select page_id, f.host, path, rule, coalesce(kind, case when distrust >= 0.5 and distrust > trust then 'block' else 'allow' end) as verdict, trust, distrust from f left join s on f.host = s.host
"""
