"""URL filters: rules by host and path, and link-graph propagation for what no rule fits.

Host edges come from the pages: absolute links (a relative one stays on its host), the host named in a page's
copyright line (if `owners`), and a host's parent where that is a host of pages itself (if `parents`). They are
counted by (from, to) before anything is joined, so a hot host has at most a row for each other host.

Trust starts at the hosts of pages that an allow rule fits, by their number, and follows the edges (personalised
PageRank); distrust starts at the hosts of blocked pages and follows the edges backwards, to those who point there.
Mass at a host without edges goes back to the seeds, which only scales all masses alike, so it is done once at the
end. Rounds go on until no host's mass changes by more than the part TOLERANCE of it in a round, so every host that a
path joins to a seed is reached. A host is blocked if its distrust exceeds its trust by more than the part SHARE of
their sum, whatever the size of the table, else allowed; hosts that nothing reaches are allowed.

The SQL is of the same definition; it goes on for SQL_ROUNDS rounds, by when the masses of its tables have settled.

Everything is a DataFrame operation; the masses are written in every round, so a plan is one round long and a lost
executor costs little.

Cases: a null url, or one without ://, has an empty host and path and the verdict allow; null html has no links;
repeated pages count again; without rules that fit, nothing is blocked; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sized, table

#: verdict, host, path; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, SHARE = 0.8, 1e-7, 1e-6
SQL_ROUNDS = 128
LINK = r"(?i)<(?:a|area|link|iframe|img|script)\b[^>]*?\s(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^\"'\s>/?#]+)"
OWNER = r"(?:&copy;|©)\s*([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The index of the longest rule that fits, else null."""
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*(F.when(fits(*rules[k][1:]), F.lit(k)) for k in order), F.lit(None).cast("int"))


def edges_of(pages: DataFrame, owners: bool = True, parents: bool = True) -> DataFrame:
    """src, dst, w: how many pages of src point to another host dst. pages: host, html."""
    html = F.coalesce("html", F.lit(""))
    named = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    if owners:
        named = F.concat(named, F.regexp_extract_all(html, F.lit(OWNER), F.lit(1)))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(named, _lower))).alias("dst"))
    if parents:
        hosts = pages.select("host").where("host <> ''").distinct()
        parent = F.regexp_replace("src", r"^[^.]*\.?", "")
        site = hosts.select(F.col("host").alias("src")).withColumn("dst", parent).join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst")
        found = found.unionByName(site)
    return found.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust. seeds: host, t0, d0, each summing to 1 (or 0)."""
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("into"))
    e = cut(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("w") / F.col("out")).alias("forth"), (F.col("w") / F.col("into")).alias("back")))
    nodes = e.select(F.col("src").alias("host")).unionByName(e.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    r = cut(nodes.join(seeds, "host", "left").fillna(0.0, ["t0", "d0"]).select("host", "t0", "d0", F.col("t0").alias("trust"), F.col("d0").alias("distrust")))
    zero = lambda *names: [F.lit(0.0).alias(x) for x in names]
    # masses only grow, and once all that can be reached is, the largest change of a round, as a part of the mass, shrinks
    grew = lambda now, was: F.col(now) - F.col(was) > tolerance * F.col(now)
    moves = True
    while moves:
        forth = e.join(r, e["src"] == r["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), *zero("d", "t0", "d0", "t1", "d1"))
        back = e.join(r, e["dst"] == r["host"]).select(F.col("src").alias("host"), (F.col("distrust") * F.col("back")).alias("d"), *zero("t", "t0", "d0", "t1", "d1"))
        own = r.select("host", "t0", "d0", F.col("trust").alias("t1"), F.col("distrust").alias("d1"), *zero("t", "d"))
        come = own.unionByName(forth).unionByName(back).groupBy("host").agg(*(F.sum(x).alias(x) for x in ("t0", "d0", "t1", "d1", "t", "d")))
        step = cut(come.select("host", "t0", "d0", "t1", "d1", (F.col("t0") + damping * F.col("t")).alias("trust"), (F.col("d0") + damping * F.col("d")).alias("distrust")))
        moves = step.where(grew("trust", "t1") | grew("distrust", "d1")).limit(1).count() > 0
        r = step.select("host", "t0", "d0", "trust", "distrust")
    total = r.agg(F.sum("trust").alias("all_t"), F.sum("distrust").alias("all_d"))
    part = lambda m, of: F.coalesce(F.col(m) / F.nullif(F.col(of), F.lit(0.0)), F.lit(0.0)).alias(m)
    return r.crossJoin(F.broadcast(total)).select("host", part("trust", "all_t"), part("distrust", "all_d"))


def judged(pages: DataFrame, rules: tuple = RULES, owners: bool = True, parents: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host) of every page (page_id, url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("rule_no", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.array(*(F.lit(r[0]) for r in rules))
    by_rule = F.when(F.col("rule_no").isNotNull(), F.element_at(verdicts, F.col("rule_no") + 1))
    slim = cut(rows.select("page_id", "host", "path", "rule_no", by_rule.alias("by_rule")))
    edges = edges_of(rows.select("host", "html"), owners, parents)
    counts = slim.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    total = counts.agg(F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
    part = lambda n, of: F.coalesce(F.col(n) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    seeds = cut(counts.crossJoin(F.broadcast(total)).select("host", part("allowed", "all_allowed").alias("t0"), part("blocked", "all_blocked").alias("d0")))
    ranks = propagate(cut(edges), seeds)
    names = F.array(*(F.lit(h + p) for _, h, p in rules))
    found = slim.join(sized(ranks), "host", "left").withColumn("rule", F.when(F.col("rule_no").isNotNull(), F.element_at(names, F.col("rule_no") + 1)))
    by_graph = F.when(F.col("distrust") - F.col("trust") > SHARE * (F.col("distrust") + F.col("trust")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in SQL, the rounds as a recursive table."""
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    says = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in order)
    low = lambda x: f"translate({x}, '{_UPPER}', '{_UPPER.lower()}')"
    link, owner = LINK.replace("'", "''"), OWNER
    return f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT page_id, {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
q AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE (CASE {rule} END) {says} END AS by_rule FROM p),
named AS (
  SELECT host AS src, unnest(list_distinct(list_transform(list_concat(regexp_extract_all(html, '{link}', 1), regexp_extract_all(html, '{owner}', 1)), lambda x: {low("x")}))) AS dst FROM p WHERE host <> ''),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
w AS MATERIALIZED (
  SELECT src, dst, count(*)::DOUBLE AS w FROM (
    SELECT src, dst FROM named UNION ALL
    SELECT host, regexp_replace(host, '^[^.]*\\.?', '') FROM hosts WHERE regexp_replace(host, '^[^.]*\\.?', '') IN (SELECT host FROM hosts))
  WHERE src <> dst GROUP BY ALL),
e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS forth, w / sum(w) OVER (PARTITION BY dst) AS back FROM w),
s AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM q WHERE host <> '' GROUP BY host),
n AS MATERIALIZED (
  SELECT h.host, coalesce(s.a / nullif((SELECT sum(a) FROM s), 0), 0)::DOUBLE AS t0, coalesce(s.b / nullif((SELECT sum(b) FROM s), 0), 0)::DOUBLE AS d0
  FROM (SELECT host FROM hosts UNION SELECT src FROM e UNION SELECT dst FROM e) h LEFT JOIN s ON s.host = h.host),
r AS (
  SELECT 0 AS k, host, t0, d0, t0 AS trust, d0 AS distrust FROM n
  UNION ALL
  SELECT any_value(k) + 1, host, sum(t0), sum(d0), sum(t0) + {DAMPING} * sum(t), sum(d0) + {DAMPING} * sum(d) FROM (
    SELECT k, host, t0, d0, 0.0 AS t, 0.0 AS d FROM r
    UNION ALL SELECT k, e.dst, 0, 0, trust * forth, 0 FROM r JOIN e ON e.src = r.host
    UNION ALL SELECT k, e.src, 0, 0, 0, distrust * back FROM r JOIN e ON e.dst = r.host)
  GROUP BY host HAVING any_value(k) < {SQL_ROUNDS}),
m AS MATERIALIZED (
  SELECT host, coalesce(trust / nullif(sum(trust) OVER (), 0), 0) AS trust, coalesce(distrust / nullif(sum(distrust) OVER (), 0), 0) AS distrust FROM r WHERE k = {SQL_ROUNDS})
SELECT q.page_id, q.host, q.path, q.rule,
       coalesce(by_rule, CASE WHEN coalesce(m.distrust - m.trust > {SHARE} * (m.distrust + m.trust), false) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m ON m.host = q.host
"""


SQL = _sql()
