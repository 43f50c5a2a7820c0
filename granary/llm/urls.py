"""URL filters: rules by host and path, and for the rest trust and distrust that spread over the link graph of hosts.

Personalised PageRank starts from the hosts that rules allow and follows links; distrust starts from those that rules
block and follows links backwards, to the hosts that link there. A host's score is the difference of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict); a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, TOLERANCE = 0.85, 1e-6
#: A host is blocked from this much distrust over trust on, each in units of what a host scores that is a seed with all its
#: pages and that no link reaches or leaves.
BLOCK_FROM = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no host."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host and subdomains, beginning of the path), else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith("/" + tail)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from a page's host to another host, counted; from ``href`` and ``src`` with a host."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?(//[^"'\s>]*)"""), F.lit(1))
    found = pages.select(F.col("host").alias("src"), F.explode(links).alias("link"))
    found = found.select("src", host_of(F.concat(F.lit("x:"), F.col("link"))).alias("dst"))
    return found.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): what seeds (host, weight) spread over edges (src, dst, n), in equal shares by link, in units of a seed
    of weight 1 without links.

    Personalised PageRank: a host has (1 - damping) times its weight, and damping times what links bring; what hosts without
    links out would send goes back to the seeds by weight. Steps are repeated until no score moves by more than
    ``tolerance``; since each step shrinks the differences by ``damping``, that takes at most log(tolerance) / log(damping)
    steps. A step is a join and a grouping by host, written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "flow")
    ends = flow.select(F.col("dst").alias("host"), F.lit(0.0).alias("weight"), F.lit(False).alias("sends"))
    starts = flow.select(F.col("src").alias("host"), F.lit(0.0).alias("weight"), F.lit(True).alias("sends"))
    hosts = seeds.select("host", F.col("weight").cast("double").alias("weight"), F.lit(False).alias("sends")).unionByName(ends).unionByName(starts)
    hosts = materialize(hosts.groupBy("host").agg(F.max("weight").alias("weight"), F.max("sends").alias("sends")), "seeds")
    total, stays = hosts.agg(F.sum("weight"), F.sum(F.when(~F.col("sends"), F.col("weight")))).first()
    if not total:
        return hosts.select("host", F.lit(0.0).alias("score"))
    now = hosts.withColumn("score", F.col("weight"))
    while True:
        back = (1 - damping) + damping * (stays or 0.0) / total
        sent = flow.join(now.select("host", "score"), F.col("src") == F.col("host")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        score = F.col("weight") * back + F.coalesce("got", F.lit(0.0)) * damping
        after = now.join(sent, F.col("host") == F.col("to"), "left").select("host", "weight", "sends", F.col("score").alias("old"), score.alias("score"))
        after = materialize(after, "scores")
        moved, stays = after.agg(F.max(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(~F.col("sends"), F.col("score")))).first()
        now = after.drop("old")
        if moved <= tolerance:
            return after.select("host", (F.col("score") / back).alias("score"))


def judge(pages: DataFrame, rules=RULES, block_from: float = BLOCK_FROM, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, trust, distrust, verdict of pages (page_id, url, html).

    A rule's verdict is its own; the others' is ``block`` if their host's distrust less trust reaches ``block_from``,
    else ``allow``. A host is a seed by the share of its pages that rules allow or block. Null or odd urls have an empty
    host and path, no rule, and are allowed; null html has no links; repeated rows are judged each; a null page_id stays.
    Hosts meet pages by a join on the host, which adaptive execution splits where a host is hot. Columns beyond the
    three are not read.
    """
    own = pages.select("page_id", "url", "html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    kind = F.lit(None).cast("string")
    for rule, verdict in rules:
        kind = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(kind)
    own = own.withColumn("kind", kind)
    with scratch(pages.sparkSession) as work:
        good, bad = F.count(F.when(F.col("kind") == "allow", 1)), F.count(F.when(F.col("kind") == "block", 1))
        hosts = own.filter("host != ''").groupBy("host").agg((good / F.count("*")).alias("good"), (bad / F.count("*")).alias("bad"))
        hosts = materialize(hosts, "hosts")
        edges = materialize(host_edges(own), "host-edges")
        trust = spread(hosts.select("host", F.col("good").alias("weight")), edges, damping).withColumnRenamed("score", "trust")
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        distrust = spread(hosts.select("host", F.col("bad").alias("weight")), back, damping).withColumnRenamed("score", "distrust")
        scores = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").fillna(0.0, ["trust", "distrust"])
        scores = materialize(scores, "scores")
        work.keep(scores)
    blocked = F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= block_from
    judged = own.select("page_id", "host", "path", "rule", "kind").join(scores, "host", "left")
    spread_ = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("trust", "distrust")]
    return judged.select("page_id", "host", "path", "rule", *spread_, F.coalesce("kind", F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH RECURSIVE own AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM own
), kinds AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS kind FROM ruled
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (kind = 'allow') / count(*) AS good, count(*) FILTER (kind = 'block') / count(*) AS bad
  FROM kinds WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?(//[^"''\s>]*)', 1)) AS link FROM kinds
), edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, translate(regexp_extract('x:' || link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM links)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), forward AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
backward AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM edges),
nodes AS (
  SELECT name AS host, coalesce(any_value(good), 0) AS good, coalesce(any_value(bad), 0) AS bad,
    name IN (SELECT src FROM edges) AS sends, name IN (SELECT dst FROM edges) AS receives
  FROM (SELECT host AS name FROM hosts UNION SELECT src FROM edges UNION SELECT dst FROM edges) LEFT JOIN hosts ON host = name GROUP BY name
), seeds AS (SELECT nullif(sum(good), 0) AS good, nullif(sum(bad), 0) AS bad FROM nodes),
score AS (
  SELECT 0 AS step, host, good AS t, bad AS d, sends, receives, 1.0::DOUBLE AS ut, 1.0::DOUBLE AS ud FROM nodes
  UNION ALL
  SELECT step + 1, host, good * ut + 0.85 * got_t, bad * ud + 0.85 * got_d, sends, receives, ut, ud
  FROM (
    SELECT max(s.step) AS step, v.host, any_value(v.good) AS good, any_value(v.bad) AS bad, any_value(v.sends) AS sends, any_value(v.receives) AS receives,
      0.15 + 0.85 * coalesce(sum(s.t) FILTER (NOT s.sends) / any_value(w.good), 0) AS ut,
      0.15 + 0.85 * coalesce(sum(s.d) FILTER (NOT s.receives) / any_value(w.bad), 0) AS ud,
      coalesce(sum(f.share * s.t), 0) AS got_t, coalesce(sum(b.share * s.d), 0) AS got_d
    FROM nodes v CROSS JOIN score s CROSS JOIN seeds w LEFT JOIN forward f ON f.src = s.host AND f.dst = v.host LEFT JOIN backward b ON b.src = s.host AND b.dst = v.host
    WHERE s.step < 140 GROUP BY v.host
  )
), last AS (SELECT host, t / ut AS t, d / ud AS d FROM score WHERE step = 140)
SELECT page_id, k.host, path, rule, coalesce(kind, CASE WHEN coalesce(d - t, 0) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM kinds k LEFT JOIN last ON k.host = last.host
"""
