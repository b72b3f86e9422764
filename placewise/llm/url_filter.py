"""URL filter: rules on hosts and paths, and for the rest trust and distrust that travel along links between hosts.

Trust starts at hosts whose pages the rules allow and follows links; distrust starts at hosts whose pages they block and
follows links backwards. Trust is personalised PageRank over host edges: each round a host hands `DAMPING` of its score on,
in proportion to the pages that link. Distrust is the other end of the same walk: the chance that a reader who starts at the
host, goes on with `DAMPING` and else stops, stops at a blocked page. It depends on where a host's own links go, not on how
many others link there too. A host is blocked when its distrust exceeds its trust and is `LEAST` or more.

Hosts that have no page of their own but are linked to count too: the rules are applied to the paths of those links.

Pages are reduced to distinct host pairs with map-side counts before anything iterates; both walks share one edge table,
one join and one aggregate a round, and scores are stored every round, which cuts the lineage. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.llm.storage import discarded, stored

DAMPING = 0.85
#: The walks end when no score moves by this much; what they leave out of a distrust is less than six times it.
TOLERANCE = 1e-6
#: As much distrust as an unlinked host has that the rules block in half of its pages, or a host with no pages blocked that sends 59% of its links to wholly blocked hosts.
LEAST = 0.5 * (1 - DAMPING)
#: Host rows (host, its rules, scores) that may be broadcast: some 200 bytes each.
BROADCAST_HOSTS = 200_000

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)([^?#"'\s>]*)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without `://`."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and `rules`, those that fit it or a parent domain, longest first. A rule without host or path fits nothing.

    Of a host only the parents with as many labels as some rule are spelled out, so a long host costs its length.
    """
    labels = F.split("host", r"\.")
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    places = F.sequence(F.greatest(F.size(labels) - (most - 1), F.lit(1)), F.size(labels))
    parents = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.select("host", F.explode(F.array_distinct(parents)).alias("rule_host")).join(_small(rules, BROADCAST_HOSTS), "rule_host")
    rule = F.concat("rule_host", "rule_path")
    held = fitting.where("rule_path IS NOT NULL").groupBy("host").agg(F.collect_set(F.struct((-F.length(rule)).alias("order"), rule.alias("rule"), "rule_path", "rule_verdict")).alias("rules"))
    return held.select("host", F.array_sort("rules").alias("rules"))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and rule_verdict (null without a rule) of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    return with_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)


def with_rules(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of `parsed` (host, path and others) with rule and rule_verdict."""
    known = stored(host_rules(parsed.select("host").distinct(), rules), "host-rules")
    found = parsed.join(_small(known, BROADCAST_HOSTS), "host", "left")
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return found.select(*parsed.columns, best["rule"].alias("rule"), best["rule_verdict"].alias("rule_verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """Links with a host of their own, of pages of other hosts, in one pass over the texts: rows of two kinds.

    With a null path: origin, target and pages of every pair of hosts. With a null origin: every target and path once.
    """
    host, _ = host_and_path(F.col("url").cast("string"))
    pieces = F.split(F.coalesce(F.col("html").cast("string"), F.lit("")), r"""(?i)href\s*=\s*["']?""")
    named = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.struct(F.translate(F.regexp_extract(p, _LINK, 1), _UPPER, _LOWER).alias("target"), F.regexp_extract(p, _LINK, 2).alias("path")))
    named = F.array_distinct(F.filter(named, lambda t: (t["target"] != "") & (t["target"] != F.col("origin"))))
    kind = lambda origin, target, path: F.struct(origin.cast("string").alias("origin"), target.alias("target"), path.cast("string").alias("path"))
    pairs = F.transform(F.array_distinct(F.transform("named", lambda t: t["target"])), lambda t: kind(F.col("origin"), t, F.lit(None)))
    places = F.transform("named", lambda t: kind(F.lit(None), t["target"], t["path"]))
    texts = pages.select(host.alias("origin"), "html").where("origin <> ''")
    rows = texts.select("origin", named.alias("named")).where(F.size("named") > 0).select(F.inline(F.concat(pairs, places)))
    return rows.groupBy("origin", "target", "path").agg(F.count("*").alias("pages"))


def propagated(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust and distrust from seeds (host, trust, distrust), iterated until no score moves by `tolerance`.

    An edge hands trust to its target and distrust to its origin, both in shares of the origin's links: a host's distrust is
    the mean of its targets', so any number of hosts that link alike get the same.
    Hosts that are not in `seeds` start at zero. The moves of all hosts together shrink by `damping` a round or faster, so the
    loop ends.
    """
    total = edges.groupBy("origin").agg(F.sum("pages").alias("all"))
    shares = edges.join(total, "origin").select("origin", "target", (F.col("pages") / F.col("all")).alias("share"))
    ways = F.array(*[F.struct(F.lit(i).alias("walk"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate((("origin", "target"), ("target", "origin")))])
    moves = stored(shares.select(F.inline(ways), "share"), "host-moves")
    start = seeds.select(F.col("host").alias("a"), F.explode(F.array(F.struct(F.lit(0).alias("walk"), F.col("trust").alias("seed")), F.struct(F.lit(1).alias("walk"), F.col("distrust").alias("seed")))).alias("s"))
    start = start.select("s.walk", "a", ((1 - damping) * F.col("s.seed")).alias("seed")).unionAll(moves.select("walk", F.col("b").alias("a"), F.lit(0.0).alias("seed")).distinct())
    start = stored(start.groupBy("walk", "a").agg(F.sum("seed").alias("seed")), "host-seeds")
    start_scores = start.withColumnRenamed("seed", "score")
    scores, moved = start_scores, tolerance
    while moved >= tolerance:
        handed = moves.join(scores, ["walk", "a"]).groupBy("walk", F.col("b").alias("a")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        after = start.join(handed, ["walk", "a"], "left").select("walk", "a", (F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        after = stored(after, "host-scores")
        moved = after.join(scores.withColumnRenamed("score", "old"), ["walk", "a"]).agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        if scores is not start_scores:
            discarded(scores)
        scores = after
    return scores.groupBy(F.col("a").alias("host")).agg(*[F.max(F.when(F.col("walk") == i, F.col("score"))).alias(n) for i, n in enumerate(("trust", "distrust"))])


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    A page without a host is allowed unless a rule says otherwise; null html has no links; repeated rows are judged each;
    columns besides page_id, url and html are not read. A host without a page is known by the distinct paths that others link to.
    """
    found = ruled(pages, rules)
    links = stored(host_links(pages), "host-links")
    edges = links.where("path IS NULL").select("origin", "target", "pages")
    linked = links.where("origin IS NULL").select(F.col("target").alias("host"), "path").join(found.select("host").distinct(), "host", "left_anti")
    known = found.where("host <> ''").select("host", "rule_verdict").unionAll(with_rules(linked, rules).select("host", "rule_verdict"))
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seeds = known.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = stored(propagated(seeds, edges), "host-trust")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= LEAST)
    verdict = F.coalesce("rule_verdict", F.when(bad, "block"), F.lit("allow"))
    return found.join(_small(scores, BROADCAST_HOSTS), "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of all pages."""
    return judged(spark.read.parquet(f"{folder}/pages.parquet"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link = r"""(?i)href\s*=\s*["'']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''\s>]+)([^?#"''\s>]*)"""
    fitting = "(host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)"
    return rf"""
WITH RECURSIVE rest AS (
    SELECT row_number() OVER () AS place, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parsed AS (
    SELECT place, page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rule_host, rule_path, rule_verdict) AS (VALUES {listed}
), found AS (
    SELECT place, page_id, html, host, path, rule_host || rule_path AS rule, rule_verdict FROM parsed LEFT JOIN rules ON {fitting}
    QUALIFY row_number() OVER (PARTITION BY place ORDER BY length(rule_host || rule_path) DESC) = 1
), links AS (
    SELECT DISTINCT place, host AS origin, translate(t, '{_UPPER}', '{_LOWER}') AS target, p AS path FROM (
        SELECT place, host, unnest(regexp_extract_all(html, '{link}', 1)) AS t, unnest(regexp_extract_all(html, '{link}', 2)) AS p FROM parsed)
    WHERE host <> '' AND host <> translate(t, '{_UPPER}', '{_LOWER}')
), linked AS (
    SELECT DISTINCT target AS host, path FROM links WHERE target NOT IN (SELECT host FROM parsed)
), linked_ruled AS (
    SELECT host, path, rule_verdict FROM linked LEFT JOIN rules ON {fitting}
    QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC) = 1
), seeds AS (
    SELECT host, avg(CASE WHEN rule_verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN rule_verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
    FROM (SELECT host, rule_verdict FROM found WHERE host <> '' UNION ALL SELECT host, rule_verdict FROM linked_ruled) GROUP BY host
), edges AS (
    SELECT origin, target, count(DISTINCT place) AS pages FROM links GROUP BY origin, target
), shares AS (
    SELECT origin, target, pages / sum(pages) OVER (PARTITION BY origin) AS share FROM edges
), moves AS (
    SELECT 0 AS walk, origin AS a, target AS b, share FROM shares UNION ALL SELECT 1, target, origin, share FROM shares
), start AS (
    SELECT walk, a, sum(seed) AS seed FROM (
        SELECT 0 AS walk, host AS a, {1 - DAMPING} * trust AS seed FROM seeds UNION ALL SELECT 1, host, {1 - DAMPING} * distrust FROM seeds
        UNION ALL SELECT DISTINCT walk, b, 0.0 FROM moves) GROUP BY walk, a
), scores(turn, walk, a, score, moved) AS (
    SELECT 0, walk, a, CAST(seed AS DOUBLE), CAST('inf' AS DOUBLE) FROM start
    UNION ALL
    SELECT turn + 1, walk, a, score, max(abs(score - old)) OVER () FROM (
        SELECT p.turn, s.walk, s.a, s.seed + {DAMPING} * coalesce(sum(q.score * m.share), 0.0) AS score, any_value(p.score) AS old
        FROM start s JOIN scores p ON s.walk = p.walk AND s.a = p.a AND p.moved >= {TOLERANCE}
        LEFT JOIN moves m ON m.walk = s.walk AND m.b = s.a LEFT JOIN scores q ON q.walk = m.walk AND q.a = m.a GROUP BY p.turn, s.walk, s.a, s.seed)
), last AS (
    SELECT * FROM scores WHERE turn = (SELECT max(turn) FROM scores)
), blocked AS (
    SELECT t.a AS host FROM last t JOIN last d ON t.a = d.a AND t.walk = 0 AND d.walk = 1 WHERE d.score > t.score AND d.score >= {LEAST}
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict FROM found
"""


OP5_SQL = _op5_sql()
