"""URL filter: rules, and link-graph propagation over host edges.

Rules judge the pages they fit.  A host's share of pages that rules allow is its trust seed, the
share that rules block its distrust seed.  Trust flows forward along links between hosts
(personalised PageRank from the trusted seeds); distrust flows backward (a host that links to
blocked hosts is distrusted), by the same walk on the reversed edges.  Pages without a rule get
their host's verdict: block where distrust exceeds trust by ``THRESHOLD`` of what a fully seeded
host holds by itself.

All of it is DataFrame code.  Edges are summed by host pair before the first join, so a host with a
third of all pages is one row a partner.  Both walks move together, as two kinds of rows.  Ranks only
rise, by 0.85 of a round's rise in the next, so the walk goes on until no host gains more than
``TOLERANCE`` any more; every few rounds are one job whose result is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The rules that the query applies, as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DAMPING = 0.85
#: The walk ends when no host's rank rises by more in a stride of rounds.
TOLERANCE = 1e-8
#: Rounds between two written results, each with a test for the end.
STRIDE = 6
THRESHOLD = 0.5
MAX_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_behind(url), r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _behind(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equals, block first and then by text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]), reverse=True):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, summed."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("link"))
    url = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    pairs = links.select("src", host_of(url).alias("dst")).filter("src <> dst AND src <> '' AND dst <> ''")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): the solution of rank = (1 - damping) seed + damping * the ranks that flow in,
    for each kind of walk, to ``tolerance`` a round.

    ``edges``: (kind, src, dst, w) with the weights of a source summing to one; ``seeds``: (kind, host,
    seed).  A source without edges keeps nothing of its flow; a host without a seed starts with none,
    and appears where a flow reaches it.  Without seeds or edges the ranks are the seeds' own."""
    spark = edges.sparkSession
    edges = edges.withColumnRenamed("kind", "k")
    own = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("own"))
    own = common.materialize(own, "own")
    held, path, moved = own.withColumnRenamed("own", "rank"), None, 1.0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    while moved > tolerance:
        ranks = held
        for _ in range(STRIDE):
            flow = edges.join(ranks, (F.col("k") == F.col("kind")) & (F.col("src") == F.col("host"))).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("w") * F.col("rank"))).alias("flow"))
            ranks = own.join(flow, ["kind", "host"], "full").select("kind", "host", (zero("own") + zero("flow")).alias("rank"))
        # What a whole stride moves is no less than what its last round does.
        before = held.withColumnRenamed("rank", "before")
        risen = ranks.join(before, ["kind", "host"], "left").select("kind", "host", "rank", (F.col("rank") - zero("before")).alias("moved"))
        held, new = common.written(risen, "ranks")
        moved = held.agg(F.max("moved")).first()[0] or 0.0
        held = held.drop("moved")
        if path:
            common.drop(spark, path)
        path = new
    return held


def host_scores(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from judged pages (host, rule_verdict) and host edges (src, dst, n)."""
    share = lambda verdict: F.avg(F.when(F.col("rule_verdict") == verdict, 1.0).otherwise(0.0))
    seeds = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    seeds = common.materialize(seeds, "seeds")
    edges = common.materialize(edges, "edges")
    if edges.isEmpty():
        return seeds.select("host", ((1 - DAMPING) * F.col("good")).alias("trust"), ((1 - DAMPING) * F.col("bad")).alias("distrust"))
    both = edges.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "n") for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src"))])).alias("e")).select("e.*")
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    walk = common.materialize(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "walk")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "good", F.lit("distrust"), "bad")).alias("kind", "seed"))
    ranks = propagate(walk, start.select("kind", "host", "seed"))
    by_kind = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind) for kind in ("trust", "distrust")]
    return ranks.groupBy("host").agg(*by_kind)


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, no rule, and are allowed; null
    html has no links.  Repeated rows each count and each get a row."""
    common.prepare(pages.sparkSession)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    judged = common.materialize(parsed.select("page_id", "host", "path", rule.alias("rule"), kind.alias("rule_verdict")), "judged")
    hosts = host_scores(judged.select("host", "rule_verdict"), host_edges(pages.select("url", "html")))
    blocked = hosts.filter(F.round(F.col("distrust") - F.col("trust"), 6) >= round(threshold * (1 - DAMPING), 6)).select("host", F.lit("block").alias("host_verdict"))
    out = judged.join(blocked, "host", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """The same in SQL: each walk as the sum of what its rounds move, until that is too little."""
    cases = sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))

    def case(pick):
        when = " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{pick(v, t)}'" for v, t in cases)
        return f"CASE {when} END"

    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    low = f"'{_UPPER}', '{_LOWER}'"
    parts = [
        f"u AS MATERIALIZED (SELECT page_id, html, coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), {low}), '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT page_id, host, path, {case(lambda v, t: t)} AS rule, {case(lambda v, t: v)} AS rv FROM u)",
        "l AS MATERIALIZED (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\\s>]+)', 1)) AS link FROM u)",
        f"p AS MATERIALIZED (SELECT src, translate(regexp_extract(substr(link, strpos(link, '//') + 2), '^[^/?#]*'), {low}) AS dst FROM l)",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM p WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL)",
        "s AS MATERIALIZED (SELECT host, avg(CASE WHEN rv = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN rv = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM j WHERE host <> '' GROUP BY host)",
        "w AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e)",
        f"m(step, kind, host, moved) AS (SELECT 0, kind, host, {1 - DAMPING} * seed FROM (SELECT 'trust' AS kind, host, good AS seed FROM s UNION ALL SELECT 'distrust', host, bad FROM s) WHERE seed > 0"
        f" UNION ALL SELECT step + 1, m.kind, dst, {DAMPING} * sum(w * moved) FROM m JOIN w ON w.kind = m.kind AND src = host GROUP BY step, m.kind, dst HAVING sum(w * moved) > {TOLERANCE / 100})",
        "h AS (SELECT host, coalesce(sum(moved) FILTER (kind = 'distrust'), 0) - coalesce(sum(moved) FILTER (kind = 'trust'), 0) AS over FROM m GROUP BY host)",
        f"b AS (SELECT host FROM h WHERE round(over, 6) >= {round(THRESHOLD * (1 - DAMPING), 6)})",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(rv, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM j"
