"""URL filters: path rules first, then trust and distrust spread over the link graph of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, land, salted_left_join

#: Share of a score that follows links; the rest comes from the seeds.
DAMPING = 0.85
#: Rounds after which scores that still move are an error.
ROUNDS = 1000
#: Rounds end when no host was reached anew and no score moves by more than this share of itself.
TOLERANCE = 1e-3
#: A host is blocked when distrust is more than this share of its trust and distrust.
BLOCK_SHARE = 0.75

#: A link's address; group 1.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s<>]+)"""
#: The host of an absolute or protocol-relative address, group 1; and what begins neither a host nor a path: other schemes and places on the page itself.
LINK_HOST, NO_LINK = r"(?i)^(?:https?:)?//([^/?#]+)", "^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"


@dataclass(frozen=True)
class UrlRule:
    """``target`` is a host, then a path that begins with a slash; it fits the host, its subdomains, and longer paths."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


RULES = (UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"), UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; of equal length a block wins. For short lists: it is one CASE."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.target), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.target).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(ruled: DataFrame) -> DataFrame:
    """``kind, source, target, share``: links between hosts as they are (trust) and reversed (distrust), by share of the source's links."""
    links = ruled.select(F.col("host").alias("a"), F.explode("links").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = links.select(F.lit("trust").alias("kind"), F.col("a").alias("source"), F.col("b").alias("target"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("b").alias("source"), F.col("a").alias("target"), "n")
    )
    return both.join(both.groupBy("kind", "source").agg(F.sum("n").alias("all")), ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("all")).alias("share"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: ``score = (1 - damping) * seed + damping * sum(score of source * share)``, per ``kind``.

    ``seeds``: ``kind, node, seed``. Mass that reaches a host without links ends there; to give it back
    to the seeds would scale a kind's scores alike. Every round is one join and one aggregation over
    host rows, cut by a table in the shared folder, so a lost executor costs one round at most.
    """
    scores = seeds.select("kind", "node", "seed", (F.col("seed") * (1 - damping)).alias("score"))
    if edges.isEmpty():
        return scores
    for _ in range(rounds):
        flow = scores.join(edges, (scores.kind == edges.kind) & (scores.node == edges.source)).groupBy(edges.kind, F.col("target").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        after = (
            scores.join(flow, ["kind", "node"], "full")
            .select("kind", "node", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("score", F.lit(0.0)).alias("was"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
            .select("kind", "node", "seed", "was", (F.col("seed") * (1 - damping) + F.col("flow") * damping).alias("score"))
        )
        after = land(after, "scores")
        moved = after.agg(F.max(F.abs(F.col("score") - F.col("was")) / F.col("score"))).first()[0]
        scores = after.drop("was")
        if moved is None or moved <= tolerance:
            return scores
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, block_share: float = BLOCK_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Judge every page's URL: the longest rule that fits, else the verdict on its host.

    A host's seed of trust is the number of its pages that a rule allows, of distrust the number that
    a rule blocks. Trust follows links, distrust runs against them; a relative link leads to the page's own host, and keeps
    its share of a score there. A host is blocked when distrust
    has more than ``block_share`` of both; a host that neither reaches is allowed.

    Pages are read once, into a narrow table. Link and seed counts are added up before they are
    shuffled, and the join back to pages is salted, so a host with a third of all pages is no
    bottleneck. Returns ``page_id, url, host, path, rule, verdict, trust, distrust`` (scores of blocked hosts only).

    Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
    allowed; null html has no links; repeated rows are judged each; an empty table gives no rows; other
    columns are ignored.
    """
    url = F.col(url_col)
    ruled = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), F.coalesce(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), F.array().cast("array<string>")).alias("found"))
    ruled = ruled.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    address = lambda x: F.when(x.rlike(LINK_HOST), ascii_lower(F.regexp_extract(x, LINK_HOST, 1))).when(~x.rlike(NO_LINK), F.col("host"))
    links = F.filter(F.array_distinct(F.transform("found", address)), lambda x: x.isNotNull() & (F.col("host") != ""))
    ruled = land(ruled.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"), links.alias("links")), "ruled")

    seeds = (
        ruled.where(F.col("ruled").isNotNull())
        .groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), F.col("host").alias("node"))
        .agg(F.count("*").cast("double").alias("seed"))
    )
    scores = spread(seeds, land(host_edges(ruled), "edges"))
    hosts = scores.groupBy(F.col("node").alias("host")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    blocked = hosts.where(F.col("distrust") > block_share * (F.col("trust") + F.col("distrust")))
    joined = salted_left_join(ruled, blocked, "host", ["page_id", "path"])
    return joined.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("distrust").isNotNull(), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


