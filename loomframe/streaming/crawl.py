"""A bounded crawl over a table of links: rounds of a frontier against what was seen."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


#: Pages of a crawl up to which a frontier is broadcast.
BROADCAST_PAGES = 100_000


@dataclass(frozen=True)
class CrawlPlan:
    """Bounds of a crawl; checked when it is made."""

    seeds: tuple[str, ...]
    domains: tuple[str, ...] = ()
    max_pages: int = 100
    max_depth: int = 3

    def __post_init__(self):
        if not self.seeds and not self.domains:
            raise EngineError("PLAN_INVALID", "a crawl needs a seed or a domain")
        if any(not s.lower().startswith(("http://", "https://")) for s in self.seeds):
            raise EngineError("PLAN_INVALID", "seeds are http or https addresses")
        if self.max_pages < 1 or self.max_depth < 0:
            raise EngineError("PLAN_INVALID", "a crawl's bounds are positive")


def robots_rules(text: str, agent: str = "*") -> list[str]:
    """Path prefixes that a robots file disallows for an agent, or for all where the agent has no group."""
    groups: dict[str, list[str]] = {}
    names: list[str] = []
    in_rules = False
    for line in text.splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [value.lower()] if in_rules else [*names, value.lower()]
            in_rules = False
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            in_rules = True
            if field == "disallow" and value:
                for name in names:
                    groups[name].append(value)
    return groups.get(agent.lower(), groups.get("*", []))


def allowed(url: Column, rules: Sequence[str]) -> Column:
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/]*(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    out = F.lit(True)
    for rule in rules:
        out = out & ~F.startswith(path, F.lit(rule))
    return out


def in_scope(url: Column, domains: Sequence[str]) -> Column:
    if not domains:
        return F.lit(True)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | F.endswith(host, F.lit(f".{d.lower()}"))
    return out


def next_frontier(found: DataFrame, seen: DataFrame, room: int) -> DataFrame:
    """At most ``room`` (url, depth, priority) of ``found`` that weren't seen: highest priority first, then least depth."""
    best = found.groupBy("url").agg(F.max("priority").alias("priority"), F.min("depth").alias("depth"))
    return best.join(seen.select("url"), "url", "left_anti").orderBy(F.desc("priority"), "depth", "url").limit(room)


def crawl(links: DataFrame, plan: CrawlPlan, rules: Sequence[str] = ()) -> DataFrame:
    """(url, depth) of the pages that a crawl over ``links`` (url, link) visits, a round for each depth.

    Each round is a join of the frontier, at most ``max_pages`` rows, with the links; rounds end the lineage by
    checkpoints, so a lost executor costs the round it works on.
    """
    spark = links.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        raise EngineError("CHECKPOINT_UNSET", "a crawl needs a checkpoint folder")
    frontier = spark.createDataFrame([(s, 0, 0.0) for s in dict.fromkeys(plan.seeds)], "url string, depth int, priority double")
    frontier = frontier.filter(allowed(F.col("url"), rules) & in_scope(F.col("url"), plan.domains)).limit(plan.max_pages).checkpoint()
    seen = frontier
    room = plan.max_pages - frontier.count()
    for depth in range(1, plan.max_depth + 1):
        if room <= 0:
            break
        urls = frontier.select("url")
        found = links.join(F.broadcast(urls) if plan.max_pages <= BROADCAST_PAGES else urls, "url").select(F.col("link").alias("url"), F.lit(depth).alias("depth"), F.lit(0.0).alias("priority"))
        found = found.filter(F.col("url").isNotNull() & allowed(F.col("url"), rules) & in_scope(F.col("url"), plan.domains))
        frontier = next_frontier(found, seen, room).select("url", "depth", "priority").checkpoint()
        n = frontier.count()
        if not n:
            break
        seen = seen.union(frontier).checkpoint()
        room -= n
    return seen.select("url", "depth")
