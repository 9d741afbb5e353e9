"""URL filters: explicit rules first, then trust and distrust over the graph of hosts.

Links in pages make edges between hosts. Trust is personalised PageRank over the
edges from hosts with pages that rules allow; distrust is the same over the
reversed edges, from hosts with pages that rules block, so it reaches the hosts
that link to blocked ones. Seeds weigh as their number of pages, and the seeds of
each side sum to 1, so a few block seeds weigh as much as all allow seeds
together; ``ratio`` shifts this balance. A host is blocked when its distrust
exceeds ``ratio`` times its trust, and allowed otherwise; hosts that neither
reaches are allowed. Ranks, which sum to at most 1, are settled when a round
reaches no new host and changes them by ``TOLERANCE`` at most in sum; more than
``ROUNDS`` rounds raise.

Rules, a list or a table of any length, are joined with the distinct hosts and
their parent domains. Each host then has its own few rules, the longest first, and
a page is judged in its row. Pages join with hosts by ``join_split``, so a host of
very many pages fills no task. Edges are summed by pair of hosts before anything
else, so a hub costs a row for each neighbour. Ranks and edges are tables in the
scratch folder.

Defined cases: a null url, or one without ``://``, has an empty host and path and
no part in the graph; without a fitting rule it is allowed. Null html has no
links. Links without a host stay on their page's host and make no edge. Repeated
pages count repeatedly. Rules that fit are ranked by length, then by length of
their host; of two for the same host and path one counts, a block before an allow.
Rules with a null part fit nothing, and an empty host fits pages without one. An
empty table gives no rows. Pages of any length are searched whole for links.
Columns other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.scratch import Scratch, join_split

DAMPING = 0.85
ROUNDS = 1000
TOLERANCE = 1e-9
RATIO = 1.0
#: Rules up to this many are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """verdict, host and path of each rule."""
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", "path")
    text = json.dumps([{"verdict": r.verdict, "host": r.host, "path": r.path} for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<verdict:string,host:string,path:string>>")))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the rules for it or a parent domain, the longest first; ``hosts``: distinct host."""
    rules = rules.where("verdict is not null and host is not null and path is not null")
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(parents).alias("domain"))
    mine = rules.select(F.col("host").alias("domain"), "path", "verdict")
    fitting = each.join(F.broadcast(mine) if rules.count() <= BROADCAST_RULES else mine, "domain")
    rule = F.struct(F.negative(F.length("domain") + F.length("path")).alias("rank"), F.negative(F.length("domain")).alias("near"), (F.col("verdict") != "block").alias("last"), "path", "verdict", F.concat("domain", "path").alias("name"))
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def placed_pages(pages: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, host, path, and the longest rule that fits as a struct of name and verdict, or null."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = scratch.save(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    known = counts.join(host_rules(counts.select("host"), rules), "host", "left")
    joined = join_split(rows, scratch.save(known, "host-rules"), "host", F.col("n"), pages.count())
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r.path)), 0)
    return joined.select("page_id", "host", "path", "n", F.struct(first["name"].alias("name"), first["verdict"].alias("verdict")).alias("rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: pages of src that link to dst."""
    targets = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda u: F.startswith(u, F.lit("//")) | (F.instr(u, "://") > 0)), lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("x:"), u)).otherwise(u))))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, rank. ``edges``: src, dst, share of src's weight; ``seeds``: host, seed (summing to 1)."""
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    ranks = scratch.save(base, "ranks")
    for _ in range(rounds):
        moved = ranks.join(edges, ranks.host == edges.src).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        parts = moved.unionByName(base).select("host", "rank", F.lit(None).cast("double").alias("old")).union(ranks.select("host", F.lit(0.0), "rank"))
        new = scratch.save(parts.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")), "ranks")
        state = new.agg(F.sum(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0)))).alias("change"), F.count_if(F.col("old").isNull()).alias("reached")).first()
        scratch.drop(ranks)
        ranks = new
        if not state.reached and (state.change or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    return ranks.select("host", "rank")


def host_verdicts(pages: DataFrame, placed: DataFrame, scratch: Scratch, ratio: float = RATIO, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, blocked for hosts that trust or distrust reaches. ``placed``: of ``placed_pages``."""
    judged = placed.where("rule.verdict is not null and host <> ''")
    counts = scratch.save(judged.groupBy("host").agg(F.count_if(F.col("rule.verdict") == "allow").alias("allow"), F.count_if(F.col("rule.verdict") == "block").alias("block")), "seeds")
    totals = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    edges = scratch.save(host_edges(pages), "edges")
    ranks = []
    for verdict, src, dst in (("allow", "src", "dst"), ("block", "dst", "src")):
        seeds = counts.where(F.col(verdict) > 0).select("host", (F.col(verdict) / F.lit(float(totals[verdict] or 1))).alias("seed"))
        turned = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "weight")
        out = turned.groupBy("src").agg(F.sum("weight").alias("total"))
        shares = scratch.save(turned.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
        ranks.append(propagate(shares, seeds, scratch, rounds))
    both = ranks[0].select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(ranks[1].select("host", F.lit(0.0), "rank"))
    both = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return scratch.save(both.withColumn("blocked", F.col("distrust") > ratio * F.col("trust")), "verdicts")


def judge_pages(pages: DataFrame, rules: Sequence[Rule] | DataFrame, ratio: float = RATIO, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust."""
    scratch = Scratch(pages.sparkSession, "url-trust")
    placed = scratch.save(placed_pages(pages, rules_table(pages.sparkSession, rules), scratch), "placed")
    reached = host_verdicts(pages, placed, scratch, ratio, rounds)
    hosts = placed.groupBy("host").agg(F.first("n").alias("n")).join(reached, "host", "left")
    rows = join_split(placed.drop("n"), hosts, "host", F.col("n"), placed.count())
    method = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
