"""Operator 8, URL filters: rules first, then trust and distrust along links between hosts. DataFrame functions only.

Trust is the personalised PageRank of the seeds that rules allow, distrust that of the blocked ones against
the links. The mass of the seeds of a kind is 1 in all, each step passes FOLLOW of it on, and what has not
yet been passed on shrinks by that factor a step, so propagation ends when a step adds less than TOLERANCE,
after at most log(TOLERANCE) / log(FOLLOW) steps, whatever the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.llm.base import ascii_lower, splittable, written

# Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: A host is a seed if rules judge more than this share of its pages alike, or of its judged pages (`judge_urls`, `of_judged`).
SEED_SHARE = 0.5
FOLLOW, TOLERANCE, CUT_EACH = 0.85, 1e-6, 6
#: A host is blocked if its distrust is over this multiple of its trust, where no linked seeds set another.
BALANCE = 1.0
#: Multiples are tried in steps of 2 ** (1 / FINE), as far as 2 ** REACH either way.
FINE, REACH = 4, 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct verdict, rule of the longest rule that fits, else null. The chain tries longer rules first."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + prefix).alias("rule"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """source, target, n: links from pages of one host to another, summed."""
    pattern = r"(?i)href\s*+=\s*+[\"']?(?:https?:)?//([^/?#\"'\s<>]+)"
    links = pages.select(host_and_path(F.col(url_col))[0].alias("source"), F.explode(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1))).alias("target"))
    links = links.withColumn("target", ascii_lower(F.col("target"))).filter("source <> target and source <> ''")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, follow: float = FOLLOW, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, and trust_in, distrust_in: the same less the host's own restart mass.

    seeds: host, trusted, blocked (booleans). Rank at a host without links onward ends there.
    """
    flows = links.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    out = flows.groupBy("kind", "source").agg(F.sum("n").alias("total"))
    flows = written(flows.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("total")).alias("share")), "flows")
    seed = seeds.select(F.explode(F.array(F.when(F.col("trusted"), "trust"), F.when(F.col("blocked"), "distrust"))).alias("kind"), F.col("host")).filter("kind is not null")
    many = seed.groupBy("kind").agg(F.count("*").alias("seeds"))  # two rows
    start = written(seed.join(F.broadcast(many), "kind").select("kind", "host", (F.lit(1.0 - follow) / F.col("seeds")).alias("rank")), "restart")
    # from the restart vector every step only adds: the difference of the sums is the summed change
    rank, before, linked = start, 0.0, flows.take(1)
    while linked:
        for _ in range(CUT_EACH):
            moved = splittable(rank, "kind", "host").join(flows, ["kind", "host"]).select("kind", F.col("target").alias("host"), (follow * F.col("rank") * F.col("share")).alias("rank"))
            rank = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = written(rank, "rank")
        total = rank.agg(F.sum("rank")).first()[0] or 0.0
        if total - before < tolerance:
            break
        before = total
    both = rank.select("kind", "host", "rank", F.lit(0.0).alias("own")).unionByName(start.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("own")))
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))
    sums = [of(kind, F.col("rank")).alias(kind) for kind in ("trust", "distrust")] + [F.greatest(of(kind, F.col("rank") - F.col("own")), F.lit(0.0)).alias(f"{kind}_in") for kind in ("trust", "distrust")]
    return both.groupBy("host").agg(*sums)


def calibrated_balance(ranks: DataFrame, seeds: DataFrame) -> float:
    """The multiple that misjudges the fewest seeds from what other hosts pass on to them; of equal ones that nearest to BALANCE.

    Seeds that get nothing from others say nothing; without any the multiple is BALANCE.
    """
    step = F.ceil(F.log2(F.col("distrust_in") / F.col("trust_in")) * FINE)
    step = F.when(F.col("distrust_in") == 0, -FINE * REACH).when(F.col("trust_in") == 0, FINE * REACH + 1).otherwise(F.greatest(F.lit(-FINE * REACH), F.least(F.lit(FINE * REACH), step)))
    known = ranks.join(seeds.filter("trusted or blocked"), "host").filter("trust_in + distrust_in > 0")
    found = known.groupBy(step.cast("int").alias("step")).agg(F.count_if("blocked").alias("bad"), F.count_if("trusted").alias("good")).collect()  # at most 2 * FINE * REACH + 2 rows

    def wrong(k: int) -> int:
        """A seed is blocked from 2 ** (k / FINE) on: its step is over k."""
        return sum(r["bad"] for r in found if r["step"] <= k) + sum(r["good"] for r in found if r["step"] > k)

    best = min(range(-FINE * REACH, FINE * REACH + 1), key=lambda k: (wrong(k), abs(k), k))
    return BALANCE * 2.0 ** (best / FINE)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", of_judged: bool = False) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with its host's trust and distrust.

    of_judged: seeds are chosen by the share among the pages that rules judge, so that more pages without
    a rule do not take a host's part away; else by the share among all its pages.

    The rule decides where one fits; of two rules of one length there is only one that fits. Else the page is
    blocked if its host's distrust is over the calibrated multiple of its trust, and allowed otherwise: a
    host that neither reaches stays. Null urls and urls without :// have empty host and path and are allowed;
    null html has no links. Urls and html are read whole, however long. Repeated rows are judged each; an
    empty table gives no rows. Other columns of pages, whatever their names, are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    counted = F.col("found.verdict") if of_judged else F.coalesce(F.col("found.verdict"), F.lit(""))
    share = lambda verdict: F.coalesce(F.avg((counted == verdict).cast("double")) > SEED_SHARE, F.lit(False))
    seeds = written(judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    ranks = propagate(seeds, host_links(pages, url_col, html_col))
    ranks = written(ranks, "ranks")
    balance = calibrated_balance(ranks, seeds)
    ranked = judged.join(ranks.select("host", "trust", "distrust"), "host", "left")
    own = F.when(F.coalesce("distrust", F.lit(0.0)) > balance * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return ranked.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "trust", "distrust")
