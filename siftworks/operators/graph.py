"""Link graphs: bounded breadth-first search, PageRank, robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes within max_depth steps of the seeds, with their least depth.

    seeds: node; edges: src, dst. One anti-join with what was seen per level; each level is written, so that the plan
    stays short and lost executors cost one level.
    """
    front = seen = staged(seeds.select("node").where(F.col("node").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where(F.col("node").isNotNull()).distinct()
        front = staged(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a number of rounds; ranks sum to the number of nodes, pages without links give to all."""
    e = staged(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = staged(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    count = nodes.count()
    if not count:
        return nodes.withColumn("rank", F.lit(1.0))
    out = staged(e.groupBy("src").agg(F.count(F.lit(1)).alias("out")))
    weighted = staged(e.join(out, "src"))
    rank = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        lost = rank.join(out.withColumnRenamed("src", "node"), "node", "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        got = weighted.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = (1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + lost / count)
        rank = staged(nodes.join(got, "node", "left").select("node", new.alias("rank")))
    return rank


def robots_rules(text: DataFrame) -> DataFrame:
    """(domain, rule, allow): allow and disallow lines of robots.txt that hold for every agent.

    text: domain, robots. Lines before any agent hold for all. An empty Disallow forbids everything.
    """
    lines = text.select("domain", F.posexplode(F.split("robots", "\n")).alias("n", "line"))
    field = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:([^#]*)", 1), r"\r", ""))
    rows = lines.select("domain", "n", field.alias("field"), value.alias("value"))
    agents = F.collect_list(F.when(F.col("field") == "user-agent", F.struct("n", "value")))
    rules = F.collect_list(F.when(F.col("field").isin("allow", "disallow"), F.struct("n", "field", "value")))
    # a file has few lines: its agents and rules are matched within its row
    per = rows.groupBy("domain").agg(F.array_sort(agents).alias("agents"), F.array_sort(rules).alias("rules"))
    one = per.select("domain", "agents", F.explode("rules").alias("r"))
    before = F.filter("agents", lambda a: a["n"] < F.col("r.n"))
    agent = F.when(F.size(before) > 0, F.element_at(before, -1)["value"]).otherwise(F.lit("*"))
    kept = one.where(agent == "*").select("domain", F.when((F.col("r.value") == "") & (F.col("r.field") == "disallow"), F.lit("/")).otherwise(F.col("r.value")).alias("rule"), (F.col("r.field") == "allow").alias("allow"))
    return kept.where("rule <> ''").distinct()


def robots_extras(text: DataFrame) -> DataFrame:
    """(domain, crawl_delay, sitemaps): the last delay that holds for every agent, and the sitemaps in order."""
    lines = text.select("domain", F.posexplode(F.split("robots", "\n")).alias("n", "line"))
    field = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:([^#]*)", 1), r"\r", ""))
    rows = lines.select("domain", "n", field.alias("field"), value.alias("value"))
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("n", "value"))))
    per = rows.groupBy("domain").agg(pick("user-agent").alias("agents"), pick("crawl-delay").alias("delays"), pick("sitemap").alias("maps"))

    def holds(x):
        before = F.filter("agents", lambda a: a["n"] < x["n"])
        return F.when(F.size(before) > 0, F.element_at(before, -1)["value"]).otherwise(F.lit("*")) == "*"

    delay = F.try_element_at(F.filter("delays", holds), F.lit(-1))["value"].try_cast("double")
    return per.select("domain", delay.alias("crawl_delay"), F.transform("maps", lambda m: m["value"]).alias("sitemaps"))


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, path, allowed): the longest rule that begins the path decides, Allow among equals; none allows.

    A path's prefixes are looked up by equality, so no rule meets a path of another beginning.
    """
    p = paths.select("domain", "path").distinct()
    starts = p.withColumn("rule", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda n: F.substring(F.col("path"), F.lit(1), n))))
    best = starts.join(rules, ["domain", "rule"]).groupBy("domain", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "allow")).alias("best"))
    return p.join(best, ["domain", "path"], "left").select("domain", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))
