"""URL filter: host and path rules applied by a sort-merge range join, in DataFrame operations only.

A host is turned round label by label (`www.example.net` -> `net.example.www.`), so a rule for a host covers one interval
of keys: its own key and everything that begins with it. The distinct hosts of the pages and the rules are dealt by range
of that key, written once with their range (a checkpoint) and swept in key order. Because intervals of prefixes nest, the rules that are open at a key form a stack with
one place for each number of labels; a place holds the last rule of that depth and is open while the key still begins with
its key. What is open at the end of a range is carried into the next ranges. The hosts, with their few open rules, are then
joined back to the pages, and the longest open rule whose path begins the page's path decides.

Sweeping distinct hosts keeps a host with a third of all pages to one row of the sweep; the join back is an ordinary
equi-join, which adaptive execution splits where a host is hot. A rule host's rules travel as one array, so the rules of one
host (not of one domain) must fit a row.

Null urls and urls without `://` have empty host and path; no rule fits an empty host. Repeated rows stay. Ties between
rules of equal length go to the longer host, then to `block`, so repeated and contradicting rules have one result. Rules
with null or empty host are ignored; a null rule path counts as `/`. An empty rules table gives every page the default.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sovara.llm.common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    """`a.b.c` -> `c.b.a.`: a host and its subdomains begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def open_rules(hosts: DataFrame, rules: DataFrame, depths: list[int]) -> DataFrame:
    """For each row of hosts (key): `stack`, the rule arrays of all rule keys that it begins with. rules: key, rules."""
    events = hosts.select("key", F.lit(1).alias("kind"), F.lit(None).cast(rules.schema["rules"].dataType).alias("rules")).unionByName(
        rules.select("key", F.lit(0).alias("kind"), "rules")
    )
    # written once: the ranges swept, what they leave open and their list must be of one exchange
    dealt = cut_lineage(events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()))
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda d: F.when((F.col("kind") == 0) & (F.size(F.split("key", r"\.")) - 1 == d), F.struct("key", "rules"))
    swept = dealt.withColumns({f"open{d}": F.last(place(d), ignorenulls=True).over(so_far) for d in depths})
    # what each range leaves open; a row for each range, so its size follows the number of partitions
    left = swept.filter("kind = 0").groupBy("part").agg(*[F.max_by(f"open{d}", "key").alias(f"open{d}") for d in depths])
    later = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.select("part").distinct().join(left, "part", "left")
    carried = parts.select("part", *[F.last(f"open{d}", ignorenulls=True).over(later).alias(f"carried{d}") for d in depths])
    swept = swept.filter("kind = 1").join(F.broadcast(carried), "part", "left")
    still = [F.coalesce(f"open{d}", f"carried{d}") for d in depths]
    stack = F.filter(F.array(*still), lambda x: F.col("key").startswith(x["key"]))
    return swept.select("key", F.flatten(F.transform(stack, lambda x: x["rules"])).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rows: int = 20_000) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict. rules: host, path, verdict.

    Hosts with an open rule are broadcast to the pages only if there are at most broadcast_rows of them.
    """
    url = F.col("url").cast("string")
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    by_host = (
        rules.select(F.translate(F.trim("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("/")).alias("rule_path"), "verdict")
        .filter("host <> '' and verdict in ('allow', 'block')")
        .select(host_key(F.col("host")).alias("key"), F.struct(
            (F.length("host") + F.length("rule_path")).alias("length"), F.length("host").alias("host_length"),
            (F.col("verdict") == "block").alias("blocks"), F.col("rule_path").alias("path"), F.concat("host", "rule_path").alias("rule"), "verdict").alias("rule"))
        .groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    )
    depths = [r[0] for r in by_host.select(F.size(F.split("key", r"\.")) - 1).distinct().collect()]  # at most 127 labels
    if not depths:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = pages.filter("host <> ''").groupBy("host").count().select("host", host_key(F.col("host")).alias("key"))
    ruled = (
        open_rules(hosts.select("key"), by_host, sorted(depths)).filter(F.size("stack") > 0)
        .select(F.array_join(F.reverse(F.split(F.expr("left(key, length(key) - 1)"), r"\.")), ".").alias("host"), "stack")
    )
    if ruled.limit(broadcast_rows + 1).count() <= broadcast_rows:
        ruled = F.broadcast(ruled)
    best = F.array_max(F.filter("stack", lambda r: F.col("path").startswith(r["path"])))
    return pages.join(ruled, "host", "left").withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
