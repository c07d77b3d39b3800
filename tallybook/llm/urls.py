"""Allow and block rules over urls as a sorted range join.

The canonical key of a url is its host read from the right, then its path; a rule's key is made alike.
A rule fits subdomains too, so a url probes once for each of its hosts from the full one up to the
last label; below one host a rule is the interval of paths that start with its path, and intervals
of one host are nested or apart. Edges of rules and probes are sorted together, and a sweep along
them knows the stack of rules that are open: its top holds until the next edge. A url takes the
longest rule among its hosts. Paths are compared by their bytes, and an interval ends at a byte that no text holds.

Rules of one host are folded to edges, and the edges are repeated for each share of a busy host's
probes, so a host with a third of all urls is swept in as many windows as its size asks for. Equal
urls are judged once. All of it is DataFrame functions.

Defined cases: a null url or one without '://' has empty host and path and fits no rule. A url that
no rule fits gets ``default``. Repeated rows are kept, an empty table gives an empty
result, other columns pass through except those named like the new ones. Rules that repeat a
host and path count once; the smaller verdict wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import tasks

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_SHARE = 64
AFTER_ALL = b"\xff"  # no byte of any text


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_edges(rules: DataFrame) -> DataFrame:
    """Edges (_host, _path, top): from this path on, ``top`` is the innermost open rule."""
    rule = F.struct(
        F.concat("host", "path").alias("rule"), F.col("path").alias("path"), F.col("verdict")
    )
    events = F.flatten(
        F.transform(
            F.array_sort(F.collect_set(rule)),
            lambda r: F.array(
                F.struct(r["path"].cast("binary").alias("at"), F.lit(1).alias("opens"), r.alias("rule")),
                F.struct(
                    F.concat(r["path"].cast("binary"), F.lit(AFTER_ALL)).alias("at"),
                    F.lit(0).alias("opens"),
                    r.alias("rule"),
                ),
            ),
        )
    )
    one_each = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    grouped = one_each.groupBy("host").agg(F.array_sort(events).alias("events"))
    kind = "struct<rule:string,path:string,verdict:string>"
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(
        empty.alias("stack"),
        F.array().cast(f"array<struct<at:binary,top:{kind}>>").alias("edges"),
    )

    def step(state: Column, event: Column) -> Column:
        # intervals are nested, so the rule that ends is always the last one opened
        depth = F.size(state["stack"])
        stack = F.when(
            event["opens"] == 1, F.concat(state["stack"], F.array(event["rule"]))
        ).otherwise(F.slice(state["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
        top = F.when(F.size(stack) > 0, F.try_element_at(stack, F.lit(-1)))
        edge = F.struct(event["at"].alias("at"), top.cast(kind).alias("top"))
        return F.struct(
            stack.alias("stack"), F.concat(state["edges"], F.array(edge)).alias("edges")
        )

    swept = grouped.select(
        reversed_host(F.col("host")).alias("_host"),
        F.explode(F.aggregate("events", start, step, lambda s: s["edges"])).alias("edge"),
    )
    return swept.select("_host", F.col("edge.at").alias("_path"), F.col("edge.top").alias("top"))


def match_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct (host, path) rows that a rule fits: host, path, rule, verdict.

    ``rules`` has host, path and verdict.
    """
    edges = rule_edges(rules)
    hosts = edges.select("_host").distinct()
    labels = F.split(reversed_host(F.col("host")), r"\.", -1)
    probes = urls.select(
        "host",
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."),
            )
        ).alias("_host"),
    ).join(hosts, "_host", "left_semi")
    # shares of a host: as many as its probes fill, counted against what an even task would get
    counts = probes.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    even = counts.agg(F.sum("_n") / (2 * tasks(urls.sparkSession))).scalar()
    share = F.ceil(F.col("_n") / F.greatest(even, F.lit(LEAST_SHARE)))
    shares = counts.select("_host", share.alias("_shares"))
    share = F.pmod(F.xxhash64("host", "path"), F.col("_shares"))
    spread = probes.join(shares, "_host").select(
        "_host",
        share.alias("_share"),
        F.col("path").cast("binary").alias("_path"),
        F.lit(1).alias("_probe"),
        F.lit(None).cast(edges.schema["top"].dataType).alias("top"),
        "host",
    )
    copies = edges.join(shares, "_host").select(
        "_host",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)).alias("_share"),
        "_path",
        F.lit(0).alias("_probe"),
        F.struct(F.col("top").alias("top")).alias("edge"),
    )
    along = Window.partitionBy("_host", "_share").orderBy("_path", "_probe")
    swept = (
        spread.drop("top")
        .withColumn("edge", F.lit(None).cast(copies.schema["edge"].dataType))
        .unionByName(copies.withColumn("host", F.lit(None).cast("string")))
        # rows that lie by host would satisfy the window as they are, a busy host in one task
        .repartition(tasks(urls.sparkSession), "_host", "_share")
        .withColumn("open", F.last("edge", ignorenulls=True).over(along)["top"])
        .where((F.col("_probe") == 1) & F.col("open").isNotNull())
    )
    best = F.max(
        F.struct(
            F.length("open.rule").alias("n"), F.col("open.rule"), F.col("open.verdict")
        )
    )
    return (
        swept.groupBy("host", F.col("_path").cast("string").alias("path"))
        .agg(best.alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """All rows of ``pages`` with host, path, rule and verdict of their url."""
    new = ("host", "path", "rule", "verdict")
    rows = pages.drop(*new).withColumns(
        {"host": url_host(F.col("url")), "path": url_path(F.col("url"))}
    )
    found = match_urls(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )
