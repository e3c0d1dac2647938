"""Bounded walks over link tables, version chains and restrictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import written


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every edge, once."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bounded_hops(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``node, depth`` of all nodes within ``hops`` of the seeds (column ``node``); a node expands where it is first seen.

    Edges and what every hop finds are written once, so a hop's plan doesn't repeat those before it.
    """
    edges = written(edges.select("src", "dst"))
    found = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for d in range(1, hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(found, "node", "left_anti").withColumn("depth", F.lit(d)))
        found = found.unionByName(frontier)
    return found


def current_links(links: DataFrame, at: Column) -> DataFrame:
    """Links valid at a time, both ends included; no end means for good."""
    return links.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at <= F.col("valid_until"))))


def paths_within(seeds: DataFrame, pages: DataFrame, links: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """All ways of at most ``hops`` links from seeds to other pages: ``page, origin, links``; with ``most``, of each length the first so many of a page.

    Only those are kept at any time, tasks drop others before they are shuffled,
    so a hub costs what its links are, not what leads to its neighbours.

    ``links`` (``link, a, b``) go both ways and count only between ``pages``
    (column ``page``), so hidden pages never bridge.  No way visits a page or a
    link twice.  Every way that reaches a page is told, but a page is gone on
    from only by the way that found it first: by depth, then by seed, then by
    links in order.
    """
    known = pages.select("page")
    seen_ends = links.join(known.select(F.col("page").alias("a")), "a", "left_semi").join(known.select(F.col("page").alias("b")), "b", "left_semi")
    one = seen_ends.select("link", F.col("a").alias("page"), F.col("b").alias("to"))
    both = written(one.unionByName(one.select("link", F.col("to").alias("page"), F.col("page").alias("to"))).where("page <> to").distinct())
    kind = links.schema["link"].dataType.simpleString()
    start = seeds.join(known, "page", "left_semi").select("page").distinct()
    front = written(start.select("page", F.col("page").alias("origin"), F.array().cast(f"array<{kind}>").alias("links"), F.array("page").alias("pages")))
    visited, ways = front.select("page"), None
    for _ in range(hops):
        step = front.join(both, "page").where(~F.array_contains("pages", F.col("to")) & ~F.array_contains("links", F.col("link")))
        made = step.select(F.col("to").alias("page"), "origin", F.array_append("links", F.col("link")).alias("links"), F.array_append("pages", F.col("to")).alias("pages"))
        if most is not None:
            made = made.withColumn("rn", F.row_number().over(Window.partitionBy("page").orderBy("origin", "links"))).where(F.col("rn") <= most).drop("rn")
        made = written(made)
        ways = made if ways is None else ways.unionByName(made)
        first = made.groupBy("page").agg(F.min(F.struct("origin", "links", "pages")).alias("m")).join(visited, "page", "left_anti")
        front = written(first.select("page", "m.*"))
        visited = visited.unionByName(front.select("page"))
    return ways.select("page", "origin", "links").distinct()


def found_pages(seeds: DataFrame, ways: DataFrame, most: int, paths: int = 8) -> DataFrame:
    """Seeds before pages that only links lead to, each by id, at most ``most``; with up to ``paths`` ways, shortest first."""
    reach = ways.withColumn("rn", F.row_number().over(Window.partitionBy("page").orderBy(F.size("links"), "origin", "links"))).where(F.col("rn") <= paths)
    reach = reach.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("rn", "origin", "links"))).alias("ways"))
    own = seeds.select("page", F.lit(True).alias("seed")).distinct()
    both = own.join(reach, "page", "full_outer").select("page", F.coalesce("seed", F.lit(False)).alias("seed"), F.coalesce(F.size("ways"), F.lit(0)).alias("ways"), F.transform("ways", lambda w: w["links"]).alias("paths"))
    return both.orderBy(F.desc("seed"), "page").limit(most)


def repeated_links(links: DataFrame) -> DataFrame:
    """Links of one kind that join the same two pages, whichever way round: ``x, y, kind, n``."""
    pair = links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "kind")
    return pair.groupBy("x", "y", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of undirected edges ``a, b``: the least node that can be reached.

    Labels spread over edges and then jump to the label of the label, so rounds follow the logarithm of a component's diameter.
    """
    both = written(undirected(edges, "a", "b"))
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        spread = labels.join(offered, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("m"))
        after = written(spread.join(up, "comp").select("node", F.least("comp", "m").alias("comp"), "was"))
        labels = after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            return labels


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Components that are no tree: ``comp, nodes, links``, with as many different links as nodes or more."""
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comp = components(links)
    own = links.join(comp, F.col("a") == F.col("node")).groupBy("comp").agg(F.count(F.lit(1)).alias("links"))
    return comp.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")).join(own, "comp").where("links >= nodes").select("comp", "nodes", "links")


def chain_heads(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    return rows.join(rows.select(F.col(supersedes).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def chain_faults(rows: DataFrame, key: str, supersedes: str, time: str | None = None) -> DataFrame:
    """``key, fault``: links to unknown rows, forks (two rows supersede this one), rows decided before what they supersede, and rows whose links never end."""
    linked = rows.where(F.col(supersedes).isNotNull())
    unknown = linked.join(rows.select(F.col(key).alias(supersedes)), supersedes, "left_anti").select(F.col(key), F.lit("UNKNOWN_PRIOR").alias("fault"))
    forks = linked.groupBy(F.col(supersedes).alias(key)).count().where("count > 1").select(key, F.lit("FORK").alias("fault"))
    out = unknown.unionByName(forks).unionByName(_endless(rows, key, supersedes).select(key, F.lit("CYCLE").alias("fault")))
    if time:
        prior = rows.select(F.col(key).alias(supersedes), F.col(time).alias("_before"))
        out = out.unionByName(linked.join(prior, supersedes).where(F.col(time) < F.col("_before")).select(key, F.lit("TIME_ORDER").alias("fault")))
    return out


def _endless(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows from which links lead on for ever; every round doubles the steps taken, so rounds follow the logarithm of the rows."""
    steps = written(rows.select(F.col(key).alias("at"), F.col(supersedes).alias("to")))
    left, taken, total = steps, 1, steps.count()
    while taken <= total and not left.isEmpty():
        jump = left.select(F.col("at").alias("to"), F.col("to").alias("next"))
        left = written(left.join(jump, "to").select("at", F.col("next").alias("to")).where("to is not null"))
        taken *= 2
    return left.select(F.col("at").alias(key))


def restricted(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that stay once ``blocked`` nodes (column ``node``) go, with all their edges."""
    stay = nodes.join(blocked, "node", "left_anti")
    kept = edges.join(blocked.select(F.col("node").alias("src")), "src", "left_anti").join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    return stay, kept


def invalidated_surfaces(exposure: DataFrame, blocked: DataFrame) -> DataFrame:
    """Surfaces (``surface, node``) that showed a blocked node, and how many they lose: ``surface, lost``."""
    return exposure.join(blocked, "node", "left_semi").groupBy("surface").agg(F.count(F.lit(1)).alias("lost"))
