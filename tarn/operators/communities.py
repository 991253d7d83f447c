"""Communities of weighted graphs by modularity with a resolution, and connected components.

Nodes move in rounds.  A hash of node and round picks those that may move, half of them at first.  Gains use the communities
and their degree sums before the round; when neighbours move at once these are out of date, so the modularity is measured after
every round: a round that lowered it is taken back and the next one moves fewer nodes.  When rounds bring little, communities
become the nodes of a smaller graph and the same begins again; in the end the nodes of the first graph move once more.

Joins are on nodes of tables that lie in the shared folder, so Spark splits the rows of a hub; all groupings of a hub's edges
are by hub and community or combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.storage import discard, stored

COARSE, FINE = 4e-3, 2e-4  # of modularity, that a round has to bring on the way through the levels and at the end
IDLE = 3  # rounds that bring less, one after another, end the moves


def both_ways(edges: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """(node, near, ...) for both directions of every edge."""
    return edges.select(F.col(a).alias("node"), F.col(b).alias("near"), *more).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near"), *more))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 100) -> DataFrame:
    """(node, component) for every node with an edge; the component is named by its least node.

    Large-star and small-star steps: neighbours are linked to the least node around them until only stars are left, in a number
    of rounds that grows with the logarithm of the longest path.  Rows with a null end are left out.
    """
    links = stored(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "communities")
    nodes = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    links, seen = links.filter("x <> y"), None
    for _ in range(most):
        ends = both_ways(links, "x", "y")
        least = stored(ends.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m")), "communities")
        large = stored(ends.filter("near > node").join(least, "node").select(F.col("near").alias("x"), F.col("m").alias("y")).distinct(), "communities")
        low = stored(large.groupBy("x").agg(F.min("y").alias("m")), "communities")
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")).select("e.*")
        now = stored(small.filter("x <> y").distinct(), "communities")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.bit_xor(F.xxhash64("y", "x", F.lit(1)))).first()
        for table in (least, large, low):
            discard(table)
        if mark == seen:
            return nodes.join(now.select(F.col("x").alias("node"), F.col("y").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        links, seen = now, mark
    raise RuntimeError("components did not come to rest")


def _moved(links: DataFrame, nodes: DataFrame, resolution: float, doubled: float, k: int, share: int) -> DataFrame:
    """``nodes`` (node, loop, strength, community) after one round of moves, with ``part``, what each adds to the modularity
    before the round, and ``wish``, whether a move would help it."""
    totals = stored(nodes.groupBy("community").agg(F.sum("strength").alias("total")), "communities")
    placed = stored(nodes.join(totals, "community"), "communities")
    votes = links.join(placed.select(F.col("node").alias("near"), F.col("community").alias("to"), F.col("total").alias("to_total")), "near").groupBy("node", "to").agg(F.sum("w").alias("w"), F.first("to_total").alias("to_total"))
    here = F.col("to") == F.col("community")
    worth = F.col("w") - resolution * F.col("strength") * F.col("to_total") / doubled
    stay = F.coalesce(F.max(F.when(here, F.col("w"))), F.lit(0.0))
    best = F.max(F.when(~here, F.struct(worth.alias("worth"), F.col("to"))))
    seen = votes.join(placed, "node").groupBy("node", "loop", "strength", "community", "total").agg(stay.alias("w_own"), best.alias("best"))
    bar = F.col("w_own") - resolution * F.col("strength") * (F.col("total") - F.col("strength")) / doubled
    gains = F.coalesce(F.col("best.worth") > bar + 1e-12 * doubled, F.lit(False))
    turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2 * share)) == 0
    part = (F.col("w_own") + 2 * F.col("loop")) / doubled - resolution * F.col("strength") * F.col("total") / doubled / doubled
    out = stored(seen.select("node", "loop", "strength", "community", F.when(gains & turn, F.col("best.to")).otherwise(F.col("community")).alias("next"), part.alias("part"), gains.alias("wish")), "communities")
    discard(totals)
    discard(placed)
    return out


def contracted(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (node, near, w; both directions) between communities, and the communities as nodes with what lies inside as loops."""
    place = nodes.select("node", "community")
    named = links.join(place, "node").select("near", "w", F.col("community").alias("x")).join(place.withColumnRenamed("node", "near").withColumnRenamed("community", "y"), "near")
    summed = stored(named.groupBy("x", "y").agg(F.sum("w").alias("w")), "communities")
    inside = summed.filter("x = y").select(F.col("x").alias("node"), (F.col("w") / 2).alias("inner"))
    own = nodes.groupBy(F.col("community").alias("node")).agg(F.sum("loop").alias("loop"), F.sum("strength").alias("strength"))
    larger = own.join(inside, "node", "left").select("node", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), "strength", F.col("node").alias("community"))
    return summed.filter("x <> y").select(F.col("x").alias("node"), F.col("y").alias("near"), "w"), stored(larger, "communities")


def _local_moves(links: DataFrame, nodes: DataFrame, resolution: float, doubled: float, salt: int, least: float) -> tuple[DataFrame, float]:
    """``nodes`` with their communities after rounds of moves, until IDLE of them in a row bring less than ``least``, and the
    modularity of the nodes that have neighbours."""
    alone = nodes.join(links.select("node").distinct(), "node", "left_anti")
    best, best_q, share, idle, k, now = nodes, None, 1, 0, 0, nodes
    while True:
        round_ = _moved(links, now, resolution, doubled, salt + k, share)
        q, wishes = round_.agg(F.sum("part"), F.count_if("wish")).first()
        q, k = q or 0.0, k + 1
        if best_q is not None and q < best_q:  # the round before was no good
            now, share, idle = best, share * 2, idle + 1
        else:
            idle = 0 if best_q is None or q > best_q + least else idle + 1
            best, best_q = round_.select("node", "loop", "strength", "community"), q
            if not wishes:
                break
            now = round_.select("node", "loop", "strength", F.col("next").alias("community"))
        if idle >= IDLE:
            break
    return stored(best.select("node", "loop", "strength", "community").unionByName(alone.select("node", "loop", "strength", "community")).dropDuplicates(["node"]), "communities"), best_q


def louvain(edges: DataFrame, resolution: float = 1.0, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """(node, community) of every node with an edge; a community is named by its least node, and is connected.

    When a level merges nothing more, the nodes of the first graph
    move again from where they are, until that brings nothing; if it brought something the levels are gone through once more.

    Parallel edges add up, loops count inside.  Rows with a null end, a null weight or one that is not above 0 are left out.
    A higher resolution gives more and smaller communities.
    """
    usable = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(weight) > 0)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).cast("double").alias("w"))
    given = stored(usable.groupBy("a", "b").agg(F.sum("w").alias("w")), "communities")
    links = stored(both_ways(given.filter("a <> b"), "a", "b", "w"), "communities")
    loops = given.filter("a = b").select(F.col("a").alias("node"), F.col("w").alias("loop"))
    nodes = links.select("node", "w", F.lit(0.0).alias("loop")).unionByName(loops.select("node", (2 * F.col("loop")).alias("w"), "loop"))
    nodes = stored(nodes.groupBy("node").agg(F.sum("loop").alias("loop"), F.sum("w").alias("strength")).withColumn("community", F.col("node")), "communities")
    doubled, count = nodes.agg(F.sum("strength"), F.count("*")).first()
    placed, before, salt = nodes, None, 0
    while count:
        placed, salt = _through_levels(links, placed, resolution, doubled, salt)
        placed, q = _local_moves(links, placed, resolution, doubled, salt, FINE)
        if before is not None and q <= before + FINE:
            break
        before, salt = q, salt + 1000
    return _connected(links, placed.select("node", "community"))


def _through_levels(links: DataFrame, placed: DataFrame, resolution: float, doubled: float, salt: int) -> tuple[DataFrame, int]:
    """``placed`` after moves of whole communities, level by level until none merges."""
    members, count = placed.select("node", "community"), placed.select("community").distinct().count()
    level_links, level_nodes = (links, placed) if count == placed.count() else contracted(links, placed)
    while True:
        found, _ = _local_moves(level_links, level_nodes, resolution, doubled, salt, COARSE)
        fewer, salt = found.select("community").distinct().count(), salt + 1000
        members = stored(members.join(found.select(F.col("node").alias("community"), F.col("community").alias("_up")), "community").select("node", F.col("_up").alias("community")), "communities")
        if fewer == count:
            return stored(placed.drop("community").join(members, "node"), "communities"), salt
        level_links, level_nodes = contracted(level_links, found)
        count = fewer


def _connected(links: DataFrame, members: DataFrame) -> DataFrame:
    """Communities that fall into several parts are cut into them, which never lowers the modularity; each takes its least node's name."""
    inner = links.join(members, "node").join(members.select(F.col("node").alias("near"), F.col("community").alias("_c")), "near").filter("community = _c and node < near")
    parts = components(inner, "node", "near")
    return members.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """One row: the modularity of the labelling (node, community) at the resolution, and how many communities there are."""
    named = edges.join(labels.select(F.col("node").alias(a), F.col("community").alias("_ca")), a).join(labels.select(F.col("node").alias(b), F.col("community").alias("_cb")), b)
    ends = named.select(F.col(weight).alias("w"), (F.col("_ca") == F.col("_cb")).alias("same"), F.explode(F.array("_ca", "_cb")).alias("c"))
    each = ends.groupBy("c").agg(F.sum("w").alias("ends"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0)).alias("inside"))
    total = F.sum("ends")
    return each.agg((F.sum("inside") / total - resolution * F.sum(F.col("ends") * F.col("ends")) / (total * total)).alias("modularity"), F.count("*").alias("communities"))
