"""Entity graphs: co-occurrence, edge families, pruning, ego networks, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators.storage import checkpoints, stored

HUB = 2_000  # members of an item from which its pairs are spread over several tasks
SET = 64  # items of a node up to which it is found by two of its items
DEALT = 2_000_000  # rows of a task
TASKS = 20_000  # tasks at most that blocks of pairs are dealt into


def co_occurring(mentions: DataFrame, entity_type: str, entity_id: int, target_type: str) -> DataFrame:
    """Entities of the target type in the items of one entity, with how many distinct items they share."""
    own = mentions.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).select("collection", "item_id").distinct()
    others = mentions.filter((F.col("entity_type") == target_type) & ~((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)))
    return others.join(own, ["collection", "item_id"], "left_semi").groupBy("entity_type", "entity_id").agg(F.count_distinct("collection", "item_id").alias("shared"))


def pair_counts(members: DataFrame, item: list[str], node: str, at_least: int = 1, most: int | None = None) -> DataFrame:
    """Unordered pairs of nodes (a < b) with the number of items that both are in.

    Members are made distinct first, so that repeats do not multiply.  Items with more than ``most`` members can be left out
    by the caller's choice; nothing is left out by default.  The members of an item with more than HUB are dealt into chunks,
    and every pair of chunks is worked on its own, so that no task has all pairs of one item.
    """
    own = members.select(*item, F.col(node).alias("_n")).filter("_n is not null").distinct()
    if most is not None:
        small = own.groupBy(*item).agg(F.count("*").alias("_m")).filter(F.col("_m") <= most).drop("_m")
        own = own.join(small, item, "left_semi")
    return _counted(stored(own, "members"), None, item, at_least)


def shared_counts(left: DataFrame, right: DataFrame, item: list[str], node: str, at_least: int = 1) -> DataFrame:
    """Pairs of a node of the left (a) and one of the right (b) with the number of items that both are in; see ``pair_counts``."""
    sides = (df.select(*item, F.col(node).alias("_n")).filter("_n is not null").distinct() for df in (left, right))
    return _counted(*(stored(df, "members") for df in sides), item, at_least)


def _counted(left: DataFrame, right: DataFrame | None, item: list[str], at_least: int) -> DataFrame:
    """(a, b, weight) of the members (item, ``_n``) of two sides, or of one side with itself.

    Pairs that need two common items or more, of nodes with up to SET items, can also meet by two items at once: s common items
    are s(s - 1)/2 common twos, so the twos are counted instead.  This way is taken where it makes fewer rows: nodes of few
    items each, items with many nodes.  Pairs with a larger node meet by single items as before.
    """
    plain = _met(left, right, item)
    if at_least >= 2:
        both = left if right is None else left.unionByName(right)
        sizes = stored(both.groupBy("_n").agg(F.count("*").alias("_m")), "member-sizes")
        twos = sizes.filter(F.col("_m") <= SET).agg(F.sum(F.col("_m") * (F.col("_m") - 1) / 2)).first()[0] or 0
        if 4 * twos < plain[1]:
            paired = [None if df is None else stored(_twos(df.join(sizes.filter(F.col("_m") <= SET), "_n"), item), "member-twos") for df in (left, right)]
            met = _met(*paired, ["_u", "_v"])
            if 4 * met[1] < plain[1]:
                common = F.round((1 + F.sqrt(1 + 8 * F.col("weight"))) / 2).cast("long")
                near = _summed(met).withColumn("weight", common).filter(F.col("weight") >= at_least)
                large = sizes.filter(F.col("_m") > SET).select("_n", F.lit(True).alias("_big"))
                if large.isEmpty():
                    return near
                marked = [None if df is None else df.join(large, "_n", "left").withColumn("_big", F.coalesce("_big", F.lit(False))) for df in (left, right)]
                far = _summed(_met(*marked, item, F.col("a_big") | F.col("b_big")))
                return near.unionByName(far.filter(F.col("weight") >= at_least))
    return _summed(plain).filter(F.col("weight") >= at_least)


def _twos(members: DataFrame, item: list[str]) -> DataFrame:
    """(_n, _u, _v) of every two items of a node; null items are in no pair."""
    whole = members.dropna(subset=item).groupBy("_n").agg(F.array_sort(F.collect_list(F.struct(*item))).alias("_s"))
    before = lambda x, i: F.transform(F.slice("_s", F.lit(1), i), lambda y: F.struct(y.alias("_u"), x.alias("_v")))
    return whole.select("_n", F.inline(F.flatten(F.transform("_s", before))))


def pair_counts_by_class(members: DataFrame, item: list[str], node: str, at_least: int = 1) -> DataFrame:
    """As ``pair_counts``, for nodes that often have all items alike: such nodes are one class, classes are paired instead of
    nodes, and in the end their pairs are spread over the nodes where they lie, in blocks of up to HUB by HUB, without a shuffle.
    The blocks are dealt by how many pairs there may be: by their own size, which is small, Spark would put them into one task."""
    own = stored(members.select(*item, F.col(node).alias("_n")).dropna(subset=["_n", *item]).distinct(), "members")
    sets = own.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct(*item))).alias("_s")).select("_n", F.size("_s").alias("_w"), F.unhex(F.md5(F.to_json(F.col("_s")))).alias("_k"))
    sets = stored(sets, "member-sets")
    classes = stored(sets.groupBy("_k").agg(F.min("_n").alias("_r"), F.count("*").alias("_m"), F.first("_w").cast("long").alias("weight")), "member-classes")
    chunk = F.pmod(F.xxhash64("_n"), F.ceil(F.col("_m") / HUB)).cast("int").alias("_c")
    blocks = stored(sets.join(classes, "_k").select("_r", "_n", chunk).groupBy("_r", "_c").agg(F.array_sort(F.collect_list("_n")).alias("_ns")), "member-blocks")
    across = pair_counts(own.join(classes.select(F.col("_r").alias("_n")), "_n", "left_semi"), item, "_n", at_least)
    inside = classes.filter((F.col("_m") > 1) & (F.col("weight") >= at_least)).select(F.col("_r").alias("a"), F.col("_r").alias("b"), "weight")
    side = lambda k: blocks.select(F.col("_r").alias(k), F.col("_c").alias(f"{k}_c"), F.col("_ns").alias(f"{k}_ns"))
    met = across.unionByName(inside).join(side("a"), "a").join(side("b"), "b").filter("a <> b or a_c <= b_c")
    nodes = sets.count()
    dealt = met.repartition(min(_parts(sets, nodes * (nodes - 1) // 2), TASKS), F.xxhash64("a", "b", "a_c", "b_c"))
    alike = (F.col("a") == F.col("b")) & (F.col("a_c") == F.col("b_c"))
    spread = dealt.select("b_ns", "weight", alike.alias("_alike"), F.explode("a_ns").alias("_x")).select("_x", "weight", "_alike", F.explode("b_ns").alias("_y"))
    return spread.filter("not _alike or _x < _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "weight")


def _met(left: DataFrame, right: DataFrame | None, item: list[str], also: Column | None = None) -> tuple[DataFrame, int]:
    """(a, b) for every item that a node of the left and one of the right are in (of one side with itself: a < b), and how many
    rows that may be; ``also``: a condition on the columns ``_big`` of both."""
    both = left if right is None else left.unionByName(right)
    sizes = both.repartition(_parts(both, both.count()), *item).groupBy(*item).agg(F.count("*").alias("_m"))
    rows, pairs, top = sizes.agg(F.sum("_m"), F.sum(F.col("_m").cast("double") * (F.col("_m") - 1) / 2), F.max("_m")).first()
    fits = F.lit(True) if right is not None else F.col("a") < F.col("b")
    fits = fits if also is None else fits & also
    named = lambda df, k: df.withColumnsRenamed({"_n": k, "_big": f"{k}_big"})
    hubs = sizes.filter(F.col("_m") > HUB)
    plain = (lambda df: df) if (top or 0) <= HUB else (lambda df: df.join(hubs, item, "left_anti"))
    dealt = lambda df, k: named(plain(df), k).repartition(_parts(df, int(max(rows or 0, pairs or 0))), *item)
    out = dealt(left, "a").join(dealt(left if right is None else right, "b"), item).filter(fits).select("a", "b")
    if (top or 0) > HUB:
        out = out.unionByName(_hub_pairs(named(left.join(hubs, item), "a"), named((left if right is None else right).join(hubs, item), "b"), item).filter(fits).select("a", "b"))
    return out, int(pairs or 0)


def equal_pairs(df: DataFrame, item: list[str], node: str) -> DataFrame:
    """(a, b), a < b, of all rows with equal items.  They grow with the square of the rows of an item, so the rows are dealt into as
    many parts as there are pairs for, not as their own size would ask for."""
    own = stored(df.select(*item, F.col(node).alias("_n")).dropna(subset=[*item, "_n"]), "members")
    return _met(own, None, item)[0]


def _hub_pairs(left: DataFrame, right: DataFrame, item: list[str]) -> DataFrame:
    """All pairs of the members a and b of large items (``_m`` members)."""
    chunks = F.ceil(F.col("_m") / HUB).cast("int")
    dealt = lambda df, k: df.withColumn("_c", F.pmod(F.xxhash64(k), chunks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_m")
    return dealt(left, "a").withColumnsRenamed({"_c": "_x", "_o": "_y"}).join(dealt(right, "b").withColumnsRenamed({"_c": "_y", "_o": "_x"}), [*item, "_x", "_y"])


def _parts(df: DataFrame, rows: int) -> int:
    """Partitions of at most DEALT rows, and not more small ones than Spark would take."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(usual, rows // 50_000 + 1), rows // DEALT + 1)


def _summed(met: tuple[DataFrame, int]) -> DataFrame:
    """(a, b, weight).  The pairs are dealt before they are counted, into as many parts as there are pairs for, so that what a task
    holds does not grow with the input."""
    pairs, rows = met
    return pairs.repartition(_parts(pairs, rows), "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def undirected(edges: DataFrame, order: list[Column], a: str = "a", b: str = "b", rows: int = 0) -> DataFrame:
    """One edge for each unordered pair, the first in the given order; loops go.  ``rows``: about how many edges there are, where that
    is known; they are dealt by it, so that what a task sorts does not grow with them."""
    keyed = edges.filter(F.col(a) != F.col(b)).withColumns({"_x": F.least(a, b), "_y": F.greatest(a, b)})
    keyed = keyed.repartition(_parts(edges, rows), "_x", "_y") if rows else keyed
    return keyed.withColumn("_rn", F.row_number().over(W.partitionBy("_x", "_y").orderBy(*order))).filter("_rn = 1").drop("_rn", "_x", "_y")


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def node_size(degree: Column, base: float = 2.0, factor: float = 3.0) -> Column:
    return F.lit(base) + F.log(degree + 1) * factor


def peel(edges: DataFrame, least: int, a: str = "a", b: str = "b") -> DataFrame:
    """The edges left when nodes of smaller degree are removed until none remains (k-core).

    One shuffle for degrees and two semi-joins a round; lineage is cut by a checkpoint in each.
    """
    checkpoints(edges.sparkSession)
    left = edges.checkpoint()
    n = left.count()
    while True:
        kept = degrees(left, a, b).filter(F.col("degree") >= least).select("node")
        left = left.join(kept.withColumnRenamed("node", a), a, "left_semi").join(kept.withColumnRenamed("node", b), b, "left_semi").checkpoint()
        now = left.count()
        if now == n:
            return left
        n = now


def label_propagation(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", most: int = 500) -> DataFrame:
    """(node, community): nodes take the label with most weight around them (ties: the least label) while that is more than the
    weight of their own label, until no node gains by a change.

    Deterministic and distributed, in place of a sequential modularity search.  In each round the half of the nodes that a hash
    of node and round picks may change, so that neighbours do not swap labels for ever; after ``most`` rounds without an end
    it is an error.
    """
    checkpoints(edges.sparkSession)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near"), F.col(weight).alias("w"))
    both = both.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near"), F.col(weight).alias("w"))).checkpoint()
    labels = both.select("node").distinct().withColumn("community", F.col("node"))
    for k in range(most):
        votes = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node", "community").agg(F.sum("w").alias("w"))
        mine = labels.withColumnRenamed("community", "own")
        wishes = votes.join(mine, "node").groupBy("node", "own").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("best"), F.max("w").alias("top"), F.max(F.when(F.col("community") == F.col("own"), F.col("w"))).alias("has"))
        gains = F.col("top") > F.coalesce("has", F.lit(0))
        turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        moved = wishes.select("node", F.when(gains & turn, F.col("best")).otherwise(F.col("own")).alias("community"), gains.alias("gains")).checkpoint()
        labels = moved.select("node", "community")
        if moved.filter("gains").isEmpty():
            return labels
    raise RuntimeError("labels did not come to rest")


def modularity(edges: DataFrame, labels: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """One row: the modularity of the labelling."""
    named = edges.join(labels.select(F.col("node").alias(a), F.col("community").alias("_ca")), a).join(labels.select(F.col("node").alias(b), F.col("community").alias("_cb")), b)
    inside = named.groupBy(F.when(F.col("_ca") == F.col("_cb"), F.col("_ca")).alias("c")).agg(F.sum(weight).alias("inside")).filter("c is not null")
    ends = named.select(F.explode(F.array("_ca", "_cb")).alias("c"), weight).groupBy("c").agg(F.sum(weight).alias("ends"))
    total = edges.agg(F.sum(weight).alias("m"))
    joined = ends.join(inside, "c", "left").join(F.broadcast(total))
    return joined.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)).alias("modularity"))


def community_summary(labels: DataFrame, names: DataFrame, least: int = 3, top: int = 8, per_type: int = 3) -> DataFrame:
    """Per community of enough members its size, how many members each type has (a map), the names of its members of highest
    degree, and the names of the first ``per_type`` of each type, types in order.  ``names``: node, type, name, degree."""
    members = labels.join(names, "node")
    order = [F.desc("degree"), F.col("node")]
    listed = lambda df, by, name: df.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, "name"))), lambda s: s["name"]), ", ").alias(name))
    counts = members.groupBy("community", "type").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("community").agg(F.sum("n").alias("members"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("type_counts")).filter(F.col("members") >= least)
    head = members.withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy(*order))).filter(F.col("rn") <= top)
    typed = members.withColumn("rn", F.row_number().over(W.partitionBy("community", "type").orderBy(*order))).filter(F.col("rn") <= per_type)
    return sizes.join(listed(head, ["rn"], "label"), "community").join(listed(typed, ["type", "rn"], "diverse"), "community")


def with_communities(nodes: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """Nodes of a second graph with the communities of the first; nodes it does not have get -1."""
    own = labels.select(F.col("node").alias(node), "community")
    return nodes.join(own, node, "left").withColumn("community", F.coalesce("community", F.lit(-1)))


def class_weighted(edges: DataFrame, a: str, b: str, weight: str = "weight", same: float = 0.5, cross: float = 2.0) -> DataFrame:
    """Edges with their weight times a factor: less between nodes of one class (columns ``a`` and ``b``), more across."""
    return edges.withColumn(weight, F.col(weight) * F.when(F.col(a) == F.col(b), same).otherwise(cross))


def subgraph(edges: DataFrame, members: DataFrame, joinable: DataFrame, least: int = 2, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """The subgraph of the members (node), with those joinable nodes (node) outside that have ``least`` edges into it.

    Edges are counted into the members as given, so the result does not depend on an order of nodes.  Returns nodes and edges.
    """
    own = members.select("node").distinct()
    inside = own.withColumn("_in", F.lit(1))
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("node")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("node")))
    into = ends.join(inside, "node").groupBy(F.col("x").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    outside = into.select("node").join(own, "node", "left_anti").join(joinable.select("node").distinct(), "node", "left_semi")
    nodes = own.unionByName(outside)
    kept = edges.join(nodes.withColumnRenamed("node", a), a, "left_semi").join(nodes.withColumnRenamed("node", b), b, "left_semi")
    return nodes, kept


def edge_families(families: dict[str, DataFrame], a: str = "source", b: str = "target") -> DataFrame:
    """One undirected edge a pair over several families (source, target, weight): that of the first family in order that has it, of
    its edges the one with most weight, then the least source.  An edge goes to its pair as the two ends in order and whether they are
    turned; families go as numbers."""
    kept = [df.filter(F.col(a) != F.col(b)).select(F.lit(k).cast("byte").alias("_k"), F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y"), (F.col(a) > F.col(b)).alias("_turned"), F.col("weight").cast("double").alias("weight")) for k, df in enumerate(families.values())]
    first = F.row_number().over(W.partitionBy("_x", "_y").orderBy("_k", F.desc("weight"), "_turned"))
    names = F.array(*map(F.lit, families))
    ends = (F.when(F.col("_turned"), F.col(v)).otherwise(F.col(u)).alias(c) for u, v, c in (("_x", "_y", a), ("_y", "_x", b)))
    return reduce(DataFrame.unionByName, kept).withColumn("_rn", first).filter("_rn = 1").select(F.get(names, F.col("_k").cast("int")).alias("family"), *ends, "weight")


def citations(refs: DataFrame, item: int) -> DataFrame:
    """What an item cites and what cites it; targets outside the collection are external."""
    out = refs.filter(F.col("source_item") == item).select(F.when(F.col("target_item").isNull(), "external").otherwise("cites").alias("direction"), F.col("target_item").alias("other"))
    return out.unionByName(refs.filter(F.col("target_item") == item).select(F.lit("cited_by").alias("direction"), F.col("source_item").alias("other")))
