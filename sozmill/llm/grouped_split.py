"""Splits that keep related records together: frontier breadth-first components over hash-partitioned adjacency lists.

Nodes are attribute values (a channel, a speaker within a source), edges join values that share a record, so copies and
hot groups collapse before any search. Adjacency lists stay partitioned by node for the whole search; many sampled seeds
expand concurrently, and a hop shuffles only what the frontier reached. A node reached from two seeds links their labels.
The graph of colliding labels is a small fraction of the graph: under a stated row bound one task merges it, above the
bound it is solved as the graph itself was.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sozmill.functions.keys import key, latest
from sozmill.session import cut, cut_by, parallelism

REAL_SPEAKER = "^spk_[0-9]{7}$"
SEED_ONE_IN = 32
#: Label links that one task may merge (two short strings each).
SMALL_GRAPH_ROWS = 200_000
#: Neighbours of one list; larger nodes are hubs, of which there are at most MOST_HUBS. Edges that are worth a task.
LIST = 10_000
EDGES_PER_TASK = 20_000
MOST_HUBS = 100_000
#: Hash buckets of the split order; also the bound of the only window without partition key.
ORDER_BUCKETS = 65_536


def _merge_labels(batches):
    """Union-find over the bounded graph of labels."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, find(x)) for x in root], columns=["label", "top"])


def _nearest(batches):
    """Per batch and reached node, its smallest label, and links of the other labels to it."""
    for pdf in batches:
        pdf = pdf.drop_duplicates()
        least = pdf.groupby("node")["label"].transform("min")
        others = pdf["label"] != least
        links = pd.DataFrame({"node": None, "label": least[others], "met": pdf["label"][others]})
        yield pd.concat([pd.DataFrame({"node": pdf["node"], "label": least, "met": None}).drop_duplicates("node"), links.drop_duplicates()], ignore_index=True)[["node", "label", "met"]]


def _adjacency(edges: DataFrame, partitions: int, hub: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, near) lists by node, of at most ``hub`` neighbours; the neighbours of larger nodes as rows (node, near), spread over all tasks."""
    both = edges.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = both.union(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct()
    degrees = cut(both.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    hubs = degrees.where(F.col("degree") > hub).select("node")
    if hubs.isEmpty():
        return cut_by(both.groupBy("node").agg(F.collect_list("near").alias("near")), partitions, "node"), None
    small = both.join(F.broadcast(hubs), "node", "left_anti")
    return cut_by(small.groupBy("node").agg(F.collect_list("near").alias("near")), partitions, "node"), cut(both.join(F.broadcast(hubs), "node", "left_semi"))


def _hop(frontier: DataFrame, before: DataFrame | None, lists: DataFrame, hubs: DataFrame | None, partitions: int) -> DataFrame:
    """(node, label, fresh, met) of the nodes one step from the frontier: their label, whether they are new, labels that met there.

    Neighbours of the frontier are in it, in the one before, or new, so no older label is looked at.
    """
    reached = lists.join(frontier, "node").select(F.explode("near").alias("node"), "label")
    if hubs is not None:
        # At most as many hubs as _adjacency's bound allows.
        at = frontier.join(F.broadcast(hubs.select("node").distinct()), "node", "left_semi")
        reached = reached.unionByName(hubs.join(F.broadcast(at), "node").select(F.col("near").alias("node"), "label"))
    local = reached.mapInPandas(_nearest, "node string, label string, met string")
    # Links inside a batch ride along under the label they belong to.
    keyed = local.select(F.coalesce("node", "label").alias("node"), "label", F.col("node").isNull().alias("link"), "met").repartition(partitions, "node")
    found = keyed.groupBy("node", "link").agg(F.min("label").alias("label"), F.collect_set(F.coalesce("met", "label")).alias("met"))
    held = frontier.select("node", F.col("label").alias("_now"))
    joined = found.join(held, "node", "left")
    old = F.col("_now")
    if before is not None:
        joined = joined.join(before.select("node", F.col("label").alias("_then")), "node", "left")
        old = F.coalesce("_now", "_then")
    label = F.when(F.col("link"), F.col("label")).otherwise(F.coalesce(old, F.col("label")))
    return joined.select("node", label.alias("label"), (~F.col("link") & old.isNull()).alias("fresh"), F.array_remove("met", label).alias("met"))


def _labelled(edges: DataFrame, depth: int, small: int, hub: int | None = None) -> DataFrame:
    """(node, label): equal labels exactly within a component; the labels themselves are arbitrary nodes."""
    both = edges.select("a", "b").dropna()
    count = both.count()
    # Small graphs aren't spread over more tasks than they are worth.
    partitions = min(parallelism(edges), max(edges.sparkSession.sparkContext.defaultParallelism, count // EDGES_PER_TASK))
    nodes = cut_by(both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct(), partitions, "node")
    lists, hubs = _adjacency(both, partitions, hub or max(LIST, 2 * count // MOST_HUBS))
    order = lambda c: F.struct(F.xxhash64(c, F.lit(depth)).alias("hash"), c.alias("node"))
    seed = lambda rows: cut_by(rows.select("node", F.col("node").alias("label")), partitions, "node")

    labels = frontier = seed(nodes.where(F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(SEED_ONE_IN)) == 0))
    before, links, swept = None, None, False
    alive = not frontier.isEmpty()
    while True:
        if not alive:
            if swept:
                break
            # Components without a sampled seed: every node smallest among its neighbours in hash order becomes one.
            left = nodes.join(labels, "node", "left_anti")
            near = lists.select("node", F.array_min(F.transform("near", order)).alias("_least"))
            if hubs is not None:
                near = near.unionByName(hubs.groupBy("node").agg(F.min(order(F.col("near"))).alias("_least")))
            left = left.join(near, "node", "left")
            frontier, before, swept = seed(left.where(F.col("_least").isNull() | (order(F.col("node")) < F.col("_least")))), None, True
            alive = not frontier.isEmpty()
            labels = labels.union(frontier)
            continue
        # One job a hop; its rows are read as the next frontier and as links.
        seen = Observation()
        step = cut_by(_hop(frontier, before, lists, hubs, partitions).observe(seen, F.count_if("fresh").alias("fresh")), partitions, "node", placed=True)
        met = step.select(F.col("label").alias("_l"), F.explode("met").alias("_m")).select(F.least("_l", "_m").alias("a"), F.greatest("_l", "_m").alias("b"))
        links = met if links is None else links.union(met)
        before, frontier = frontier, step.where("fresh").select("node", "label")
        alive = seen.get["fresh"] > 0
        labels = labels.union(frontier)
    if links is None:
        return labels
    links = cut(links.distinct())
    rows = links.count()
    if rows == 0:
        return labels
    if rows <= small:
        top = links.coalesce(1).mapInPandas(_merge_labels, "label string, top string")
    else:
        top = _labelled(links, depth + 1, small, hub).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def components(edges: DataFrame, small: int = SMALL_GRAPH_ROWS, hub: int | None = None) -> DataFrame:
    """Connected components of undirected edges (a, b) of strings: (node, component), component its smallest node.

    A self loop makes a single node; rows with a null end are dropped; repeated and reversed edges count once; other
    columns are ignored. An empty input gives an empty result. Nodes of more than ``hub`` neighbours (by default LIST, or
    more in graphs with very many) are expanded by all tasks.
    """
    labelled = cut(_labelled(edges, 0, small, hub))
    names = labelled.groupBy("label").agg(F.min("node").alias("component"))
    return labelled.join(names, "label").select("node", "component")


def group_records(segments: DataFrame) -> DataFrame:
    """(id, group_key) for the latest version of every segment.

    Records are tied by channel_id, or by source and real speaker_id; null or blank values and speakers that name nobody
    tie nothing. group_key is the smallest channel of the group, else ``source/speaker``, else the id.
    """
    rows = latest(segments, "id", "written_at", {"channel": key("channel_id"), "source": key("source"), "speaker": key("speaker_id")})
    real = F.col("speaker").rlike(REAL_SPEAKER) & F.col("source").isNotNull()
    # Channels sort before speakers, so the smallest node of a component is its smallest channel if it has one.
    rows = cut(rows.select("id", F.concat(F.lit("c:"), "channel").alias("c"), F.when(real, F.concat(F.lit("s:"), "source", F.lit("/"), "speaker")).alias("s")))
    ties = rows.groupBy("c", "s").agg(F.lit(1)).select(F.coalesce("c", "s").alias("a"), F.coalesce("s", "c").alias("b"))
    named = components(ties)
    node = F.coalesce("c", "s")
    return rows.select("id", node.alias("node")).join(named, "node", "left").select("id", F.coalesce(F.substring("component", 3, 1 << 30), "id").alias("group_key"))


def assign_splits(grouped: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(id, group_key, split): whole groups go to splits in the order of the groups' hashes.

    A group larger than the smallest wanted share goes to the split with the largest one, as it would overfill any other;
    the remaining groups fill the remaining quotas in hash order. Shares are scaled to 1.
    """
    total_share = sum(shares.values())
    wanted = {s: v / total_share for s, v in shares.items()}
    main = max(wanted, key=wanted.get)
    sizes = grouped.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(total)).withColumn("big", F.col("size") > F.col("total") * min(wanted.values()))
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(ORDER_BUCKETS)))
    buckets = sizes.where("not big").groupBy("bucket").agg(F.sum("size").alias("n"), F.max("total").alias("total"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("n") / 2) / F.col("total")
    choice, reached = F.lit(main), 0.0
    for name in sorted((s for s in wanted if s != main), key=wanted.get, reverse=True):
        choice = F.when((middle >= reached) & (middle < reached + wanted[name]), name).otherwise(choice)
        reached += wanted[name]
    by_bucket = buckets.select("bucket", choice.alias("bucket_split"))
    placed = sizes.join(by_bucket, "bucket", "left").select("group_key", F.when(F.col("big"), F.lit(main)).otherwise(F.coalesce("bucket_split", F.lit(main))).alias("split"))
    return grouped.select("id", "group_key").join(placed, "group_key").select("id", "group_key", "split")
