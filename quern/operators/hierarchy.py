"""Parent-child links to full hierarchies: roots, depths, loops, paths, descendants.

Every node has at most one parent, so the links are a forest plus loops. Each task unites the links of its range in a
weighted disjoint-set forest: a node's weight is its distance to the node it points to, finding compresses paths and
adds the weights up, and a set's representative is the top of its chain, so a node ends with the distance to its top
(the root's offset) and the smallest id on the way. A link whose both ends have the same representative closes a loop.
Only tops whose own link lies elsewhere go on to the next level, where they are united in the same way, until one range
holds what is left. The first level cuts by locality; above it a coin by node and level decides whether a link goes
where its node or where its parent goes, so that a share of all links meets its parent whatever the shape of the forest.
Going back down, each level looks up its tops: distances add, roots and loops are inherited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

#: How a chain ends: at a node whose link is elsewhere, at a root, in a loop.
OPEN, ROOT, LOOP = 0, 1, 2
_STATE = "node bigint, top bigint, dist bigint, low bigint, kind int"


class WeightedSets:
    """Disjoint sets over positions 0..n-1 with weights: ``up`` leads towards a set's representative over ``weight``
    steps, ``low`` is the smallest id from the position up to, not including, the one it leads to."""

    def __init__(self, weight: list[int], low: list[int]):
        self.up, self.weight, self.low = [-1] * len(weight), weight, low

    def find(self, x: int) -> tuple[int, int, int | None]:
        """(representative of x, steps to it, smallest id on the way or None if x is it); the way is compressed."""
        up, weight, low = self.up, self.weight, self.low
        way = []
        while up[x] >= 0:
            way.append(x)
            x = up[x]
        if not way:
            return x, 0, None
        steps, least = weight[way[-1]], low[way[-1]]
        for y in reversed(way[:-1]):
            steps += weight[y]
            least = min(least, low[y])
            up[y], weight[y], low[y] = x, steps, least
        return x, steps, least

    def union(self, x: int, y: int) -> int | None:
        """Let representative ``x`` lead to ``y``, over its own weight; if both are one set, gives the smallest id of
        the loop that closes."""
        top, steps, least = self.find(y)
        own = self.low[x] if least is None else min(self.low[x], least)
        if top == x:
            return own
        self.up[x], self.low[x] = top, own
        self.weight[x] += steps
        return None


def unite(
    node: np.ndarray, to: np.ndarray, dist: np.ndarray, low: np.ndarray, kind: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Follow all chains within one range of links. Gives top, dist, low, kind.

    ``node`` (unique) points to ``to`` over ``dist`` steps; ``low`` is the smallest id from node up to, not including,
    ``to``. Links of kind ROOT or LOOP are ended already (``to`` is the root, or the smallest id of the loop).
    """
    n = len(node)
    if n == 0:
        return to, dist, low, kind
    order = np.argsort(node, kind="stable")
    at = np.searchsorted(node, to, sorter=order)
    parent = order[np.where(at < n, at, 0)]
    inside = (node[parent] == to) & (kind == OPEN)
    sets, loops = WeightedSets(dist.tolist(), low.tolist()), {}
    for x, y in zip(np.flatnonzero(inside).tolist(), parent[inside].tolist(), strict=True):
        least = sets.union(x, y)
        if least is not None:
            loops[x] = least
    found = [sets.find(x) for x in range(n)]
    rep = np.fromiter((f[0] for f in found), np.int64, n)
    steps = np.fromiter((f[1] for f in found), np.int64, n)
    least = np.fromiter(
        (low_ if f[2] is None else f[2] for f, low_ in zip(found, low.tolist(), strict=True)), np.int64, n
    )
    top, kind_, dist_ = to[rep], kind[rep].copy(), steps + dist[rep]
    low_ = np.minimum(least, low[rep])
    if loops:
        looped = np.fromiter((x in loops for x in rep.tolist()), bool, n)
        top = np.where(looped, [loops.get(x, 0) for x in rep.tolist()], top)
        kind_[looped], dist_[looped] = LOOP, -1
    dist_[kind_ == LOOP] = -1
    return top, dist_, low_, kind_


def _unite_parts(most: int):
    """Unite at most about ``most`` links at a time: a larger share of a task is united in parts, and links between
    these stay open."""

    def done(got: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(got, ignore_index=True)
        cols = [d[c].to_numpy(np.int64) for c in ("node", "top", "dist", "low")]
        top, dist, low, kind = unite(*cols, d["kind"].to_numpy(np.int32))
        return pd.DataFrame({"node": cols[0], "top": top, "dist": dist, "low": low, "kind": kind})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, held = [], 0
        for d in parts:
            got.append(d)
            held += len(d)
            if held >= most:
                yield done(got)
                got, held = [], 0
        if got:
            yield done(got)

    return run


def _solve(state: DataFrame, sort: list[str], rows: int, most: int, level: int = 0) -> DataFrame:
    """``state`` with every chain followed to its end. ``rows``: how many links there are; ``sort``: the first level's
    locality."""
    ranges = max(1, -(-rows // most))
    if level == 0:
        cut = state.repartitionByRange(ranges, *sort).drop(*[c for c in sort if c != "node"])
    else:
        heads = (F.pmod(F.xxhash64("node", F.lit(level)), F.lit(2)) == 0) & (F.col("kind") == OPEN)
        cut = state.repartition(ranges, F.xxhash64(F.when(heads, F.col("top")).otherwise(F.col("node")), F.lit(level)))
    done = materialise(cut.mapInPandas(_unite_parts(4 * most), _STATE), f"forest-{level}")
    tops = done.where(f"kind = {OPEN}").select(F.col("top").alias("node")).distinct()
    left = materialise(done.join(tops, "node", "left_semi"), f"tops-{level}")
    n = left.count()
    if n == 0:
        return done
    above = _solve(left, sort, n, most, level + 1)
    up = above.select(
        F.col("node").alias("top"), F.col("top").alias("t2"), F.col("dist").alias("d2"), F.col("kind").alias("k2")
    )
    j = done.join(up, "top", "left")  # Spark chooses how, and splits a top that many nodes share
    followed = (F.col("kind") == OPEN) & F.col("k2").isNotNull()
    return j.select(
        "node", F.when(followed, F.col("t2")).otherwise(F.col("top")).alias("top"),
        F.when(followed & (F.col("k2") == LOOP), -1).when(
            followed, F.col("dist") + F.col("d2")
        ).otherwise(F.col("dist")).cast("bigint").alias("dist"),
        "low", F.when(followed, F.col("k2")).otherwise(F.col("kind")).alias("kind"),
    )


def forest(
    links: DataFrame, node: str, parent: str, locality: list[str] | None = None, most: int = 16_384
) -> DataFrame:
    """(node, parent, root, depth): one row per node; ``parent`` null for roots.

    ``links``: one row per node (a repeated node keeps its greatest parent). A null node is left out. A node whose
    parent is null or has no row of its own is a root with depth 0. A node on a loop, or below one, has depth -1 and as
    root the smallest id on that loop; a node that is its own parent is a loop of one. ``locality``: columns by which
    parents and children lie close together (such as table and number); they only decide how links are cut into ranges
    of ``most``. Other columns are not read. An empty input gives an empty result.
    """
    sort = [f"_s{i}" for i in range(len(locality or []))]
    picked = links.where(F.col(node).isNotNull()).select(
        F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent"),
        *(F.col(c).alias(s) for c, s in zip(locality or [], sort, strict=True))
    )
    once = picked.groupBy("node").agg(F.max("parent").alias("parent"), *(F.min(s).alias(s) for s in sort))
    there = once.select(F.col("node").alias("parent"), F.lit(True).alias("_there"))
    own = once.join(there, "parent", "left").select(
        "node", F.when(F.col("_there"), F.col("parent")).alias("parent"), *sort
    )
    own = materialise(own, "links")
    rooted = F.col("parent").isNull()
    state = own.select(
        "node", F.coalesce("parent", "node").alias("top"), F.when(rooted, 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("node").alias("low"), F.when(rooted, ROOT).otherwise(OPEN).cast("int").alias("kind"), *sort,
    )
    done = _solve(state, [*sort, "node"], own.count(), most)
    return done.join(own.select("node", "parent"), "node").select(
        "node", "parent", F.col("top").alias("root"),
        F.when(F.col("kind") == LOOP, -1).otherwise(F.col("dist")).cast("int").alias("depth")
    )


def cut_loops(trees: DataFrame, most: int = 16_384) -> DataFrame:
    """``trees`` with each loop cut above its smallest id, and ``looped``: nodes on and below loops hang below that id,
    so they have depths and paths too.

    The path of such a node leads from the smallest id of the loop along the links round the loop, then down to the
    node.
    """
    trees = materialise(trees, "trees")
    looped = trees.where("depth < 0").select(
        "node", F.when(F.col("node") != F.col("root"), F.col("parent")).alias("parent")
    )
    again = forest(looped, "node", "parent", most=most)
    return trees.where("depth >= 0").withColumn("looped", F.lit(False)).unionByName(
        again.withColumn("looped", F.lit(True))
    )


def path_segments(trees: DataFrame, length: int = 64) -> DataFrame:
    """``trees`` with its path, stored in pieces: (node, root, depth, anchor, segment).

    ``segment`` lists the ids from the node (inclusive) up to, not including, ``anchor``: the nearest proper ancestor
    whose depth is a multiple of ``length`` (null above the first). The path of a node is its segment followed by that
    of its anchor and so on, so all paths together take at most ``length`` ids a node instead of the square of a long
    history. Nodes on or below loops have a segment of themselves only, unless ``cut_loops`` has given them depths. The
    index by node is walked upwards by doubling, log2(length) joins.
    """
    t = trees.select(
        "node", "root", "depth", F.when(F.col("depth") >= 0, F.col("parent")).alias("anchor"),
        F.array("node").alias("segment")
    )
    # A node at a multiple of length ends every walk that reaches it.
    step = length
    while step > 1:
        t = materialise(t, "paths")
        up = t.select(
            F.col("node").alias("anchor"), F.col("anchor").alias("a2"), F.col("segment").alias("s2"),
            (F.col("depth") % length != 0).alias("passes")
        )
        j = t.join(up, "anchor", "left")
        go = F.coalesce(F.col("passes"), F.lit(False))
        t = j.select(
            "node", "root", "depth", F.when(go, F.col("a2")).otherwise(F.col("anchor")).alias("anchor"),
            F.when(go, F.concat("segment", "s2")).otherwise(F.col("segment")).alias("segment")
        )
        step //= 2
    return t


def _contracted(segments: DataFrame, length: int) -> DataFrame:
    """The tree of the anchors: each points to its own anchor, so it is ``length`` times as flat and about that much
    smaller."""
    a = segments.where((F.col("depth") >= 0) & (F.col("depth") % length == 0))
    return path_segments(
        a.select("node", F.col("anchor").alias("parent"), "root", (F.col("depth") / length).cast("int").alias("depth")),
        length
    )


def full_paths(trees: DataFrame, nodes: DataFrame, length: int = 64) -> DataFrame:
    """(node, path): for each id in ``nodes`` (column node) the ids from its root down to itself.

    The anchors on the way are found in the tree of anchors, by the same means, so the number of joins grows with the
    logarithm of the depth. A node on or below a loop has a path of itself. Ids that are not in ``trees`` give nothing;
    repeated ids one row.
    """
    return _paths(materialise(path_segments(trees, length), "segments"), nodes.select("node").distinct(), length)


def _paths(segments: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    own = materialise(asked.join(segments.select("node", "anchor", "segment"), "node"), "asked")
    above = own.where("anchor is not null").select(F.col("anchor").alias("node")).distinct()
    if above.isEmpty():
        return own.select("node", F.reverse("segment").alias("path"))
    anchors = _paths(materialise(_contracted(segments, length), "anchors"), above, length)
    step = anchors.select(F.col("node").alias("anchor"), F.posexplode("path").alias("_at", "_a"))
    part = step.join(segments.select(F.col("node").alias("_a"), F.reverse("segment").alias("_s")), "_a")
    to_anchor = part.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_p")).select(
        "anchor", F.flatten(F.transform("_p", lambda x: x["_s"])).alias("_p")
    )
    none = F.expr("cast(array() as array<bigint>)")
    return own.join(to_anchor, "anchor", "left").select(
        "node", F.concat(F.coalesce("_p", none), F.reverse("segment")).alias("path")
    )


def descendants(trees: DataFrame, roots: DataFrame, length: int = 64) -> DataFrame:
    """(ancestor, node): all proper descendants of the ids in ``roots`` (column node). Nodes on or below loops have none
    and are none."""
    seg = materialise(path_segments(trees, length).where("depth >= 0"), "segments")
    return _below(seg, roots.select(F.col("node").alias("ancestor")).distinct(), length).where("ancestor <> node")


def _below(segments: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(ancestor, node) of the nodes whose path holds the asked id, itself included: it stands in their own segment, or
    at or above their anchor."""
    own = segments.select("node", "depth", F.explode("segment").alias("ancestor")).join(asked, "ancestor")
    hits = materialise(own.select("ancestor", "node", (F.col("depth") % length == 0).alias("_is_anchor")), "hits")
    heads = hits.where("_is_anchor").select("ancestor", F.col("node").alias("_head"))
    hits = hits.select("ancestor", "node")
    below = segments.select("anchor", "node").where("anchor is not null")
    if heads.isEmpty() or below.isEmpty():
        return hits
    anchors = _below(
        materialise(_contracted(segments, length), "anchors"),
        heads.select(F.col("_head").alias("ancestor")).distinct(), length
    )
    reach = heads.join(
        anchors.select(F.col("ancestor").alias("_head"), F.col("node").alias("anchor")), "_head"
    ).select("ancestor", "anchor")
    return hits.unionByName(below.join(reach, "anchor").select("ancestor", "node"))


def subtree_sizes(trees: DataFrame, length: int = 64) -> DataFrame:
    """(node, descendants): how many proper descendants every node has; 0 on and below loops. Linear in the number of
    nodes, whatever their depth."""
    seg = materialise(path_segments(trees, length), "segments")
    sums = _sums(
        seg.where("depth >= 0"), seg.where("depth >= 0").select("node", F.lit(1).cast("bigint").alias("w")), length
    )
    return seg.select("node").join(sums, "node", "left").select(
        "node", (F.coalesce("w", F.lit(1)) - 1).alias("descendants")
    )


def _sums(segments: DataFrame, weights: DataFrame, length: int) -> DataFrame:
    """(node, w): the sum of the weights in each node's subtree, itself included."""
    s = materialise(segments.join(weights, "node"), "weighted")
    own = s.select(F.explode("segment").alias("node"), "w")
    by_anchor = s.where("anchor is not null").groupBy(F.col("anchor").alias("node")).agg(F.sum("w").alias("w"))
    if not by_anchor.isEmpty():
        tree = materialise(_contracted(segments, length), "anchors")
        upper = _sums(
            tree,
            tree.select("node").join(by_anchor, "node", "left").select(
                "node", F.coalesce("w", F.lit(0).cast("bigint")).alias("w")
            ),
            length
        )
        own = own.unionByName(segments.join(upper, "node").select(F.explode("segment").alias("node"), "w"))
    return own.groupBy("node").agg(F.sum("w").alias("w"))
