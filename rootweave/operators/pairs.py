"""Distances over all pairs of two sets: their sum, and every member's nearest, without a row for each pair.

Where few nodes have most of the neighbours (hubs), nearly all shortest paths lead over one of them, so a pair's distance
is the least sum of both ends' distances to a hub. Nodes with equal distances to all hubs are counted as one class. Only
pairs that are nearer without any hub are found one by one, in what is left of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.operators import bits
from rootweave.operators import graph as g
from rootweave.session import cut, spread

# A node is a hub from so many neighbours on; the largest are taken.
HUB, MOST_HUBS = 32, 32
# Without its hubs the graph must branch less than this (neighbours met by following an edge, without the one left), so
# that it falls into small parts. Otherwise all pairs are searched as bits.
BRANCHING = 1.0
# No path. Two of them and a distance fit an int.
FAR = 1 << 29
# Tasks for the classes of one sample.
PARTS = 16


def _without(graph: DataFrame, hubs: list[str]) -> DataFrame:
    return graph.where(~F.col("a").isin(hubs) & ~F.col("b").isin(hubs))


def hubs(graph: DataFrame) -> list[str]:
    """The hubs of a graph (``a, b``); none if it doesn't fall apart without them."""
    graph = graph.where("a <> b")
    most = g.degrees(graph).where(F.col("degree") >= HUB).orderBy(F.desc("degree"), "node").limit(MOST_HUBS)
    top = [r["node"] for r in most.collect()]
    k = F.col("degree")
    branching = top and g.degrees(_without(graph, top)).agg((F.sum(k * (k - 1)) / F.sum(k)).alias("b")).first()["b"]
    return top if (branching or 0) < BRANCHING else []


def profiles(graph: DataFrame, hubs: list[str]) -> DataFrame:
    """``node, far``: the distances of every node to all hubs. A node that reaches none has no row."""
    seeds = graph.sparkSession.createDataFrame(list(enumerate(hubs)), "key int, node string")
    to = [F.coalesce(F.min(F.when(F.col("key") == k, F.col("d"))), F.lit(FAR)) for k in range(len(hubs))]
    return cut(g.bfs(g.neighbours(graph), seeds).groupBy("node").agg(F.array(*to).alias("far")), "profiles")


def _over(a: str, b: str) -> Column:
    """The least way over a hub."""
    return F.least(F.coalesce(F.array_min(F.zip_with(a, b, lambda x, y: x + y)), F.lit(FAR)), F.lit(FAR))


def nearer(graph: DataFrame, hubs: list[str], profile: DataFrame, sources: DataFrame) -> DataFrame:
    """``src, node, d, over``: nodes that a source (``node``) reaches without hubs on a way ``d`` shorter than ``over``,
    the least over a hub.

    A way that isn't shorter is not followed: whatever lies behind it is as near over the hub.
    """
    after = profile.select(F.col("node").alias("next"), F.col("far").alias("to"))
    steps = cut(g.neighbours(_without(graph, hubs)).join(after, "next", "left"), "steps")
    first = sources.where(~F.col("node").isin(hubs)).select("node").distinct().join(profile, "node", "left")
    level = cut(first.select(F.col("node").alias("src"), "node", "far", _over("far", "far").alias("over")), "near")
    before, blocks, parts, depth = level.limit(0), [], [], 0
    while not level.isEmpty():
        parts.append(level.select("src", "node", F.lit(depth).alias("d"), "over"))
        if len(parts) > g.BLOCK:
            blocks, parts = [*blocks, cut(reduce(DataFrame.unionByName, parts), "nearer")], []
        depth += 1
        found = level.join(steps, "node").select("src", F.col("next").alias("node"), "far", _over("far", "to").alias("over")).where(F.col("over") > depth)
        found = found.groupBy("src", "node").agg(F.first("far").alias("far"), F.first("over").alias("over"))
        old = level.select("src", "node").unionByName(before.select("src", "node"))
        before, level = level, cut(found.join(old, ["src", "node"], "left_anti"), "near")
    return reduce(DataFrame.unionByName, [*blocks, *parts, level.select("src", "node", F.lit(depth).alias("d"), "over")])


def _of_classes(classes: DataFrame) -> DataFrame:
    """``pair, it, total, n`` of the ways over hubs, from ``pair, it, side, far, times``."""

    def run(table: pa.Table) -> pa.Table:
        sides, width = [], len(table["far"][0])
        for s in "AB":
            x = table.filter(pc.equal(table["side"], s)).combine_chunks()
            far = np.array(x["far"].to_pylist(), np.int32).reshape(x.num_rows, width)
            sides += [far, x["times"].to_numpy().astype(np.int64)]
        a, times_a, b, times_b = sides
        total = n = 0
        step = max(1, (1 << 21) // max(1, len(b)))
        for i in range(0, len(a) if len(b) else 0, step):
            part = a[i : i + step]
            best = np.full((len(part), len(b)), FAR, np.int32)
            for h in range(a.shape[1]):
                np.minimum(best, part[:, h, None] + b[None, :, h], out=best)
            there = best < FAR
            total += int(times_a[i : i + step] @ (np.where(there, best, 0) @ times_b))
            n += int(times_a[i : i + step] @ (there @ times_b))
        return pa.table({"pair": table["pair"][:1], "it": table["it"][:1], "total": pa.array([total], pa.int64()), "n": pa.array([n], pa.int64())})

    part = F.pmod(F.xxhash64("far"), F.lit(PARTS)).cast("int")
    a = classes.where("side = 'A'").withColumn("part", part)
    b = classes.where("side = 'B'").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    key = ["pair", "it", "part"]
    return spread(a.unionByName(b), *key).groupBy(*key).applyInArrow(run, "pair string, it int, total bigint, n bigint")


def sums(graph: DataFrame, sampled: DataFrame) -> DataFrame:
    """``pair, it, total, n``: the sum of the distances of all pairs of a node of side A and one of side B, and their number,
    from ``pair, it, side, node, times``. Unreachable pairs don't count; without any other there may be no row."""
    top = hubs(graph)
    if not top:
        return _of_bits(graph, sampled)
    profile = profiles(graph, top)
    classes = sampled.join(profile, "node").groupBy("pair", "it", "side", "far").agg(F.sum("times").alias("times"))
    side = lambda s, node, times: sampled.where(F.col("side") == s).select("pair", "it", F.col("node").alias(node), F.col("times").alias(times))
    a, b = side("A", "src", "times_a"), side("B", "node", "times_b")
    near = nearer(graph, top, profile, a.select(F.col("src").alias("node"))).join(b, "node", "left_semi")
    near = near.join(a, "src").join(b, ["pair", "it", "node"]).withColumn("times", F.col("times_a") * F.col("times_b"))
    less = F.col("d") - F.when(F.col("over") < FAR, F.col("over")).otherwise(0)
    near = near.groupBy("pair", "it").agg(F.sum(F.col("times") * less).alias("total"), F.sum(F.when(F.col("over") < FAR, 0).otherwise(F.col("times"))).alias("n"))
    return _of_classes(classes).unionByName(near).groupBy("pair", "it").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _of_bits(graph: DataFrame, sampled: DataFrame) -> DataFrame:
    """``sums`` in any graph: one search per distinct node of any side A, shared by all samples it was drawn into. A level
    holds as bits which searches reach a node, a sample's side A is a set of bits too (one for each binary digit of
    the repeats), and the bits they have in common are counted."""
    side = lambda s: sampled.where(F.col("side") == s).drop("side")
    found, keys = g.levels(g.neighbours(graph), side("A").select(F.col("node").alias("key"), "node").distinct())
    word, bit = bits.word_and_bit()
    digits = F.expr("filter(sequence(0, 31), k -> (shiftright(times, k) & 1) = 1)")
    masks = side("A").withColumnRenamed("node", "key").join(keys, "key").select("pair", "it", word.alias("word"), bit.alias("bit"), F.explode(digits).alias("digit"))
    masks = masks.groupBy("pair", "it", "word", "digit").agg(F.bit_or("bit").alias("mask"))
    met = found.join(side("B"), "node").join(masks, ["pair", "it", "word"])
    n = F.bit_count(F.col("bits").bitwiseAND(F.col("mask"))) * F.col("times") * F.expr("shiftleft(1L, digit)")
    return met.select("pair", "it", "d", n.alias("n")).groupBy("pair", "it").agg(F.sum(F.col("d") * F.col("n")).alias("total"), F.sum("n").alias("n"))


def _others(members: DataFrame, what: str) -> Iterator[DataFrame]:
    """Seeds and wanted nodes (``key, node``) of searches that meet every member's nearest other one. Members have numbers,
    and two of them differ in a bit, so for each bit those with it are searched from those without, and back."""
    numbers = bits.number(members)
    r = numbers.agg(F.bit_or("n").alias("any"), F.bit_and("n").alias("all")).first()
    places = [k for k in range(63) if ((r["any"] or 0) ^ (r["all"] or 0)) >> k & 1]
    rows = numbers.select("node", "n", F.explode(F.array(*[F.lit(k) for k in places]).cast("array<int>")).alias("k"))
    bit = F.expr("shiftright(n, k) & 1")
    for own in (bit, 1 - bit):
        yield rows.select(F.concat_ws(":", F.lit(what), "k", own.cast("string")).alias("key"), "node")


def nearest(graph: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``what, node, low``: for every node of ``a`` the nearest of ``b`` ('a'), the other way ('b'), and the nearest other
    of its own set ('aa', 'bb'). Without one there is no row. All are searches from whole sets, side by side."""
    (from_a, to_a), (from_b, to_b) = _others(a, "aa"), _others(b, "bb")
    at = lambda key, x: x.select(F.lit(key).alias("key"), "node")
    seeds = reduce(DataFrame.unionByName, [at("a", b), at("b", a), from_a, from_b])
    wanted = reduce(DataFrame.unionByName, [at("a", a), at("b", b), to_a, to_b])
    found = g.bfs(g.neighbours(graph), seeds, wanted)
    return found.groupBy(F.substring_index("key", ":", 1).alias("what"), "node").agg(F.min("d").alias("low"))


def set_distances(graph: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The row of ``graph.set_distances`` for the sets ``a`` and ``b`` (``node``) of a graph (``a, b``), without the distances
    from all members to all nodes."""
    a, b = (cut(x.select("node").distinct(), "set") for x in (a, b))
    inside = g.nodes(graph)
    in_a, in_b = (cut(x.join(inside, "node", "left_semi"), "in-graph") for x in (a, b))
    tag = lambda df, *names: df.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("what"), "node")
    inf = F.lit(float("inf"))
    low = tag(a, "a", "aa").unionByName(tag(b, "b", "bb")).join(nearest(graph, in_a, in_b), ["what", "node"], "left")
    rows = low.select("what", F.coalesce(F.col("low").cast("double"), inf).alias("low"))
    side = lambda df, s: df.select(F.lit("").alias("pair"), F.lit(0).alias("it"), F.lit(s).alias("side"), "node", F.lit(1).cast("bigint").alias("times"))
    all_ = sums(graph, side(in_a, "A").unionByName(side(in_b, "B"))).agg(F.sum("total").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    mean = lambda *names: F.avg(F.when(F.col("what").isin(*names), F.col("low")))
    inner = lambda x: F.when(F.count_if(F.col("what") == x) <= 1, 0.0).otherwise(mean(x))
    means = rows.agg(
        mean("a", "b").alias("closest"),
        (mean("a", "b") - (inner("aa") + inner("bb")) / 2).alias("separation"),
        F.coalesce(F.avg(F.when((F.col("what") == "a") & (F.col("low") < inf), F.col("low"))), inf).alias("closest_directed"),
        (F.count_if(F.col("what") == "a") * F.count_if(F.col("what") == "b")).alias("n_pairs"),
    )
    over = F.col("total") / F.nullif("n", F.lit(0))
    return means.crossJoin(all_).select(
        "closest", "separation", F.when(F.col("n") < F.col("n_pairs"), inf).otherwise(over).alias("shortest"), F.coalesce(over, inf).alias("mean_all_pairs"), "closest_directed",
    )
