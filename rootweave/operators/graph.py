"""Unweighted undirected graphs as edge tables: degrees, breadth-first distances, set distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions.ids import canon_pair
from rootweave.operators import bits
from rootweave.session import cut

# Levels of a search that are united in one plan; each further block of so many becomes a table of its own.
BLOCK = 50


def simple_graph(ends: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``a, b``: distinct canonical edges; null ends dropped, self-loops kept."""
    x, y = canon_pair(a, b)
    return ends.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(x.alias("a"), y.alias("b")).distinct()


def neighbours(graph: DataFrame) -> DataFrame:
    """``node, next`` in both directions; a self-loop leads nowhere new and is left out."""
    g = graph.where("a <> b")
    return g.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(g.select(F.col("b").alias("node"), F.col("a").alias("next")))


def nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """``node, degree``: ends per node. Over ``simple_graph`` a self-loop counts twice; over raw rows every row counts."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_buckets(degree: DataFrame) -> DataFrame:
    """Adds ``idx`` (from 0, by node) and ``size`` within the nodes of the same degree.

    A bucket may hold most nodes, so no window sorts it in one task: nodes are range-sorted by (degree, node),
    numbered within their partition, and the partitions' counts give the offsets.
    """
    spread = cut(degree.repartitionByRange("degree", "node").withColumn("part", F.spark_partition_id()), "degrees")
    local = Window.partitionBy("degree", "part").orderBy("node")
    counts = spread.groupBy("degree", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("degree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("degree")
    offsets = counts.select("degree", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"))
    numbered = spread.withColumn("at", F.row_number().over(local) - 1)
    return numbered.join(offsets, ["degree", "part"]).select("node", "degree", (F.col("at") + F.col("before")).alias("idx"), "size")


def bin_edges(degree: DataFrame, bins: int = 5) -> list[float]:
    """The distinct linear quantiles of the degrees, at most bins+1 numbers, rounded to nine digits."""
    at = ", ".join(f"{i / bins:.10g}D" for i in range(bins + 1))
    row = degree.agg(F.expr(f"percentile(degree, array({at}))").alias("q")).first()
    return sorted({round(x, 9) for x in row["q"] or []})


def degree_bins(degree: DataFrame, bins: int = 5) -> DataFrame:
    """Adds ``bin``: how many quantile edges lie below the degree."""
    below = sum(((F.lit(e) < F.col("degree")).cast("int") for e in bin_edges(degree, bins)), F.lit(0))
    return degree.select("node", "degree", below.alias("bin"))


def bfs(adjacency: DataFrame, seeds: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``key, node, d``: levels of breadth-first searches, one per ``key`` of ``seeds`` (``key, node``). See ``levels``."""
    found, keys = levels(adjacency, seeds, wanted)
    return bits.unpack(found, keys).select("key", "node", "d")


def levels(adjacency: DataFrame, seeds: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The levels of ``bfs`` as bits (``word, node, bits, d``), and the numbers of the keys (``key, n``).

    A key's search starts from all its seeds at once, so ``d`` is the distance to the nearest of them. With
    ``wanted`` (``key, node``) only these nodes come out, and a key's search ends once it has met all of its own;
    without, it ends when it finds no new node, however deep that is.

    All keys advance together as bits, so a level moves one row per edge and word of 64 keys. A level's table
    holds per node what is new (``bits``), what was new one level before (``old``) and what is still wanted; it
    is written to the shared folder, which cuts the lineage and keeps the job safe from lost executors.
    """
    adjacency = cut(adjacency, "adjacency")
    keys = bits.number(seeds.select("key"))
    no = F.lit(0).cast("bigint")
    new, now = F.col("bits"), F.col("bits").bitwiseOR(F.col("old"))
    row = lambda df, **c: df.select("word", "node", *[c.get(k, no).alias(k) for k in ("new", "seen", "now", "want")])
    pending = row(bits.pack(seeds.select("key", "node").distinct(), keys, "node"), new=new)
    if wanted is not None:
        pending = pending.unionByName(row(bits.pack(wanted.select("key", "node").distinct(), keys, "node"), want=new))
    blocks, parts, depth = [], [], 0
    while True:
        merged = pending.groupBy("word", "node").agg(*[F.bit_or(c).alias(c) for c in ("new", "seen", "now", "want")])
        # In an undirected graph a neighbour of a level can only be new, in that level or in the one before.
        found = merged.withColumn("bits", F.col("new").bitwiseAND(F.bitwise_not("seen")))
        met, rest = F.col("bits").bitwiseAND(F.col("want")), F.col("want").bitwiseAND(F.bitwise_not("bits"))
        level = cut(found.select("word", "node", "bits", F.col("now").alias("old"), met.alias("met"), rest.alias("want")).where("bits <> 0 or old <> 0 or want <> 0"), "level")
        parts.append(level.select("word", "node", F.col("bits" if wanted is None else "met").alias("bits"), F.lit(depth).alias("d")).where("bits <> 0"))
        left = level.agg(F.bool_or(F.col("bits") != 0).alias("bits"), F.bool_or(F.col("want") != 0).alias("want")).first()
        if not left["bits"] or (wanted is not None and not left["want"]):
            break
        if len(parts) > BLOCK:
            blocks.append(cut(reduce(DataFrame.unionByName, parts), "levels"))
            parts = []
        front = level.where("bits <> 0").select("word", "node", "bits")
        if wanted is not None:
            mask = level.where("want <> 0").groupBy("word").agg(F.bit_or("want").alias("open"))
            front = front.join(mask, "word").select("word", "node", F.col("bits").bitwiseAND(F.col("open")).alias("bits")).where("bits <> 0")
        step = front.join(adjacency, "node").select("word", F.col("next").alias("node"), "bits")
        pending, depth = row(step, new=new).unionByName(row(level, seen=now, now=new, want=F.col("want"))), depth + 1
    return reduce(DataFrame.unionByName, [*blocks, *parts]), keys


def distances(graph: DataFrame, sources: DataFrame) -> DataFrame:
    """``src, dst, d`` from every ``sources.node`` that is in the graph to all nodes it reaches."""
    seeds = sources.join(nodes(graph), "node", "left_semi").select(F.col("node").alias("key"), "node")
    return bfs(neighbours(graph), seeds).select(F.col("key").alias("src"), F.col("node").alias("dst"), "d")


def missing_sources(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose distances a cache table (``src, dst, d``) does not hold yet."""
    return sources.select("node").distinct().join(cache.select(F.col("src").alias("node")), "node", "left_anti")


def same_nodes(graph: DataFrame, cache: DataFrame) -> bool:
    """Whether a cache of distance rows speaks of no node that the graph lacks, and so may still be used."""
    known = cache.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return known.join(nodes(graph), "node", "left_anti").isEmpty()


def pair_table(distance: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``x, y, d`` for all known pairs of set ``a`` and set ``b`` (``node``). Unreachable pairs have no row."""
    x, y = a.select(F.col("node").alias("src")), b.select(F.col("node").alias("dst"))
    return distance.join(x, "src", "left_semi").join(y, "dst", "left_semi").select(F.col("src").alias("x"), F.col("dst").alias("y"), "d")


def look_up(distance: DataFrame, pairs: DataFrame) -> DataFrame:
    """``x, y, d`` for given pairs (``x, y``); infinity where no path or no such node is known."""
    known = distance.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("d").cast("double").alias("d"))
    return pairs.join(known, ["x", "y"], "left").withColumn("d", F.coalesce("d", F.lit(float("inf"))))


def _nearest(pairs: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """Distance of every member to its nearest partner; infinity without one."""
    low = pairs.groupBy(side).agg(F.min("d").alias("low"))
    return members.select(F.col("node").alias(side)).distinct().join(low, side, "left").select(F.coalesce(F.col("low").cast("double"), F.lit(float("inf"))).alias("low"))


def set_distances(distance: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``closest, separation, shortest, mean_all_pairs, closest_directed`` for the sets ``a`` and ``b``.

    closest: mean over both sets' members of the nearest in the other set. separation: closest minus the mean
    inner distance of both sets (0 for a single member). shortest: mean over all pairs. These keep infinity.
    mean_all_pairs and closest_directed (from ``a`` only) leave unreachable ones out. ``distance`` must hold
    rows from all members of both sets.
    """
    distance, a, b = cut(distance, "distances"), cut(a, "set-a"), cut(b, "set-b")
    ab, aa, bb = pair_table(distance, a, b), pair_table(distance, a, a).where("x <> y"), pair_table(distance, b, b).where("x <> y")
    tag = lambda df, name: df.select(F.lit(name).alias("what"), F.col("low").cast("double").alias("low"))
    n_pairs = a.select("node").distinct().count() * b.select("node").distinct().count()
    parts = [tag(_nearest(ab, a, "x"), "a"), tag(_nearest(ab, b, "y"), "b"), tag(_nearest(aa, a, "x"), "aa"), tag(_nearest(bb, b, "x"), "bb"), tag(ab.withColumnRenamed("d", "low"), "ab")]
    rows = reduce(DataFrame.unionByName, parts)
    mean = lambda *names: F.avg(F.when(F.col("what").isin(*names), F.col("low")))
    n = lambda name: F.count_if(F.col("what") == name)
    finite = F.col("low") < F.lit(float("inf"))
    inner = lambda name: F.when(n(name) <= 1, 0.0).otherwise(mean(name))
    inf = F.lit(float("inf"))
    return rows.agg(
        mean("a", "b").alias("closest"),
        (mean("a", "b") - (inner("aa") + inner("bb")) / 2).alias("separation"),
        F.when(n("ab") < n_pairs, inf).otherwise(mean("ab")).alias("shortest"),
        F.coalesce(mean("ab"), inf).alias("mean_all_pairs"),
        F.coalesce(F.avg(F.when((F.col("what") == "a") & finite, F.col("low"))), inf).alias("closest_directed"),
    )
