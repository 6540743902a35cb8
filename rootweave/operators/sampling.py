"""Deterministic random draws: a hash of seed, iteration and position, equal on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.session import cut


def draw(*parts: Column | str | int) -> Column:
    """A number below 2**60 from the first 15 hex digits of an MD5 over the parts, joined by '|'."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def degree_matched(sets: DataFrame, buckets: DataFrame, n_random: int, seed: int) -> DataFrame:
    """``pair, side, it, node`` for it = 1..n_random: for every member of every set one node of the same degree,
    with replacement, the member itself included.

    ``sets``: ``pair, side, node``; ``buckets``: ``node, degree, idx, size``. Members outside the graph draw nothing.
    """
    members = sets.join(buckets, "node").select("pair", "side", F.col("node").alias("orig"), "degree", "size", F.explode(F.sequence(F.lit(1), F.lit(n_random))).alias("it"))
    picked = members.withColumn("idx", F.pmod(draw(seed, F.col("pair"), F.col("it"), F.col("side"), F.col("orig")), F.col("size")))
    return picked.join(buckets.select("degree", "idx", "node"), ["degree", "idx"]).select("pair", "side", "it", "node")


def uniform(background: DataFrame, sizes: dict[str, int], n_iter: int, seed: int, most: float = 4.0, more: int = 64) -> DataFrame:
    """``side, it, node``: for every iteration and side, ``sizes[side]`` distinct nodes of ``background`` (``node``),
    all of them where it has fewer.

    A node's hash decides; the least are taken, ties by node. First only rows under a hash bound that lets about
    ``most`` n + ``more`` nodes through are ranked (all of them where the background is smaller), so a window
    group holds about four times the wanted sample, not the background. A draw that comes out short under its
    bound is ranked again over all nodes.
    """
    background = cut(background.select("node").distinct(), "background")
    total = max(background.count(), 1)
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(min(n, total)).alias("n"), F.lit((most * n + more) / total * float(1 << 60)).alias("bound")) for k, n in sizes.items()])
    rows = background.select("node", F.explode(sides).alias("s")).select("node", "s.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_iter))).alias("it"))
    w = Window.partitionBy("side", "it").orderBy("h", "node")

    def ranked(df: DataFrame, within) -> DataFrame:
        df = df.withColumn("h", draw(seed, F.col("it"), F.col("side"), F.col("node"))).where(within)
        return df.withColumn("r", F.row_number().over(w)).where("r <= n").select("side", "it", "node")

    first = cut(ranked(rows, F.col("h") <= F.col("bound")), "draws")
    n = F.create_map(*[F.lit(x) for k, size in sizes.items() for x in (k, min(size, total))])
    full = cut(first.groupBy("side", "it").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == n[F.col("side")]).select("side", "it"), "full-draws")
    if full.count() == n_iter * len(sizes):
        return first
    return first.join(full, ["side", "it"], "left_semi").unionByName(ranked(rows.join(full, ["side", "it"], "left_anti"), F.lit(True)))


def bin_matched(targets: DataFrame, background: DataFrame, n_iter: int, seed: int) -> DataFrame:
    """``side, it, node``: as many background nodes of each degree bin as the targets have in it, without replacement.

    ``targets``: ``side, node, bin``; ``background``: ``node, bin``. A bin with too few candidates gives all it
    has; what is missing comes from the bins next to it, nearest first, of two the lower, then by hash. No node
    is taken twice for one need; different needs may meet in a node.
    """
    need = targets.groupBy("side", F.col("bin").alias("need_bin")).agg(F.count(F.lit(1)).alias("need"))
    # Bins are quantiles, so few: their sizes become one literal array.
    sizes = background.groupBy("bin").agg(F.count(F.lit(1)).alias("size")).collect()
    table = F.array(*[F.struct(F.lit(r["bin"]).alias("bin"), F.lit(r["size"]).alias("size")) for r in sizes])
    reach = need.select("*", F.explode(table).alias("b")).select("side", "need_bin", "need", "b.*").withColumn("far", F.abs(F.col("bin") - F.col("need_bin")))
    order = Window.partitionBy("side", "need_bin").orderBy("far", "bin")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = reach.withColumn("take", F.least(F.col("size"), F.col("need") - before)).where("take > 0")
    rows = background.join(F.broadcast(reach), "bin").select("side", "need_bin", "bin", "take", "node", F.explode(F.sequence(F.lit(1), F.lit(n_iter))).alias("it"))
    rows = rows.withColumn("h", draw(seed, F.col("it"), F.col("side"), F.col("need_bin"), F.col("node")))
    w = Window.partitionBy("side", "it", "need_bin", "bin").orderBy("h", "node")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= take").select("side", "it", "node")
