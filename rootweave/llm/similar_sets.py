"""All pairs of records whose sets of values overlap above a similarity.

Binary sketches: one bit of each of m*w minhashes. Two sets of similarity J agree in a bit with probability
(1+J)/2, so at the threshold a segment of w bits is equal with probability p = ((1+t)/2)^w. By the pigeonhole
argument in its probabilistic form, m = ln(1-recall)/ln(1-p) segments leave at most 1-recall of the pairs at
the threshold (fewer above it) without a common segment. Pairs that share a segment must lie within a Hamming
radius over the first CHECK_BITS bits, chosen so that it drops at most RADIUS_LOSS of such pairs; the rest is
verified on the original sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.session import cut

RECALL, RADIUS_LOSS = 0.999, 1e-4
CHECK_WORDS = 3
CHECK_BITS = 64 * CHECK_WORDS
#: Sets with more members than this are sketched in pieces whose minima are merged.
PIECE = 50_000


def plan(n_records: int, threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """Segment width w, number of segments m and Hamming radius. w grows with log2 of the records, so the
    chance pairs per record and segment stay level."""
    w = max(8, math.ceil(math.log2(max(n_records, 2))) - 4)
    same = (1 + threshold) / 2
    m = math.ceil(math.log(1 - recall) / math.log(1 - same**w))
    m = max(m, math.ceil(CHECK_BITS / w))
    tail, radius = 1.0, -1
    while tail > RADIUS_LOSS:
        radius += 1
        tail -= math.comb(CHECK_BITS, radius) * (1 - same) ** radius * same ** (CHECK_BITS - radius)
    return w, m, radius


def _minima(values: np.ndarray, starts: np.ndarray, n_hashes: int, seed: int = 20_101):
    """Minhashes, one vector over all sets per hash function (multiply-add on 64-bit values)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n_hashes, dtype=np.uint64)
    for k in range(n_hashes):
        yield np.minimum.reduceat(values * a[k] + b[k], starts)


def _sketch_rows(bits: np.ndarray, w: int, m: int) -> list[pa.Array]:
    """``bits`` (m*w x sets) -> the check words and the list of segment keys (segment number, then its code)."""
    n = bits.shape[1]
    words = np.packbits(bits[:CHECK_BITS], axis=0, bitorder="little").T.copy().view("<i8")
    codes = np.zeros((n, m), dtype=np.int64)
    for j in range(w):
        codes |= bits[j::w].T.astype(np.int64) << j
    codes += np.arange(m, dtype=np.int64) << w
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(codes.ravel()))
    return [pa.array(words[:, i]) for i in range(CHECK_WORDS)] + [lists]


_WORDS = [f"s{i}" for i in range(CHECK_WORDS)]
_SCHEMA = "id bigint, n int, " + ", ".join(f"{s} bigint" for s in _WORDS) + ", codes array<bigint>"


def sketches(pieces: DataFrame, w: int, m: int) -> DataFrame:
    """``pieces``: ``id, n, n_pieces, hashes`` -> ``id, n``, check words and segment keys. A set in several
    pieces sends its partial minima, which merge by minimum; all others are done in the map task."""
    k = m * w

    def flat(b):
        lists = b.column("hashes")
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
        return values, starts

    def whole(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                values, starts = flat(b)
                bits = np.empty((k, b.num_rows), dtype=np.uint8)
                for i, low in enumerate(_minima(values, starts, k)):
                    bits[i] = (low >> np.uint64(32)) & np.uint64(1)
                yield pa.record_batch([b.column("id"), b.column("n"), *_sketch_rows(bits, w, m)], names=["id", "n", *_WORDS, "codes"])

    def partial(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                values, starts = flat(batch.slice(at, 1))
                low = np.concatenate(list(_minima(values, starts, k)))
                yield pa.record_batch([batch.column("id").slice(at, 1), batch.column("n").slice(at, 1), pa.array([low.tobytes()])], names=["id", "n", "low"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, n = None, 0
        for b in batches:
            for row, size in zip(b.column("low"), b.column("n")):
                x = np.frombuffer(row.as_buffer(), dtype=np.uint64)
                low, n = x if low is None else np.minimum(low, x), size.as_py()
        bits = ((low >> np.uint64(32)) & np.uint64(1)).astype(np.uint8)[:, None]
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([n], pa.int32()), *_sketch_rows(bits, w, m)], names=["id", "n", *_WORDS, "codes"])

    small = pieces.where("n_pieces = 1").select("id", "n", "hashes").mapInArrow(whole, _SCHEMA)
    large = pieces.where("n_pieces > 1").select("id", "n", "hashes").mapInArrow(partial, "id bigint, n int, low binary")
    return small.unionByName(large.groupBy("id").applyInArrow(merge, _SCHEMA))


class SimilarSets:
    """Similarity self-join over ``members`` (``rec, item``; distinct pairs, no nulls).

    ``classes``: ``rec, rep, n`` of every record with at least ``min_size`` items; records with equal sets
    form one class, represented by the least of them. ``pairs()``: pairs of representatives with
    similarity >= num/den. An empty table gives neither.
    """

    def __init__(self, members: DataFrame, num: int, den: int, min_size: int = 1, recall: float = RECALL):
        self.num, self.den, self.recall = num, den, recall
        self.members = cut(members.select("rec", "item").distinct(), "members")
        h = lambda salt: F.xxhash64("item", F.lit(salt))
        prints = self.members.groupBy("rec").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.bit_xor(h(1)).alias("f1"), F.bit_xor(h(2)).alias("f2"), F.bit_xor(h(3)).alias("f3")
        ).where(F.col("n") >= min_size)
        same = ["n", "f1", "f2", "f3"]
        prints = cut(prints, "set-prints")
        self.classes = cut(prints.join(prints.groupBy(*same).agg(F.min("rec").alias("rep")), same).select("rec", "rep", "n"), "classes")
        self.reps = cut(
            self.classes.where("rec = rep").select("rep", "n", F.monotonically_increasing_id().alias("id")), "representatives"
        )

    def pairs(self) -> DataFrame:
        """``rep_a, rep_b, n_common, n_union``, rep_a < rep_b."""
        w, m, radius = plan(self.reps.count(), self.num / self.den, self.recall)
        own = self.reps.join(self.members.withColumnRenamed("rec", "rep"), "rep").select("id", "n", "item")
        n_pieces = F.ceil(F.col("n") / PIECE).cast("int")
        pieces = (
            own.select("id", "n", F.xxhash64("item").alias("x"), n_pieces.alias("n_pieces"))
            .groupBy("id", "n", "n_pieces", F.pmod("x", F.col("n_pieces")).alias("piece"))
            .agg(F.collect_list("x").alias("hashes"))
        )
        rows = cut(sketches(pieces, w, m), "sketches").withColumn("code", F.explode("codes")).drop("codes")
        other = rows.select("code", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", *_WORDS)])
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"o_{s}"))) for s in _WORDS])
        near = (
            (F.col("id") < F.col("o_id"))
            & (F.least("n", "o_n") * self.den >= F.greatest("n", "o_n") * self.num)
            & (apart <= radius)
        )
        found = rows.join(other, (rows["code"] == other["code"]) & near).select("id", "o_id").distinct()
        found = cut(found, "candidates")
        theirs = own.select(F.col("id").alias("o_id"), F.col("n").alias("o_n"), "item")
        common = (
            found.join(own, "id").join(theirs, ["o_id", "item"])
            .groupBy("id", "o_id", "n", "o_n").agg(F.count(F.lit(1)).cast("int").alias("n_common"))
            .withColumn("n_union", F.col("n") + F.col("o_n") - F.col("n_common"))
            .where(F.col("n_common") * self.den >= F.col("n_union") * self.num)
        )
        name = lambda i, r: self.reps.select(F.col("id").alias(i), F.col("rep").alias(r))
        named = common.join(name("id", "x"), "id").join(name("o_id", "y"), "o_id")
        return named.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "n_common", "n_union")

    def expanded(self) -> DataFrame:
        """Every pair of records: ``rec_a, rec_b``, rec_a < rec_b, copies included."""
        member = lambda rep, rec: self.classes.select(F.col("rep").alias(rep), F.col("rec").alias(rec))
        across = self.pairs().join(member("rep_a", "x"), "rep_a").join(member("rep_b", "y"), "rep_b").select("x", "y")
        within = member("rep", "x").join(member("rep", "y"), "rep").where("x < y").select("x", "y")
        both = across.unionByName(within)
        return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))

    def membership(self) -> DataFrame:
        """One row per record: ``rec, rep, n, n_copies, n_links`` (links: other records it is paired with)."""
        size = self.classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
        pairs = cut(self.pairs().select("rep_a", "rep_b"), "pairs")
        both = pairs.unionByName(pairs.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
        links = (
            both.join(size.select(F.col("rep").alias("rep_b"), "n_copies"), "rep_b")
            .groupBy(F.col("rep_a").alias("rep")).agg(F.sum("n_copies").alias("links"))
        )
        per = size.join(links, "rep", "left").select("rep", "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
        return self.classes.join(per, "rep").select("rec", "rep", "n", "n_copies", "n_links")
