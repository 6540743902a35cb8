"""Unions of sets: a query's members are those of all sets that it names, each once.

Few sets may hold most of the members, and nearly every query may name them (hubs). Listing a member for every query
and set would then move many times the result. So hubs are sets of bits in the tasks that write the result, a
block of members at a time; only the members of the other sets are joined and made distinct as rows.

Results may be many times the input, so their order counts: member by member, the same queries come again and again,
and Parquet's pages hold little else than references to the page before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.session import cut, spread

# A set is a hub from so many members on, if several queries name it; those that would give the most rows come first, as
# long as they are so few and hold so few members in all. What isn't taken is joined like any other set.
HUB, MOST_HUBS, MOST_MEMBERS = 128, 1000, 1 << 20
# Members in a block: few enough that the dictionary of a file's column (1 MB) holds their names.
BLOCK = 1 << 15
# Rows of the result that a task is meant to write.
ROWS = 1 << 24
# Queries whose bits a task holds at once, and the members that it lists in a batch.
AT_ONCE, PART = 256, 1 << 11


def _flat(lists: pa.Array) -> Callable[[int], np.ndarray]:
    """The ``i``-th of ``lists`` as a view."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return lambda i: values[ends[i] : ends[i + 1]]


def _lists(bits: np.ndarray, first: int, queries: pa.Array) -> Iterator[pa.RecordBatch]:
    """``n`` and the queries of every member that has any."""
    for at in range(0, bits.shape[1], PART):
        n, which = np.nonzero(np.ascontiguousarray(bits[:, at : at + PART].T))
        if len(n):
            starts = np.flatnonzero(np.diff(n, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(n)).astype(np.int32)), queries.take(pa.array(which)))
            yield pa.RecordBatch.from_arrays([pa.array((n[starts] + (first + at)).astype(np.int32)), lists], ["n", "queries"])


class Unions:
    """``named``: distinct ``query, node``; ``sets``: distinct ``node`` and the columns of a member. Both are read
    several times, so they should be cut."""

    def __init__(self, named: DataFrame, sets: DataFrame):
        self.named, self.sets = named, sets
        self.columns = [c for c in sets.columns if c != "node"]

    @cached_property
    def hubs(self) -> dict[str, int]:
        """The rows that every hub would give if it were joined, the most first."""
        sizes = self.sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB)
        times = self.named.join(sizes, "node").groupBy("node", "n").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        out, total = {}, 0
        for r in times.orderBy(F.desc(F.col("n") * F.col("times")), "node").limit(MOST_HUBS).collect():
            if total + r["n"] <= MOST_MEMBERS:
                out[r["node"]], total = r["n"] * r["times"], total + r["n"]
        return out

    @cached_property
    def _listed(self) -> DataFrame:
        """``node, hub``: the hubs and their places."""
        return F.broadcast(self.named.sparkSession.createDataFrame(list(zip(self.hubs, range(len(self.hubs)))), "node string, hub int"))

    @cached_property
    def _members(self) -> tuple[DataFrame, list[np.ndarray]]:
        """``n`` and the columns of every member of a hub, and the numbers of each hub's members. Members of the same hubs
        have numbers in a row."""
        rows = self.sets.join(self._listed, "node").select("hub", *self.columns).toArrow()
        rows = rows.sort_by([("hub", "ascending"), *[(c, "ascending") for c in self.columns]])
        key = pc.binary_join_element_wise(*[rows[c].cast("string") for c in self.columns], "\x1f") if len(self.columns) > 1 else rows[self.columns[0]].cast("string")
        n = key.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
        _, first = np.unique(n, return_index=True)
        hub, same = rows["hub"].to_numpy(), np.zeros(len(first), np.uint64)
        np.add.at(same, n, np.random.default_rng(0).integers(1 << 63, size=len(self.hubs), dtype=np.uint64)[hub])
        order = np.lexsort((same, hub[first]))
        places = np.empty(len(first), np.int32)
        places[order] = np.arange(len(first))
        n, names = places[n], rows.select(self.columns).take(pa.array(first)).add_column(0, pa.field("n", pa.int32()), pa.array(places))
        ends = np.searchsorted(hub, np.arange(len(self.hubs) + 1))
        return self.named.sparkSession.createDataFrame(names), [n[a:b] for a, b in zip(ends, ends[1:])]

    @cached_property
    def _rows(self) -> DataFrame:
        """``query`` and the columns of a member: the distinct members of sets that are no hubs. ``n`` is the member's
        number if it is in a hub, and the query names any hub, so that it may come from there too."""
        if not self.hubs:
            return self.named.join(self.sets, "node").select("query", *self.columns).distinct().withColumn("n", F.lit(None).cast("int"))
        found = self.named.join(self.sets.join(self._listed, "node", "left_anti"), "node").select("query", *self.columns).distinct()
        either = self.named.join(self._listed, "node").select("query", F.lit(True).alias("either")).distinct()
        found = found.join(either, "query", "left").join(F.broadcast(self._members[0]), self.columns, "left")
        return cut(found.select("query", *self.columns, F.when(F.col("either"), F.col("n")).alias("n")), "single-members")

    def _work(self, blocks: int, length: int) -> DataFrame:
        """``query, block, hubs, at``: the hubs of every query for each block of ``length`` numbers, with what its other
        sets have in the block."""
        none = F.lit(None).cast("int")
        hubs = self.named.join(self._listed, "node").select("query", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "hub", none.alias("at"))
        rest = self._rows.where("n is not null").select("query", (F.col("n") / length).cast("int").alias("block"), none.alias("hub"), (F.col("n") % length).alias("at"))
        return hubs.unionByName(rest).groupBy("query", "block").agg(F.sort_array(F.collect_list("hub")).alias("hubs"), F.collect_list("at").alias("at"))

    def rows(self) -> DataFrame:
        """``query`` and the columns of every member, each once."""
        single = self._rows.where("n is null").select("query", *self.columns)
        if not self.hubs:
            return single
        names, numbers = self._members
        spark = self.named.sparkSession
        shared = spark.sparkContext.broadcast(numbers)
        work = cut(self._work(max(int(x.max()) for x in numbers) // BLOCK + 1, BLOCK), "work")
        tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(self.hubs.values()) // ROWS)), 20_000)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, now, table = shared.value, None, None
            for batch in batches:
                hubs, at = _flat(batch["hubs"]), _flat(batch["at"])
                blocks = batch["block"].to_numpy()
                for block in np.unique(blocks):
                    if block != now:
                        now, table = block, np.zeros((len(numbers), BLOCK), bool)
                        for row, n in zip(table, numbers):
                            row[n[n // BLOCK == block] % BLOCK] = True
                    own = np.flatnonzero(blocks == block)
                    for some in (own[i : i + AT_ONCE] for i in range(0, len(own), AT_ONCE)):
                        bits = np.zeros((len(some), BLOCK), bool)
                        for row, i in zip(bits, some):
                            np.logical_or.reduce(table[hubs(i)], axis=0, out=row)
                            row[at(i)] = True
                        yield from _lists(bits, int(block) * BLOCK, batch["query"].take(pa.array(some)))

        # Queries of the same hubs stand together in a task, so that they share lists.
        found = work.repartitionByRange(tasks, "block", F.xxhash64("query")).sortWithinPartitions("block", "hubs")
        found = found.mapInArrow(run, "n int, queries array<string>").join(F.broadcast(names), "n")
        return single.unionByName(found.select(F.explode("queries").alias("query"), *self.columns))

    def counts(self) -> DataFrame:
        """``query, n``: members of every query that has any. Queries of the same hubs share the union of these."""
        single = self._rows.where("n is null").groupBy("query").agg(F.count(F.lit(1)).alias("n"))
        if not self.hubs:
            return single
        shared = self.named.sparkSession.sparkContext.broadcast(self._members[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, now = shared.value, None
            bits = np.zeros(max(int(x.max()) for x in numbers) + 1, bool)
            for batch in batches:
                hubs, at = _flat(batch["hubs"]), _flat(batch["at"])
                n = np.zeros(batch.num_rows, np.int64)
                for i in range(len(n)):
                    if (key := hubs(i).tobytes()) != now:
                        now, bits[:] = key, False
                        for hub in hubs(i):
                            bits[numbers[hub]] = True
                        total = np.count_nonzero(bits)
                    n[i] = total + np.count_nonzero(~bits[at(i)])
                yield pa.RecordBatch.from_arrays([batch["query"], pa.array(n)], ["query", "n"])

        work = spread(self._work(1, 1 << 30), "hubs").sortWithinPartitions("hubs")
        return single.unionByName(work.mapInArrow(run, "query string, n bigint")).groupBy("query").agg(F.sum("n").alias("n"))
