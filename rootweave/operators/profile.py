"""Column profiles from maintained value-count tables.

A load turns into signed counts ``(tab_name, col_name, value, n)``: +n for cells it brings, -n for cells it takes
back. ``ValueCounts`` is a store that takes one load at a time and keeps, beside the deltas of every load, the
counts of all cells alive after it. All profile metrics (missing share, distinct values, range, entropy,
distribution change) are exact sums over these counts; cells are never read again for them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.session import cut, exists

KEYS = ("tab_name", "col_name", "load_no")


@dataclass(frozen=True)
class ColumnRule:
    """Format (Java regex for the whole value), what the distribution is taken over, and the allowed range."""

    tab_name: str
    col_name: str
    pattern: str
    measure: str = "value"  # or "length"
    low: int | None = None
    high: int | None = None
    distinct_shift: bool = False

    def well_formed(self, value: Column) -> Column:
        return F.coalesce(value.rlike(f"^(?:{self.pattern})\\z"), F.lit(False))

    def number(self, value: Column) -> Column:
        if self.measure == "length":
            return F.length(value).cast("decimal(12,4)")
        return value.try_cast("decimal(12,4)")


@dataclass(frozen=True)
class Limits:
    """Changes between loads that count as findings, as fractions ``1/n``: a change over 1/n is reported."""

    null_rate: int = 10
    shape: int = 5
    distinct: int = 5


def cells(table: DataFrame, rules: list[ColumnRule], row_no: str = "row_no", load_no: str = "load_no") -> DataFrame:
    """One row per profiled cell: ``tab_name, col_name, load_no, row_no, value, formed, x, low, high``.

    ``value`` is null for a missing cell (null or ''), ``formed`` says whether it has the column's format,
    ``x`` is the number whose distribution is compared (null unless formed).
    """
    def cell(r: ColumnRule) -> Column:
        value = F.nullif(F.col(f"`{r.col_name}`"), F.lit(""))
        formed = r.well_formed(value)
        return F.struct(
            F.lit(r.tab_name).alias("tab_name"),
            F.lit(r.col_name).alias("col_name"),
            value.alias("value"),
            formed.alias("formed"),
            F.when(formed, r.number(value)).alias("x"),
            F.lit(r.low).cast("int").alias("low"),
            F.lit(r.high).cast("int").alias("high"),
        )

    return table.select(
        F.col(load_no).cast("bigint").alias("load_no"),
        F.col(row_no).cast("bigint").alias("row_no"),
        F.explode(F.array(*[cell(r) for r in rules])).alias("c"),
    ).select("load_no", "row_no", "c.*")


_COUNTS = "tab_name string, col_name string, value string, formed boolean, x decimal(12,4), n bigint"
VALUE = ["tab_name", "col_name", "value", "formed", "x"]


class ValueCounts:
    """Maintained signed value counts below ``path``: ``deltas`` has what each load changed, ``totals`` the counts of
    the cells alive after each load, one partition per load in either.

    ``apply`` and ``retract`` change one load and carry on its totals and those of the loads after it; a load that
    comes last, the usual case, costs its own delta and one pass over the totals before it, however many loads there
    are. Applying a load again replaces it, so a retried load never counts twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str) -> DataFrame:
        schema = f"{_COUNTS}, load_no bigint"
        place = f"{self.path}/{part}"
        if not exists(self.spark, place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place)

    def loads(self) -> list[int]:
        """The loads in the store, in order."""
        return sorted(r["load_no"] for r in self._read("totals").select("load_no").distinct().collect())

    def deltas(self) -> DataFrame:
        """What every load brought and took back, with ``load_no``."""
        return self._read("deltas").where("tab_name is not null")

    def _write(self, part: str, load_no: int, counts: DataFrame) -> None:
        """A marker row of no column keeps a load whose counts are empty known."""
        mark = self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in _COUNTS.split(", "))])
        counts.select(*VALUE, "n").unionByName(mark).write.mode("overwrite").parquet(f"{self.path}/{part}/load_no={load_no}")

    def apply(self, delta: DataFrame) -> None:
        """Add or replace the loads that occur in ``delta`` (signed counts with ``load_no``), one after the other;
        several rows of a value add up. Other loads' deltas stay as they are."""
        delta = cut(delta.select(*VALUE, "n", "load_no"), "delta", partition_by="load_no").select(*VALUE, "n", "load_no")
        for k in sorted(r["load_no"] for r in delta.select("load_no").distinct().collect()):
            changed = delta.where(F.col("load_no") == k).groupBy(*VALUE).agg(F.sum("n").alias("n")).where("n <> 0")
            self._write("deltas", k, changed)
            self._carry_on(k)

    def retract(self, load_no: int) -> None:
        """Take back a load: what it changed leaves all totals."""
        self._write("deltas", load_no, self.spark.createDataFrame([], _COUNTS))
        self._carry_on(load_no)

    def _carry_on(self, load_no: int) -> None:
        for k in [load_no, *[x for x in self.loads() if x > load_no]]:
            total = self.after(k - 1).select(*VALUE, "n").unionByName(self.deltas().where(F.col("load_no") == k).select(*VALUE, "n"))
            self._write("totals", k, total.groupBy(*VALUE).agg(F.sum("n").alias("n")).where("n <> 0"))

    def after(self, load_no: int) -> DataFrame:
        """Counts of the cells alive after a load: the totals of the last load up to it."""
        upto = [x for x in self.loads() if x <= load_no]
        last = F.lit(False) if not upto else F.col("load_no") == upto[-1]
        return self._read("totals").where(last & F.col("tab_name").isNotNull())

    def states(self, loads: Iterable[int]) -> DataFrame:
        """``after`` for several load numbers in one table; ``load_no`` is the number asked for."""
        known, asked = self.loads(), {}
        for k in loads:
            upto = [x for x in known if x <= k]
            if upto:
                asked.setdefault(upto[-1], []).append(k)
        at = F.lit(None).cast("array<bigint>")
        for x, ks in asked.items():
            at = F.when(F.col("load_no") == x, F.array(*[F.lit(k).cast("bigint") for k in ks])).otherwise(at)
        rows = self._read("totals").where("tab_name is not null")
        return rows.select(*VALUE, "n", F.explode(at).alias("load_no"))


def signed_counts(cell_rows: DataFrame, sign: int = 1) -> DataFrame:
    """Cells of any number of loads as signed counts; combined map-side, so a value that fills a third of
    all cells shuffles as one count per task. Cells without a load have no place in a profile and are left out."""
    return (
        cell_rows.where(F.col("load_no").isNotNull())
        .groupBy("tab_name", "col_name", "load_no", "value", "formed", "x")
        .agg((F.count(F.lit(1)) * sign).alias("n"))
    )


def metrics(counts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exact metrics per column and load from value counts.

    ``cells, missing, malformed, formed, distinct_formed, x_min, x_max, entropy`` (bits, over well-formed
    values; null where there is none).
    """
    n, formed = F.col("n"), F.col("formed")
    some = F.when(formed, n)
    logs = F.sum(F.when(formed, n * F.log2(n.cast("double"))))
    return counts.groupBy(*keys).agg(
        F.sum(n).alias("cells"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~formed & F.col("value").isNotNull(), n)), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum(some), F.lit(0)).alias("formed"),
        F.count(some).alias("distinct_formed"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        (F.log2(F.sum(some).cast("double")) - logs / F.sum(some)).alias("entropy"),
    )


def _apart(a: Column, a_of: Column, b: Column, b_of: Column, parts: int) -> Column:
    """|a/a_of - b/b_of| > 1/parts, in whole numbers."""
    cast = lambda c: c.cast("decimal(18,0)")
    return F.abs(cast(a) * cast(b_of) - cast(b) * cast(a_of)) * parts > cast(a_of) * cast(b_of)


def load_shifts(counts: DataFrame, rules: list[ColumnRule], limits: Limits = Limits()) -> DataFrame:
    """Loads that differ from load_no - 1: ``tab_name, col_name, finding, load_no``.

    Findings ``null_rate``, ``distinct`` (only columns that ask for it) and ``shape`` (largest gap between the
    two cumulative distributions). A load without its predecessor, or without well-formed cells on either
    side, has no such finding. The windows run over one row per column and load, and over the distinct
    numbers of a column's format (at most two million for four decimals), never over cells.
    """
    m = metrics(counts)
    before = Window.partitionBy("tab_name", "col_name").orderBy("load_no")
    m = m.select(
        *KEYS, "cells", "missing", "formed", "distinct_formed",
        *[F.lag(c).over(before).alias(f"p_{c}") for c in ("load_no", "cells", "missing", "formed", "distinct_formed")],
    ).where("p_load_no = load_no - 1")
    asks = [r for r in rules if r.distinct_shift]
    wants = F.struct("tab_name", "col_name").isin([F.struct(F.lit(r.tab_name), F.lit(r.col_name)) for r in asks]) if asks else F.lit(False)
    simple = m.select(
        *KEYS,
        F.explode(F.array_compact(F.array(
            F.when(_apart(F.col("missing"), F.col("cells"), F.col("p_missing"), F.col("p_cells"), limits.null_rate), F.lit("null_rate")),
            F.when(
                wants & (F.col("formed") > 0) & (F.col("p_formed") > 0)
                & _apart(F.col("distinct_formed"), F.col("formed"), F.col("p_distinct_formed"), F.col("p_formed"), limits.distinct),
                F.lit("distinct"),
            ),
        ))).alias("finding"),
    )
    h = counts.where(F.col("x").isNotNull()).groupBy(*KEYS, "x").agg(F.sum("n").alias("n"))
    # Each count enters its own comparison as the later side and the next load's as the earlier side.
    sides = h.select(
        "tab_name", "col_name", "x",
        F.explode(F.array(
            F.struct(F.col("load_no").alias("load_no"), F.col("n").alias("now"), F.lit(0).cast("bigint").alias("was")),
            F.struct((F.col("load_no") + 1).alias("load_no"), F.lit(0).cast("bigint").alias("now"), F.col("n").alias("was")),
        )).alias("s"),
    ).select("tab_name", "col_name", "x", "s.*")
    merged = sides.groupBy(*KEYS, "x").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    whole = Window.partitionBy(*KEYS)
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    shape = (
        merged.select(
            *KEYS,
            F.sum("now").over(upto).alias("now"), F.sum("was").over(upto).alias("was"),
            F.sum("now").over(whole).alias("all_now"), F.sum("was").over(whole).alias("all_was"),
        )
        .where((F.col("all_now") > 0) & (F.col("all_was") > 0))
        .where(_apart(F.col("now"), F.col("all_now"), F.col("was"), F.col("all_was"), limits.shape))
        .select(*KEYS, F.lit("shape").alias("finding")).distinct()
    )
    return simple.unionByName(shape).select("tab_name", "col_name", "finding", "load_no")


def cell_findings(cell_rows: DataFrame) -> DataFrame:
    """``format`` and ``range`` cells: ``tab_name, col_name, finding, row_no``. One scan, no shuffle."""
    x = F.col("x")
    out = (F.col("low").isNotNull() & (x < F.col("low"))) | (F.col("high").isNotNull() & (x > F.col("high")))
    finding = F.when(~F.col("formed") & F.col("value").isNotNull(), "format").when(F.col("formed") & out, "range")
    return cell_rows.select("tab_name", "col_name", finding.alias("finding"), "row_no").where("finding is not null")
