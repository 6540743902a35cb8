"""References to records that do not exist at their moment.

References are first counted per key and month, combined map-side. The counts name the heavy keys (at most
``HEAVY_PARTS``): their references never shuffle but are checked against a broadcast of these keys' lives. All
others shuffle once, by key, and meet the lives there in an anti-join at their moment; both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.session import cut, utc

#: A key is heavy if it has at least 1/HEAVY_PARTS of all references; so there are at most HEAVY_PARTS.
HEAVY_PARTS = 1000
#: Lives of heavy keys are broadcast up to so many; beyond that the join is left to Spark.
HEAVY_LIVES = 1_000_000
KEY = ["scope", "key"]
FOREVER = "9999-12-31 00:00:00"


def lives(records: DataFrame) -> DataFrame:
    """Lives of every record id: ``scope, key, spans, first_added, known``.

    ``records``: ``scope, key, added_at, deleted_at``, any number of rows per key. ``spans`` are disjoint.
    ``first_added`` is null if a row has no added_at (then no moment is before all rows). Equal starts combine
    map-side; spans that touch are joined by a running maximum of their ends, so the work is linear in the rows.
    """
    stop = F.coalesce("deleted_at", F.lit(FOREVER).cast("timestamp"))
    by_start = (
        records.where(F.col("key").isNotNull())
        .select(*KEY, "added_at", F.when(F.col("added_at") < stop, stop).alias("stop"))
        .groupBy(*KEY, "added_at").agg(F.max("stop").alias("stop"))
    )
    upto = Window.partitionBy(*KEY).orderBy("added_at").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.col("added_at") <= F.col("reach"), F.lit(False))
    numbered = by_start.withColumn("reach", F.max("stop").over(before)).withColumn(
        "span", F.sum((F.col("stop").isNotNull() & ~reached).cast("int")).over(upto)
    )
    spans = numbered.groupBy(*KEY, "span").agg(
        F.min(F.when(F.col("stop").isNotNull(), F.col("added_at"))).alias("start"), F.max("stop").alias("stop"),
        F.min("added_at").alias("first"), F.bool_or(F.col("added_at").isNull()).alias("unknown"),
    )
    return spans.groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("stop").isNotNull(), F.struct("start", "stop"))).alias("spans"),
        F.when(~F.bool_or("unknown"), F.min("first")).alias("first_added"),
        F.lit(True).alias("known"),
    )


def heavy_keys(refs: DataFrame, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``scope, key`` with at least 1/heavy_parts of all references, from counts per key and month.

    Of m months one must hold at least 1/(heavy_parts m) of all references for a heavy key; only such keys, at
    most heavy_parts x m, are summed over their months, so the counts don't shuffle a second time.
    """
    month = (F.year("t") * 12 + F.month("t")).cast("int")
    per = cut(refs.select(*KEY, month.alias("month")).groupBy(*KEY, "month").agg(F.count(F.lit(1)).alias("n")), "reference-counts")
    whole = per.groupBy("month").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("months")).first()
    some = per.where(F.col("n") * (heavy_parts * whole["months"]) >= whole["n"]).select(*KEY).distinct()
    sums = per.join(F.broadcast(some), KEY, "left_semi").groupBy(*KEY).agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") * heavy_parts >= whole["n"]).select(*KEY)


def _reason():
    t = F.col("t")
    alive = F.exists("spans", lambda s: (s["start"] <= t) & (t < s["stop"]))
    return (
        F.when(F.col("known").isNull(), "missing")
        .when(F.coalesce(alive, F.lit(False)), None)
        .when(F.col("first_added") > t, "late")
        .otherwise("deleted")
    )


def orphan_references(refs: DataFrame, records: DataFrame, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """Orphans among ``refs`` (``scope, key, t`` and any columns that name the reference): those columns, plus
    ``reason`` and ``seen_month``. What travels with a reference is what ``refs`` holds, so keep it narrow.

    reason: ``missing`` (no row has the id), ``late`` (all rows were added after the moment), else
    ``deleted``. Null keys are no references. A reference without a moment is never covered by a life, so it
    comes out as ``missing`` or ``deleted`` with a null month. Repeated rows come out repeatedly. Either side
    may be empty.
    """
    refs = refs.where(F.col("key").isNotNull())
    heavy = cut(heavy_keys(refs, heavy_parts), "heavy-keys")
    light_refs = refs.join(F.broadcast(heavy), KEY, "left_anti")
    # Both sides' heavy keys leave before anything shuffles.
    hot = cut(heavy.join(lives(records.join(F.broadcast(heavy), KEY, "left_semi")), KEY, "left"), "heavy-lives")
    few = hot.agg(F.coalesce(F.sum(F.size(F.coalesce("spans", F.array()))), F.lit(0)).alias("n")).first()["n"] <= HEAVY_LIVES
    found_hot = refs.join(F.broadcast(hot) if few else hot, KEY)
    found_light = light_refs.join(lives(records), KEY, "left")
    out = [c for c in refs.columns if c not in (*KEY, "t")]
    shape = lambda df: df.withColumn("reason", _reason()).where("reason is not null").select(*out, "reason", F.date_format(utc("t"), "yyyy-MM").alias("seen_month"))
    return shape(found_hot).unionByName(shape(found_light))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, column, month and reason; combined map-side."""
    return orphans.groupBy("tab_name", "col_name", "seen_month", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
