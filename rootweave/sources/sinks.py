"""Tables and results out: replace, append without known keys, edge files, cache tables, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.operators.edges import merge_edges
from rootweave.session import exists, remove


def replace(df: DataFrame, path: str, original: str | None = None) -> None:
    """The table at ``path`` is ``df`` from now on; the table it was made from is dropped if ``original`` names it."""
    df.write.mode("overwrite").parquet(path)
    if original is not None:
        remove(df.sparkSession, original)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table doesn't hold, one per key; returns what was appended.

    Of several new rows of a key the least one stays. A table that isn't there is made.
    """
    spark = df.sparkSession
    fresh = df.groupBy(*keys).agg(F.min(F.struct(*[c for c in df.columns if c not in keys] or keys)).alias("r")).select(*keys, *[f"r.{c}" for c in df.columns if c not in keys])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (``keys, n``): what a unique index would refuse."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def flush_edges(pairs: DataFrame, path: str) -> None:
    """Add pairs to an edge table: old and new are made canonical and distinct together, written beside the
    table and put in its place by renames, so a reader sees the old or the new table and a failure leaves one."""
    spark = pairs.sparkSession
    parts = [pairs]
    for place in (path, f"{path}.old"):  # .old is left only if a former flush broke between its renames
        if exists(spark, place):
            parts.append(spark.read.parquet(place))
    merge_edges(*parts).write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark.sparkContext._jvm
    p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.delete(p(f"{path}.old"), True)
        fs.rename(p(path), p(f"{path}.old"))
    fs.rename(p(f"{path}.new"), p(path))
    fs.delete(p(f"{path}.old"), True)


def extend_distances(graph: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """A table of distance rows that grows by the sources it lacks; returns the whole table."""
    from rootweave.operators.graph import distances, missing_sources

    spark = graph.sparkSession
    wanted = missing_sources(spark.read.parquet(path), sources) if exists(spark, path) else sources
    distances(graph, wanted).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def to_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, as text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
