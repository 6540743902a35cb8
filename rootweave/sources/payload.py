"""Ids inside JSON payloads of unknown shape, and the edges and codes that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import canon_pair, same_id

# The prefixes of ids, and an id in a text, in any spelling.
PREFIXES = ("HBIN", "HBDIS", "HBTAR", "HBCT", "HBMA", "HERB", "HBFO", "HBREF", "HBEXP")
FOUND = rf"(?i)\b(?:{'|'.join(PREFIXES)})[0-9]+\b"


def ids_in(payload: Column | str) -> Column:
    """All ids in a payload, keys and values alike, in capitals, as an array without repeats; null payloads have none."""
    p = F.col(payload) if isinstance(payload, str) else payload
    found = F.regexp_extract_all(F.coalesce(p, F.lit("")), F.lit(FOUND), F.lit(0))
    return F.array_distinct(F.transform(found, F.upper))


def payload_ids(payloads: DataFrame) -> DataFrame:
    """``code, id``: ids of every payload (``code, payload``); the code stays as it was given."""
    return payloads.select("code", F.explode(ids_in("payload")).alias("id")).distinct()


def payload_edges(payloads: DataFrame) -> DataFrame:
    """``node_1, node_2``: distinct canonical pairs of a code and the ids in its payload; a code's own id gives a self pair."""
    ids = payload_ids(payloads).select(same_id("code").alias("c"), F.col("id")).where("c is not null")
    a, b = canon_pair("c", "id")
    return ids.select(a.alias("node_1"), b.alias("node_2")).distinct()


def per_code(payloads: DataFrame) -> DataFrame:
    """``code, n_ids`` for every code, 0 where the payload is missing or holds none."""
    ids = payload_ids(payloads).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return payloads.select("code").where("code is not null").distinct().join(ids, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n_ids"))


def code_range(spark: SparkSession, prefix: str, low: int, high: int) -> DataFrame:
    """Codes ``prefix`` + at least six digits, both ends included; swapped ends are put right."""
    low, high = sorted((low, high))
    return spark.range(low, high + 1).select(F.format_string("%s%06d", F.lit(prefix), F.col("id")).alias("code"))


def code_list(spark: SparkSession, prefix: str, code: str | None = None, codes: list[str] | None = None, codes_file: str | None = None, range_str: str | None = None, code_last: bool = False) -> DataFrame:
    """``part, pos, code`` from single codes, a file (blank and # lines skipped) and a range 'low-high', in this
    order; nothing is made distinct. With ``code_last`` the one ``code`` comes after all others. No code is an error."""
    one = [code] if code else []
    first, last = ([*(codes or [])], one) if code_last else ([*one, *(codes or [])], [])
    given = lambda part, xs: spark.createDataFrame([(part, i, c.strip()) for i, c in enumerate(xs) if c and c.strip()], "part int, pos bigint, code string")
    out = given(0, first)
    if codes_file:
        out = out.unionByName(read_codes(spark, codes_file).select(F.lit(1).alias("part"), "pos", "code"))
    if range_str:
        low, high = (int(x) for x in range_str.split("-", 1))
        out = out.unionByName(code_range(spark, prefix, low, high).select(F.lit(2).alias("part"), F.monotonically_increasing_id().alias("pos"), "code"))
    out = out.unionByName(given(3, last))
    if out.isEmpty():
        raise ValueError("no codes given")
    return out


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """``pos, code`` of a text file, without blank lines and lines that begin with #."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("code"))
    return lines.where(~F.startswith("code", F.lit("#")) & (F.col("code") != ""))
