"""Sets as bits: members are numbered, 64 numbers share a word, and unions are ORs that combine before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.session import cut


def number(values: DataFrame) -> DataFrame:
    """Distinct rows of ``values`` with a number ``n``. Cut, so that the numbers are the same wherever it is read."""
    return cut(values.distinct().withColumn("n", F.monotonically_increasing_id()), "numbers")


def word_and_bit() -> tuple[Column, Column]:
    """Word and bit of the number ``n``."""
    return F.shiftright("n", 6), F.expr("shiftleft(1L, cast(n % 64 as int))")


def pack(rows: DataFrame, numbers: DataFrame, by: str) -> DataFrame:
    """``word, by, bits``: the numbers that stand with every ``by``. Rows without a number drop out."""
    word, bit = word_and_bit()
    on = [c for c in numbers.columns if c != "n"]
    return rows.join(numbers, on).groupBy(word.alias("word"), by).agg(F.bit_or(bit).alias("bits"))


def unpack(words: DataFrame, numbers: DataFrame) -> DataFrame:
    """The other way: one row for every bit, ``word`` and ``bits`` replaced by the columns of ``numbers``."""
    n = F.expr("transform(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1), i -> word * 64 + i)")
    keep = [c for c in words.columns if c not in ("word", "bits")]
    return words.select(*keep, F.explode(n).alias("n")).join(numbers, "n").drop("n")
