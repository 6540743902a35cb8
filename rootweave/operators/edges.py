"""Typed, canonical edges between herbs, formulas, ingredients, targets and diseases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import canon_pair, same_id
from rootweave.operators.adme import strict_filter

# The kept kind pairs and their labels (with an en dash).
KEPT = [
    ("Formula", "Herb", "Formula–Herb"),
    ("Herb", "Ingredient", "Herb–Ingredient"),
    ("Ingredient", "Target", "Ingredient–Target"),
    ("Target", "Disease", "Target–Disease"),
]
KINDS = ("Herb", "Ingredient", "Target", "Disease", "Formula")


def node_kinds(infos: dict[str, DataFrame]) -> DataFrame:
    """``id, kind`` of every record id; ``infos`` maps a kind to its table, whose id column is <kind>_id.

    An id that stands in two tables has both kinds. Null and blank ids are left out.
    """
    parts = [df.select(same_id(f"{kind.lower()}_id").alias("id"), F.lit(kind).alias("kind")) for kind, df in infos.items()]
    return reduce(DataFrame.unionByName, parts).where("id is not null").distinct()


def plain_edges(edges: DataFrame) -> DataFrame:
    """``a, b``: distinct pairs of ends in comparison form, in binary order. Null ends are dropped, self pairs kept."""
    ends = edges.select(same_id("node_1").alias("x"), same_id("node_2").alias("y")).where("x is not null and y is not null")
    a, b = canon_pair("x", "y")
    return ends.select(a.alias("a"), b.alias("b")).distinct()


def typed_edges(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every distinct edge with the kinds of its ends: ``a, a_kind, b, b_kind``; an unknown end has a null kind.

    Edges are made distinct first, so an end's kind is looked up once per edge and not once per repeat.
    """
    side = lambda s: kinds.select(F.col("id").alias(s), F.col("kind").alias(f"{s}_kind"))
    return plain_edges(edges).join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "a_kind", "b", "b_kind")


def _label(a: Column, b: Column) -> Column:
    label = F.lit(None).cast("string")
    for x, y, name in KEPT:
        label = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), name).otherwise(label)
    return label


def clean_edges(edges: DataFrame, kinds: DataFrame, ingredients: DataFrame | None = None, thresholds: dict | None = None) -> DataFrame:
    """``tp, node_1, node_2``: edges of the four kept kind pairs, canonical, without self pairs and repeats.

    With ``ingredients`` the ingredient of a Herb–Ingredient or Ingredient–Target edge must pass the strict
    ADME filter (semi join); the other two kinds are not filtered.
    """
    t = typed_edges(edges, kinds).where("a <> b").withColumn("tp", _label(F.col("a_kind"), F.col("b_kind"))).where("tp is not null")
    if ingredients is not None:
        ok = strict_filter(ingredients, thresholds).select(same_id("ingredient_id").alias("drug")).distinct()
        t = t.withColumn("drug", F.when(F.col("a_kind") == "Ingredient", F.col("a")).when(F.col("b_kind") == "Ingredient", F.col("b")))
        t = t.where("drug is null").unionByName(t.where("drug is not null").join(ok, "drug", "left_semi").select(*t.columns))
    return t.select("tp", F.col("a").alias("node_1"), F.col("b").alias("node_2")).distinct()


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Edge tables of several runs as one: pairs trimmed, ordered, distinct; self pairs stay. Null ends are dropped."""
    return plain_edges(reduce(DataFrame.unionByName, [p.select("node_1", "node_2") for p in parts])).select(
        F.col("a").alias("node_1"), F.col("b").alias("node_2")
    )
