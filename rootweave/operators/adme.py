"""ADME filters over ingredients. Metrics are text and cast where they are used; what is no number is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import same_id

# Strict thresholds, and the two profiles of the lenient-on-null check.
STRICT = {
    "ob_score": (">=", 30.0), "drug_likeness": (">=", 0.18), "molwt": ("<=", 500.0), "numhacceptors": ("<=", 10.0),
    "numhdonors": ("<=", 5.0), "mollogp": ("<=", 5.5), "numrotatablebonds": ("<=", 10.0),
}
PROFILES = {"balanced": (30.0, 0.18, 5.5, 1), "lenient": (20.0, 0.1, 6.0, 2)}


def number(c: str) -> Column:
    """The text as a double; null if missing or no plain number."""
    x = F.trim(F.col(c))
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), x).try_cast("double")


def strict_filter(ingredients: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Rows whose seven metrics all lie within the thresholds; a missing metric fails."""
    keep = F.lit(True)
    for c, (op, bound) in (STRICT | (thresholds or {})).items():
        keep = keep & (number(c) >= bound if op == ">=" else number(c) <= bound)
    return ingredients.where(keep)


def profile_check(ingredients: DataFrame, profile: str = "balanced") -> DataFrame:
    """Adds ``violations``, ``fails`` (array, in the order OB, DL, Lipinski) and ``eligible``.

    A missing metric never fails. An unknown profile counts as balanced.
    """
    ob, dl, logp, most = PROFILES.get((profile or "").strip().lower(), PROFILES["balanced"])
    over = lambda c, bound: F.coalesce((number(c) > bound).cast("int"), F.lit(0))
    violations = over("molwt", 500) + over("numhacceptors", 10) + over("numhdonors", 5) + over("mollogp", logp)
    fails = F.array_compact(F.array(
        F.when(number("ob_score") < ob, F.lit(f"OB_score<{ob}")),
        F.when(number("drug_likeness") < dl, F.lit(f"Drug_likeness<{dl}")),
        F.when(F.col("violations") > most, F.lit(f"Lipinski_violations>{most}")),
    ))
    return ingredients.withColumn("violations", violations).withColumn("fails", fails).withColumn("eligible", F.size("fails") == 0)


def gate(checked: DataFrame, query: str) -> DataFrame:
    """Per value of ``query``: are all resolved ingredients eligible? ``n, n_failed, open``."""
    return checked.groupBy(query).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("eligible")).alias("n_failed"), F.bool_and("eligible").alias("open")
    )


def metrics_with_fallback(ids: DataFrame, ingredients: DataFrame, fallback: DataFrame | None) -> DataFrame:
    """Metrics of ``ids.ingredient_id``: from ``ingredients``, else from ``fallback`` for ids without any row there.

    Metric columns that a table lacks are null.
    """
    def pick(df: DataFrame) -> DataFrame:
        there = {c.lower() for c in df.columns}
        return df.select(same_id("ingredient_id").alias("ingredient_id"), *[(F.col(c) if c in there else F.lit(None).cast("string")).alias(c) for c in STRICT])

    wanted = ids.select(same_id("ingredient_id").alias("ingredient_id")).distinct()
    first = wanted.join(pick(ingredients), "ingredient_id")
    if fallback is None:
        return first
    rest = wanted.join(pick(ingredients).select("ingredient_id"), "ingredient_id", "left_anti")
    return first.unionByName(rest.join(pick(fallback), "ingredient_id"))
