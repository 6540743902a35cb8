"""Shared Enrichment Score of two ranked term lists, by category, combined, and against random sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.operators.enrich import enrich, rank_value
from rootweave.session import cut

# Categories that are left out unless asked for, and the presets; 'all' takes every category.
DENIED = ("PMID", "TISSUES")
PRESETS = {
    "go": ["Process", "Function", "Component"],
    "pathways": ["KEGG", "Reactome", "WikiPathways"],
    "functional": ["Process", "Function", "Component", "KEGG", "Reactome", "WikiPathways"],
    "all": None,
}


def allowed(results: DataFrame, allow: list[str] | None = None, deny: tuple[str, ...] = DENIED) -> DataFrame:
    """Rows of the wanted categories; without ``allow`` all but the denied (compared in capitals). A null category passes only without ``allow``."""
    c = F.upper(F.trim(F.col("category")))
    if allow is not None:
        return results.where(c.isin([x.strip().upper() for x in allow]))
    return results.where(F.coalesce(~c.isin([x.upper() for x in deny]), F.lit(True)))


def joined_ids(sets: DataFrame, separator: str = "\r") -> DataFrame:
    """``set_id, ids``: the distinct ids of a set as one text in order, the form in which a remote provider takes a
    set. A request holds a whole set, so this is for sets that fit one."""
    ids = sets.where("set_id is not null and gene is not null").groupBy("set_id").agg(F.array_sort(F.collect_set("gene")).alias("ids"))
    return ids.select("set_id", F.array_join("ids", separator).alias("ids"))


def term_key(category: str = "category", term_id: str = "term_id", term: str = "term") -> Column:
    """``category:term_id``, or ``category:term`` where the id is missing or blank."""
    name = F.coalesce(F.nullif(F.trim(F.col(term_id)), F.lit("")), F.col(term))
    return F.concat_ws(":", F.coalesce(F.col(category), F.lit("")), name)


def rank_terms(results: DataFrame, by: tuple[str, ...], top_n: int = 20, q_cut: float = 0.05) -> DataFrame:
    """Adds ``place`` to results (``fdr, p_value`` and ``key``): first fdr, then p, then key; fdr <= q_cut.

    A missing fdr counts as p, a missing p too as 1; not-a-number fails.
    """
    r = results.withColumn("fdr", F.coalesce("fdr", "p_value", F.lit(1.0))).where(~F.isnan("fdr") & (F.round("fdr", 9) <= q_cut))
    r = r.withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
    log = lambda c: c if c in r.columns else None
    w = Window.partitionBy(*by).orderBy(rank_value("fdr", log("log_q")), rank_value("p_value", log("log_p")), "key")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_n)


def ses(ranked: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, ses, n_terms`` from ``by, side ('A'/'B'), key, place``.

    The mean over k = 1..N of the Jaccard similarity of both lists' first k terms, N the shorter list. In closed
    form: I(k) shared terms whose worse place is <= k, U(k) = A(k) + B(k) - I(k). A group with an empty side has
    ses 0 and n_terms 0; both lists empty leave no row. Lists are top-N lists, so a group's array stays small.
    """
    first = ranked.groupBy(*by, "key").agg(
        F.min(F.when(F.col("side") == "A", F.col("place"))).alias("a"), F.min(F.when(F.col("side") == "B", F.col("place"))).alias("b")
    )
    ends = ranked.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("side") == "A", F.col("place"))), F.lit(0)).alias("na"),
        F.coalesce(F.max(F.when(F.col("side") == "B", F.col("place"))), F.lit(0)).alias("nb"),
    ).withColumn("n_terms", F.least("na", "nb"))
    places = first.groupBy(*by).agg(F.collect_list(F.struct("a", "b")).alias("p"))
    within = lambda x, k: F.coalesce(x <= k, F.lit(False))
    count = lambda test: F.size(F.filter("p", test)).cast("double")
    jaccard = lambda k: count(lambda t: within(t["a"], k) & within(t["b"], k)) / count(lambda t: within(t["a"], k) | within(t["b"], k))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("n_terms")), jaccard), F.lit(0.0), lambda x, y: x + y)
    score = F.when(F.col("n_terms") > 0, total / F.col("n_terms")).otherwise(0.0)
    return ends.join(places, list(by)).select(*by, score.alias("ses"), "n_terms")


def combine(scores: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Mean of category scores weighted by their list lengths: ``by, ses, n_total``; 0 without any term."""
    return scores.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("ses") * F.col("n_terms")) / F.nullif(F.sum("n_terms"), F.lit(0)), F.lit(0.0)).alias("ses"), F.sum("n_terms").alias("n_total")
    )


def null_summary(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, ses, p_emp, null_mean, null_std, n_null`` from ``by, it, ses`` (it = 0 observed).

    Sample standard deviation (0 for one value); p_emp = (1 + samples at or above) / (1 + samples). Without
    samples p_emp is 1 and mean and deviation are null.
    """
    seen = values.where("it = 0").select(*by, F.col("ses").alias("observed"))
    null = values.where("it > 0").select(*by, "ses")
    joined = seen.join(null, list(by), "left").groupBy(*by, "observed").agg(
        F.count("ses").alias("n_null"), F.count_if(F.round("ses", 9) >= F.round("observed", 9)).alias("above"),
        F.avg("ses").alias("null_mean"), F.stddev_samp("ses").alias("null_std"),
    )
    std = F.when(F.col("n_null") == 1, 0.0).otherwise(F.col("null_std"))
    return joined.select(*by, F.col("observed").alias("ses"), ((F.col("above") + 1) / (F.col("n_null") + 1)).alias("p_emp"), "null_mean", std.alias("null_std"), "n_null")


#: Provider of enrichment results: gene sets (``set_id, gene``) -> ``set_id, category, term_id, term, p_value, fdr``.
Provider = Callable[[DataFrame], DataFrame]


def local_provider(terms: DataFrame) -> Provider:
    """Enrichment against a term table (``category, term, gene``); stands in for a remote service."""
    return lambda sets: enrich(sets, terms).select("set_id", "category", F.col("term").alias("term_id"), "term", F.col("p").alias("p_value"), F.col("q").alias("fdr"), "log_p", "log_q")


def read_results(spark: SparkSession, path: str, form: str = "tsv") -> DataFrame:
    """Results as a remote service delivers them, in tab-separated or JSON-lines files: ``set_id, category, term_id,
    term, p_value, fdr``; columns that aren't there are null, other ones are left out."""
    schema = "set_id string, category string, term_id string, term string, p_value double, fdr double"
    if form == "json":
        return spark.read.schema(schema).json(path)
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    there = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{there[c]}`") if c in there else F.lit(None)).try_cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))])


def given_provider(results: DataFrame) -> Provider:
    """A provider that takes what it gives from a table of results, by ``set_id``."""
    return lambda sets: results.join(sets.select("set_id").distinct(), "set_id", "left_semi")


def _ranked(sets: DataFrame, provider: Provider, by: tuple[str, ...], group: tuple[str, ...], top_n: int, q_cut: float, allow: list[str] | None) -> DataFrame:
    """Top terms of every side within ``group``; all sets go through the provider in one call."""
    key = F.concat_ws("#", *by, "side")
    sets = cut(sets, "gene-sets")
    names = sets.select(key.alias("set_id"), *by, "side").distinct()
    results = allowed(provider(sets.select(key.alias("set_id"), "gene")), allow).join(names, "set_id").withColumn("key", term_key())
    return cut(rank_terms(results, (*group, "side"), top_n, q_cut).select(*group, "side", "key", "place"), "ranked")


def by_category(sets: DataFrame, provider: Provider, by: tuple[str, ...], top_n: int = 20, q_cut: float = 0.05, allow: list[str] | None = None) -> DataFrame:
    """``by, category, ses, n_terms`` of the sets' sides within each category. ``sets``: ``by, side, gene``."""
    group = (*by, "category")
    return ses(_ranked(sets, provider, by, group, top_n, q_cut, allow), group)


def over_all(sets: DataFrame, provider: Provider, by: tuple[str, ...], top_n: int = 20, q_cut: float = 0.05, allow: list[str] | None = None) -> DataFrame:
    """``by, ses, n_terms`` with one ranking over all allowed categories. A pair without any term has no row."""
    return ses(_ranked(sets, provider, by, by, top_n, q_cut, allow), by)
