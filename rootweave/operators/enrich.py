"""Over-representation of gene sets in terms: overlaps, hypergeometric tail, false discovery rate, top terms.

All sets and all terms are tested in one plan. A term that shares no gene with a set has p = q = 1; such pairs
are never built, but they count in the number of tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.session import cut, spread


def log_factorial(n: Column) -> Column:
    """ln n! as a built-in expression: Stirling's series, shifted by eight so that it is exact to about 1e-14."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    shift = F.ln(x - 8) + F.ln(x - 7) + F.ln(x - 6) + F.ln(x - 5) + F.ln(x - 4) + F.ln(x - 3) + F.ln(x - 2) + F.ln(x - 1)
    return series - shift


def hypergeom_log_tail(k: str, m: str, n: str, total: str) -> Column:
    """ln P[X >= k] for n draws from ``total`` with m successes. Null (P = 0) where k exceeds n or m; 0 (P = 1) where
    total < n.

    The first term comes from logarithms, each further one from its predecessor by a ratio, so a tail far below the
    least double has its logarithm too.
    """
    K, M, n_, N = (F.col(c).cast("double") for c in (k, m, n, total))
    comb = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    low = F.greatest(K, n_ - (N - M))
    first = comb(M, low) + comb(N - M, n_ - low) - comb(N, n_)
    high = F.least(M, n_)

    def step(acc, i):
        term = acc["term"] * (M - i) * (n_ - i) / ((i + 1) * (N - M - n_ + i + 1))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    rest = F.when(high > low, F.sequence(low.cast("int"), high.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    one = F.lit(1.0)
    times = F.aggregate(rest, F.struct(one.alias("term"), one.alias("total")), step, lambda acc: acc["total"])
    return F.when((K > n_) | (K > M), None).when(N < n_, 0.0).when(K <= 0, 0.0).otherwise(F.least(F.lit(0.0), first + F.ln(times)))


def hypergeom_tail(k: str, m: str, n: str, total: str) -> Column:
    """P[X >= k] itself, see ``hypergeom_log_tail``."""
    return F.coalesce(F.exp(hypergeom_log_tail(k, m, n, total)), F.lit(0.0))


def overlaps(sets: DataFrame, terms: DataFrame, universe: int | None = None) -> DataFrame:
    """``set_id, category, term, k, m, n, total, n_tests`` for every set and term that share a gene.

    ``sets``: ``set_id, gene``; ``terms``: ``category, term, gene``. k shared genes, m genes of the term, n genes
    of the set (also those in no term), total the union of all term genes and the set's own, unless given;
    n_tests the terms of the category. Repeated rows and nulls don't count.
    """
    sets = cut(sets.select("set_id", "gene").where("set_id is not null and gene is not null").distinct(), "sets")
    terms = cut(terms.select("category", "term", "gene").where("term is not null and gene is not null").distinct(), "terms")
    known = terms.select("gene").distinct()
    size = sets.join(known.withColumn("known", F.lit(1)), "gene", "left").groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("outside"))
    term_size = terms.groupBy("category", "term").agg(F.count(F.lit(1)).alias("m"))
    tests = term_size.groupBy("category").agg(F.count(F.lit(1)).alias("n_tests"))
    total = F.lit(universe).cast("bigint") if universe is not None else known.agg(F.count(F.lit(1)).alias("n")).scalar() + F.col("outside")
    k = sets.join(terms, "gene").groupBy("set_id", "category", "term").agg(F.count(F.lit(1)).alias("k"))
    joined = k.join(term_size, ["category", "term"]).join(tests, "category").join(size, "set_id")
    return joined.select("set_id", "category", "term", "k", "m", "n", total.alias("total"), "n_tests")


def enrich(sets: DataFrame, terms: DataFrame, universe: int | None = None) -> DataFrame:
    """``overlaps`` with ``p`` and ``q`` (Benjamini-Hochberg within set and category).

    Few sizes occur beside many pairs, so each tail is summed once per (k, m, n, total) and joined back.
    """
    found, sizes = cut(overlaps(sets, terms, universe), "overlaps"), ["k", "m", "n", "total"]
    tails = spread(found.select(*sizes).distinct(), *sizes).withColumn("log_p", hypergeom_log_tail(*sizes))
    return adjust(found.join(cut(tails, "tails"), sizes).withColumn("p", F.coalesce(F.exp("log_p"), F.lit(0.0))))


#: Below this a p or q value is compared by its logarithm.
TINY = 1e-290


def adjust(tested: DataFrame, by: tuple[str, ...] = ("set_id", "category"), tests: str = "n_tests") -> DataFrame:
    """Adds ``q``: p times tests over rank, made monotone from the largest p down, at most 1; and ``log_q`` if
    ``tested`` has ``log_p`` (natural logarithms, exact where p and q vanish)."""
    logs = "log_p" in tested.columns
    up = Window.partitionBy(*by).orderBy("p", *([F.when(F.col("p") < TINY, F.col("log_p")).asc_nulls_first()] if logs else []), "term")
    down = Window.partitionBy(*by).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tested.withColumn("rank", F.row_number().over(up))
    if logs:
        ranked = ranked.withColumn("log_q", F.least(F.lit(0.0), F.min(F.col("log_p") + F.ln(tests) - F.ln("rank")).over(down)))
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * F.col(tests) / F.col("rank")).over(down))).drop("rank")


def rank_value(c: str, log: str | None = None) -> Column:
    """A p or q value for ranking: its decimal logarithm to six digits, so that the last bits of a sum don't decide.
    With ``log`` (a column of natural logarithms) also where the value itself is too small for a double."""
    x = F.log10(F.greatest(F.col(c), F.lit(1e-300)))
    if log is not None:
        x = F.when((F.col(c) < TINY) & F.col(log).isNotNull(), F.col(log) / F.ln(F.lit(10.0))).otherwise(x)
    return F.round(x, 6)


def top_terms(enriched: DataFrame, top_n: int = 20, q_cut: float = 0.05, by: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """The first ``top_n`` terms with q <= q_cut, per ``by``: adds ``place``. Order: q, p, larger k, category, term."""
    log = lambda c: c if c in enriched.columns else None
    w = Window.partitionBy(*by).orderBy(rank_value("q", log("log_q")), rank_value("p", log("log_p")), F.col("k").desc(), "category", "term")
    return enriched.where(F.round("q", 9) <= q_cut).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_n)
