"""Queries of the network-medicine operators over the project's tables, and the SQL they are held against."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions.ids import ensp_or_null, id_prefix, protein_core, same_id, strip_species, trim_id
from rootweave.operators import adme, edges, enrich, graph, pairs, proximity, resolve, sampling, ses
from rootweave.plans.network_sql import ORACLES  # noqa: F401
from rootweave.session import cut
from rootweave.sources import payload
from rootweave.sources.files import kind_from_name
from rootweave.sources.tables import load

CUTOFF, SEED, SAMPLES = 700, 42, 100

# ---- inputs


class Network:
    """The tables of one query that several of its steps read; each is made once and cut."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def graph(self) -> DataFrame:
        return cut(_graph(self.spark, self.d), "graph")

    @cached_property
    def kinds(self) -> DataFrame:
        return cut(_kinds(self.spark, self.d), "kinds")

    @cached_property
    def xref(self) -> DataFrame:
        return cut(resolve.clean_xref(_xref(self.spark, self.d)), "xref")

    @cached_property
    def resolver(self) -> resolve.Resolver:
        clean = cut(edges.clean_edges(_edges(self.spark, self.d), self.kinds), "clean-edges")
        return resolve.Resolver(clean, self.kinds, load(self.spark, self.d, "target_info", "target_id", "ensembl_id"), self.xref)

    def seeds(self, kind: str) -> DataFrame:
        return self.kinds.where(F.col("kind") == kind).select(F.col("id").alias("query"), "id")

    @cached_property
    def disease_sets(self) -> DataFrame:
        """``set_id, gene``: the genes of every disease."""
        return cut(self.resolver.diseases(self.seeds("Disease")).select(F.col("query").alias("set_id"), F.col("ensg").alias("gene")).distinct(), "disease-sets")

    @cached_property
    def terms(self) -> DataFrame:
        """``category, term, gene``: ingredients with the genes of their targets, and gene symbols by their first two
        and three letters."""
        found = self.resolver.ingredients(self.seeds("Ingredient"))
        drugs = found.select(F.lit("Ingredient").alias("category"), F.col("query").alias("term"), F.col("ensg").alias("gene")).distinct()
        names = self.xref.where("hgnc_symbol is not null").select(
            F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.substring("hgnc_symbol", 1, n).alias("term")) for k, n in (("Symbol", 2), ("Family", 3))])).alias("t"),
            F.col("ensg").alias("gene"),
        )
        return cut(drugs.unionByName(names.select("t.*", "gene").distinct()), "term-genes")

    @cached_property
    def first_pair(self) -> DataFrame:
        """``pair, side, node``: the proteins of the first herb (A) and the first disease (B) that have any in the graph.

        Which records reach the graph is found backward, by distinct nodes per step; only the two that are picked
        are resolved forward.
        """
        r, inside = self.resolver, graph.nodes(self.graph).select(F.col("node").alias("ensp"))
        start = r.products.join(inside, "ensp", "left_semi").select(F.lit("graph").alias("query"), F.col("node").alias("id")).distinct()
        drugs = r._hop(start, "Ingredient–Target").select("query", F.col("node").alias("id"))
        ends = {"A": (r._hop(drugs, "Herb–Ingredient"), "Herb", r.herbs), "B": (r._hop(start, "Target–Disease"), "Disease", r.diseases)}
        sides = []
        for side, (found, kind, forward) in ends.items():
            first = resolve.by_kind(found, self.kinds, kind).agg(F.min("node").alias("id")).select(F.col("id").alias("query"), "id")
            ensp = forward(cut(first, "first")).join(inside, "ensp", "left_semi").select(F.lit("first").alias("pair"), F.lit(side).alias("side"), F.col("ensp").alias("node"))
            sides.append(ensp.distinct())
        return cut(sides[0].unionByName(sides[1]), "first-pair")


def _ppi(spark: SparkSession, d: str) -> DataFrame:
    """Core ids of both ends of every row with a possible score at or above the cutoff."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2", "combined_score").where(F.col("combined_score").between(CUTOFF, 1000))
    return rows.select(protein_core("protein1").alias("a"), protein_core("protein2").alias("b")).where("a is not null and b is not null")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_graph(_ppi(spark, d))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return edges.node_kinds({k: load(spark, d, f"{k.lower()}_info", f"{k.lower()}_id") for k in edges.KINDS})


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "herb_edges", "node_1", "node_2")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return edges.clean_edges(_edges(spark, d), _kinds(spark, d))


def _xref(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ensembl_xref", "ensg", "ensp", "hgnc_symbol", "uniprot")


def _ingredients(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ingredient_info", "row_no", "ingredient_id", *adme.STRICT)


# ---- protein interactions and graph


def ppi_cutoff(spark, d):
    """Rows at or above the score cutoff."""
    return load(spark, d, "human_ppi", "protein1", "protein2", "combined_score").where(F.col("combined_score") >= CUTOFF)


def ppi_strip_prefix(spark, d):
    """Both ends without the species prefix."""
    return load(spark, d, "human_ppi", "protein1", "protein2").select(strip_species("protein1").alias("p1"), strip_species("protein2").alias("p2"))


def ppi_canonical_edges(spark, d):
    """The simple graph of the interactions."""
    return _graph(spark, d)


def node_degree_simple(spark, d):
    """Degrees in the simple graph."""
    return graph.degrees(_graph(spark, d))


def node_degree_multi(spark, d):
    """Degrees over all rows."""
    return graph.degrees(_ppi(spark, d))


def degree_buckets(spark, d):
    """Nodes numbered within their degree."""
    return graph.degree_buckets(graph.degrees(_graph(spark, d)))


def degree_bins(spark, d):
    """Nodes with the quantile bin of their degree."""
    return graph.degree_bins(graph.degrees(_graph(spark, d)))


def background_ppi(spark, d):
    """Distinct proteins at either end of any row."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2").select(F.explode(F.array("protein1", "protein2")).alias("x"))
    return rows.select(ensp_or_null("x").alias("node")).where("node is not null").distinct()


def background_string_ids(spark, d):
    """Distinct ids with species prefix at either end."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2").select(F.explode(F.array("protein1", "protein2")).alias("x"))
    return rows.select(trim_id("x").alias("node")).where(F.startswith("node", F.lit("9606."))).distinct()


def background_xref(spark, d):
    """Distinct proteins of the cross references."""
    return resolve.clean_xref(_xref(spark, d)).select(F.col("ensp").alias("node")).distinct()


def ppi_fallback_scan(spark, d):
    """Ends of the interactions, from whichever known table and column names are there."""
    from rootweave.sources.files import scan_pairs

    df = scan_pairs({"human_ppi": load(spark, d, "human_ppi")})
    return df.select(protein_core("a").alias("a"), protein_core("b").alias("b")).where("a is not null and b is not null").distinct()


# ---- cross references


def xref_import_clean(spark, d):
    return resolve.clean_xref(_xref(spark, d))


def ensg_to_ensp(spark, d):
    """Proteins of the genes that targets name."""
    return resolve.map_ids(load(spark, d, "target_info", "ensembl_id"), "ensembl_id", _xref(spark, d), "ensg", "ensp")


def ensp_to_ensg(spark, d):
    """Genes of the proteins at the first end of the interactions."""
    ids = load(spark, d, "human_ppi", "protein1").select(protein_core("protein1").alias("p"))
    return resolve.map_ids(ids, "p", _xref(spark, d), "ensp", "ensg")


# ---- typed edges and ADME


def edge_typed(spark, d):
    return edges.typed_edges(_edges(spark, d), _kinds(spark, d))


def edges_clean(spark, d):
    return _clean(spark, d)


def edges_clean_adme(spark, d):
    return edges.clean_edges(_edges(spark, d), _kinds(spark, d), _ingredients(spark, d))


def edge_type_counts(spark, d):
    """Clean edges per kind pair."""
    return _clean(spark, d).groupBy("tp").agg(F.count(F.lit(1)).alias("n_edges"))


def adme_strict(spark, d):
    return adme.strict_filter(_ingredients(spark, d)).select("row_no", same_id("ingredient_id").alias("ingredient_id"))


def _checked(spark, d, profile):
    out = adme.profile_check(_ingredients(spark, d), profile)
    return out.select("row_no", "violations", F.concat_ws(";", "fails").alias("fails"), "eligible")


def adme_profile_balanced(spark, d):
    return _checked(spark, d, "balanced")


def adme_profile_lenient(spark, d):
    return _checked(spark, d, "lenient")


def _herb_drugs(spark, d) -> DataFrame:
    """``query, id``: herbs with their ingredients."""
    n = Network(spark, d)
    return n.resolver._hop(n.seeds("Herb"), "Herb–Ingredient").select("query", F.col("node").alias("id"))


def adme_gate(spark, d):
    """Per herb: rows of its ingredients, how many fail the balanced profile, and whether all pass."""
    checked = adme.profile_check(_ingredients(spark, d)).select(same_id("ingredient_id").alias("id"), "eligible")
    return adme.gate(_herb_drugs(spark, d).join(checked, "id"), "query")


# ---- resolution


def resolve_herb(spark, d):
    """Proteins of every herb."""
    n = Network(spark, d)
    return n.resolver.herbs(n.seeds("Herb"), ("ensp",))


def resolve_ingredient(spark, d):
    """Proteins of every ingredient."""
    n = Network(spark, d)
    return n.resolver.ingredients(n.seeds("Ingredient")).select("query", "ensp").distinct()


def resolve_disease(spark, d):
    """Proteins of every disease."""
    n = Network(spark, d)
    return n.resolver.diseases(n.seeds("Disease")).select("query", "ensp").distinct()


HERB_NAMES = ["herb_pinyin_name", "herb_cn_name", "herb_alias_name", "herb_en_name", "herb_latin_name"]


def resolve_herb_name(spark, d):
    """Proteins of every Latin herb name, found by exact name."""
    table = load(spark, d, "herb_info", "herb_id", *HERB_NAMES)
    names = table.select(F.col("herb_latin_name").alias("query")).where("query is not null and query <> ''").distinct()
    return Network(spark, d).resolver.herbs(resolve.lookup(table, "herb_id", HERB_NAMES, names), ("ensp",))


def resolve_ingredient_like(spark, d):
    """Proteins of the ingredients whose id or a name contains 'quito'."""
    table = load(spark, d, "ingredient_info", "ingredient_id", "ingredient_name", "ingredient_alias_name")
    seeds = resolve.lookup_like(table, "ingredient_id", ["ingredient_name", "ingredient_alias_name"], "quito")
    return Network(spark, d).resolver.ingredients(seeds).select("query", "ensp").distinct()


def resolve_disease_name(spark, d):
    """Proteins of every DisGeNET id."""
    table = load(spark, d, "disease_info", "disease_id", "disgenet_id")
    names = table.select(F.col("disgenet_id").alias("query")).where("query is not null and query <> ''").distinct()
    return Network(spark, d).resolver.diseases(resolve.lookup(table, "disease_id", ["disgenet_id"], names)).select("query", "ensp").distinct()


def resolve_gated(spark, d):
    """Proteins of the ingredients whose rows all pass the lenient profile."""
    checked = adme.profile_check(_ingredients(spark, d), "lenient").select(same_id("ingredient_id").alias("query"), "eligible").where("query is not null")
    open_ = adme.gate(checked, "query").where("open").select("query")
    n = Network(spark, d)
    return n.resolver.ingredients(n.seeds("Ingredient").join(open_, "query", "left_semi")).select("query", "ensp").distinct()


def resolve_router(spark, d):
    """Genes and proteins of every record id, routed by its prefix."""
    n = Network(spark, d)
    return n.resolver.route(n.kinds.select(F.col("id").alias("query"), "id").distinct())


def resolve_diagnostics(spark, d):
    """How every ingredient was resolved, with its rows in the balanced profile."""
    n = Network(spark, d)
    checked = adme.profile_check(_ingredients(spark, d)).select(same_id("ingredient_id").alias("id"), "eligible")
    return resolve.diagnostics(n.resolver, n.seeds("Ingredient"), checked)


def xref_import_counts(spark, d):
    """Rows, valid rows and distinct pairs of the cross references."""
    return resolve.import_counts(_xref(spark, d))


def id_prefix_counts(spark, d):
    """Edge ends by the prefix of their id."""
    ends = _edges(spark, d).select(F.explode(F.array("node_1", "node_2")).alias("x"))
    return ends.groupBy(id_prefix("x", payload.PREFIXES).alias("prefix")).agg(F.count(F.lit(1)).alias("n_ends"))


def resolve_raw(spark, d):
    """Targets of every ingredient, found by its id or any of its names at raw edges whose type names both kinds."""
    table = load(spark, d, "ingredient_info", "ingredient_id", "ingredient_name", "ingredient_alias_name")
    names = table.select(same_id("ingredient_id").alias("query"), F.explode(F.array("ingredient_id", "ingredient_name", "ingredient_alias_name")).alias("name"))
    return resolve.raw_ends(names.where("query is not null"), load(spark, d, "herb_edges", "node_1", "node_2", "tp"), "%ingredient%target%")


def resolve_raw_disease(spark, d):
    """Other ends of every disease's raw edges, whatever their type."""
    ids = load(spark, d, "disease_info", "disease_id").select(same_id("disease_id").alias("query"), F.col("disease_id").alias("name"))
    return resolve.raw_ends(ids.where("query is not null"), load(spark, d, "herb_edges", "node_1", "node_2"))


def ensg_passed_through(spark, d):
    """The genes that targets name, mapped without a cross-reference table: each stands for itself."""
    return resolve.map_ids(load(spark, d, "target_info", "ensembl_id"), "ensembl_id", None, "ensg", "ensp")


def core_to_string_ids(spark, d):
    """Every protein of the interactions with the first of its ids with species, or itself where it has none."""
    ends = load(spark, d, "human_ppi", "protein1", "protein2").select(F.explode(F.array("protein1", "protein2")).alias("x"))
    ids = ends.select(protein_core("x").alias("core"), trim_id("x").alias("string_id")).where("core is not null")
    return resolve.merge_first(ids, ids.where(F.startswith("string_id", F.lit("9606."))), "core", "string_id")


def first_names(spark, d):
    """The first row of every ingredient id in the order of row_no, with its name."""
    rows = load(spark, d, "ingredient_info", "ingredient_id", "row_no", "ingredient_name")
    return resolve.first_by_position(rows.select(same_id("ingredient_id").alias("ingredient_id"), "row_no", "ingredient_name"), "ingredient_id", "row_no")


def resolve_stats(spark, d):
    """Distinct genes and proteins per resolved id."""
    n = Network(spark, d)
    return n.resolver.stats(n.kinds.select(F.col("id").alias("query"), "id").distinct())


def adme_fallback(spark, d):
    """Metrics of all edge ends that are ingredients: from Ingredient_info, else from the delivered lines."""
    from rootweave.functions.problems import INGREDIENT_FIELDS
    from rootweave.sources.rejects import load_valid

    ends = _edges(spark, d).select(F.explode(F.array(same_id("node_1"), same_id("node_2"))).alias("ingredient_id")).where("ingredient_id like 'HBIN%'").distinct()
    raw = load_valid(load(spark, d, "ingredient_raw", "line_no", "raw_line"), INGREDIENT_FIELDS, {})
    return adme.metrics_with_fallback(ends, _ingredients(spark, d), raw)


# ---- distances


def bfs_single_source(spark, d):
    """Distances from the least protein of the graph."""
    g = Network(spark, d).graph
    first = graph.nodes(g).agg(F.min("node").alias("node"))
    return graph.distances(g, first)


def bfs_set(spark, d):
    """Distance of every protein to the nearest of the first disease's."""
    n = Network(spark, d)
    seeds = n.first_pair.where("side = 'B'").select(F.lit("B").alias("key"), "node")
    return graph.bfs(graph.neighbours(n.graph), seeds).select("node", "d")


def _formula_distances(spark, d):
    g = graph.simple_graph(_clean(spark, d), "node_1", "node_2")
    return graph.distances(g, _kinds(spark, d).where("kind = 'Formula'").select(F.col("id").alias("node")))


def distance_rows(spark, d):
    """Distances from every formula over the clean edges."""
    return _formula_distances(spark, d)


def pair_distances(spark, d):
    """Distances between all formulas and diseases."""
    pick = lambda kind: _kinds(spark, d).where(F.col("kind") == kind).select(F.col("id").alias("node"))
    return graph.pair_table(_formula_distances(spark, d), pick("Formula"), pick("Disease"))


def distance_lookup(spark, d):
    """Distance of every formula to the next one in order; infinity where there is no path."""
    w = Window.partitionBy("kind").orderBy("id")  # formulas and diseases are tables of fixed size
    ids = _kinds(spark, d).where("kind = 'Formula'").withColumn("y", F.lead("id").over(w)).where("y is not null")
    found = graph.look_up(_formula_distances(spark, d), ids.select(F.col("id").alias("x"), "y"))
    return found.withColumn("d", F.when(F.col("d") < float("inf"), F.col("d").cast("int")))


def set_distances(spark, d):
    """closest, separation, shortest and the directed means of the first herb and the first disease."""
    n = Network(spark, d)
    g, sets = n.graph, n.first_pair
    a, b = (sets.where(F.col("side") == s).select("node") for s in "AB")
    out = pairs.set_distances(g, a, b)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.round(c, 8)).alias(c)
    return out.select(*[finite(c) for c in out.columns])


def degree_matched_sample(spark, d):
    """The degree-matched draws of the flagship pair."""
    n = Network(spark, d)
    return proximity.samples(n.graph, n.first_pair, SAMPLES, SEED)


def proximity_null(spark, d):
    """Directed distance of the flagship pair and of each of its samples."""
    n = Network(spark, d)
    out = proximity.closest_directed(n.graph, proximity.samples(n.graph, n.first_pair, SAMPLES, SEED))
    return out.select("pair", "it", F.round("d", 8).alias("d"))


def proximity_z(spark, d):
    """Flagship: proximity of a herb and a disease with its degree-matched z-score and p."""
    n = Network(spark, d)
    out = proximity.proximity(n.graph, n.first_pair, SAMPLES, SEED)
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("d", "z", "mean", "std", "p")], "n")


def proximity_mean_z(spark, d):
    """The flagship pair by the mean over all pairs of proteins, with its degree-matched z-score and p."""
    n = Network(spark, d)
    out = proximity.proximity(n.graph, n.first_pair, 10, SEED, "mean_all_pairs")
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("d", "z", "mean", "std", "p")], "n")


def proximity_many(spark, d):
    """Proximity of every disease with the next one in id order, all pairs in one plan, three draws each."""
    n = Network(spark, d)
    w = Window.partitionBy(F.lit(1)).orderBy("query")  # over the ids of a table of fixed size
    found = cut(n.resolver.diseases(n.seeds("Disease")).select("query", F.col("ensp").alias("node")).distinct(), "disease-proteins")
    ids = found.select("query").distinct().withColumn("other", F.lead("query").over(w)).where("other is not null")
    pair = F.concat_ws("~", "query", "other").alias("pair")
    a = found.join(ids, "query").select(pair, F.lit("A").alias("side"), "node")
    b = found.withColumnRenamed("query", "other").join(ids, "other").select(pair, F.lit("B").alias("side"), "node")
    out = proximity.proximity(n.graph, a.unionByName(b), 3, SEED)
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("d", "z", "mean", "std", "p")], "n")


# ---- enrichment


def _log(c: str):
    return F.round(F.log10(F.greatest(F.col(c), F.lit(1e-300))), 4).alias(f"log_{c}")


def ora_counts(spark, d):
    """Overlap of every disease's genes with every term."""
    n = Network(spark, d)
    return enrich.overlaps(n.disease_sets, n.terms)


def ora_enrich(spark, d):
    """Hypergeometric p and BH q of the same, as logarithms."""
    n = Network(spark, d)
    out = enrich.enrich(n.disease_sets, n.terms)
    return out.select("set_id", "category", "term", "k", _log("p"), _log("q"))


def ora_top_terms(spark, d):
    """Top 20 terms per disease and category with q <= 0.05."""
    n = Network(spark, d)
    out = enrich.top_terms(enrich.enrich(n.disease_sets, n.terms), by=("set_id", "category"))
    return out.select("set_id", "category", "term", "place")


def _neighbour_pairs(n: Network) -> DataFrame:
    """``pair, side, gene``: each disease (A) with the next one in id order (B)."""
    sets = n.disease_sets
    w = Window.partitionBy(F.lit(1)).orderBy("set_id")  # over the ids of a table of fixed size
    ids = sets.select("set_id").distinct().withColumn("other", F.lead("set_id").over(w)).where("other is not null")
    a = sets.join(ids, "set_id").select(F.concat_ws("~", "set_id", "other").alias("pair"), F.lit("A").alias("side"), "gene")
    b = sets.withColumnRenamed("set_id", "other").join(ids, "other").select(F.concat_ws("~", "set_id", "other").alias("pair"), F.lit("B").alias("side"), "gene")
    return a.unionByName(b)


def _pair_scores(spark, d) -> DataFrame:
    n = Network(spark, d)
    return ses.by_category(_neighbour_pairs(n), ses.local_provider(n.terms), ("pair",), q_cut=1.0)


def ses_by_category(spark, d):
    """SES of neighbouring diseases per category."""
    return _pair_scores(spark, d).select("pair", "category", F.round("ses", 8).alias("ses"), "n_terms")


def ses_pair(spark, d):
    """SES of neighbouring diseases over one ranking of all categories."""
    n = Network(spark, d)
    out = ses.over_all(_neighbour_pairs(n), ses.local_provider(n.terms), ("pair",), q_cut=1.0)
    return out.select("pair", F.round("ses", 8).alias("ses"), "n_terms")


def ses_weighted(spark, d):
    """SES of neighbouring diseases, categories weighted by their list lengths."""
    out = ses.combine(_pair_scores(spark, d), ("pair",))
    return out.select("pair", F.round("ses", 8).alias("ses"), "n_total")


def term_rank_fdr(spark, d):
    """Ranked terms of every disease over all allowed categories."""
    n = Network(spark, d)
    results = ses.allowed(ses.local_provider(n.terms)(n.disease_sets), deny=("PMID", "TISSUES", "Symbol"))
    out = ses.rank_terms(results.withColumn("key", ses.term_key()), ("set_id",), top_n=10, q_cut=1.0)
    return out.select("set_id", "key", "place")


def uniform_sample(spark, d):
    """Ten draws of as many graph proteins as the flagship sets have."""
    n = Network(spark, d)
    sizes = {r["side"]: r["n"] for r in n.first_pair.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sampling.uniform(graph.nodes(n.graph), sizes, 10, SEED)


def binned_sample(spark, d):
    """Ten draws matched by degree bin."""
    n = Network(spark, d)
    bins = graph.degree_bins(graph.degrees(n.graph))
    targets = n.first_pair.join(bins, "node").select("side", "node", "bin")
    return sampling.bin_matched(targets, bins, 10, SEED)


def background(n: Network, source: str) -> DataFrame:
    """``node``: the proteins that random sets are drawn from: all of the interactions ('ppi') or of the cross
    references ('xref')."""
    if source == "xref":
        return n.xref.select(F.col("ensp").alias("node")).distinct()
    return cut(background_ppi(n.spark, n.d), "background")


def random_sets(n: Network, sets: DataFrame, nodes: DataFrame, n_iter: int, seed: int, matched: bool) -> DataFrame:
    """``side, it, node``: random sets as large as ``sets`` (``side, node``); ``matched`` draws them by the bins of
    their degrees in the interactions, a node without any having degree 0."""
    if not matched:
        sizes = {r["side"]: r["n"] for r in sets.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        return sampling.uniform(nodes, sizes, n_iter, seed)
    degree = graph.degrees(_all_pairs(n.spark, n.d))
    known = cut(nodes.join(degree, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")), "background-degrees")
    bins, edges_ = graph.degree_bins(known), graph.bin_edges(known)
    below = sum(((F.lit(e) < F.coalesce("degree", F.lit(0))).cast("int") for e in edges_), F.lit(0))
    targets = sets.join(degree, "node", "left").select("side", "node", below.alias("bin"))
    return sampling.bin_matched(targets, bins, n_iter, seed)


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ends of all interaction rows in the form of background sets; rows with an end that is no protein are left out."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2").select(ensp_or_null("protein1").alias("a"), ensp_or_null("protein2").alias("b"))
    return rows.where("a is not null and b is not null")


def set_scores(n: Network, sets: DataFrame, drawn: DataFrame | None = None, top_n: int = 20, q_cut: float = 0.05, allow: list[str] | None = None) -> DataFrame:
    """``it, category, ses, n_terms`` of protein sets (``side, node``; it 0) and of random ones (``side, it, node``),
    all of them mapped to genes first."""
    both = sets.select("side", F.lit(0).alias("it"), "node")
    both = both if drawn is None else both.unionByName(drawn.select("side", "it", "node"))
    genes = n.xref.select(F.col("ensp").alias("node"), F.col("ensg").alias("gene"))
    mapped = both.join(genes, "node").select("side", "it", "gene").distinct()
    return ses.by_category(mapped, ses.local_provider(n.terms), ("it",), top_n, q_cut, allow)


NULL_DRAWS = 100


def _first_diseases(n: Network) -> DataFrame:
    """``side, gene``: the first two neighbouring diseases."""
    sets = cut(_neighbour_pairs(n), "pairs")
    return sets.where(F.col("pair") == sets.agg(F.min("pair").alias("p")).scalar()).select("side", "gene")


def _null_scores(spark, d, n_iter=NULL_DRAWS) -> DataFrame:
    """``it, category, ses, n_terms``: the first two diseases (it 0) and uniform draws of as many genes."""
    n = Network(spark, d)
    first = cut(_first_diseases(n), "first-pair")
    sizes = {r["side"]: r["n"] for r in first.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    genes = n.xref.select(F.col("ensg").alias("node")).distinct()
    drawn = sampling.uniform(genes, sizes, n_iter, SEED).withColumnRenamed("node", "gene")
    both = first.select("side", F.lit(0).alias("it"), "gene").unionByName(drawn)
    return ses.by_category(both, ses.local_provider(n.terms), ("it",), q_cut=1.0)


def _null_report(values: DataFrame, by: str) -> DataFrame:
    out = ses.null_summary(values, (by,))
    return out.select(by, *[F.round(c, 8).alias(c) for c in ("ses", "p_emp", "null_mean", "null_std")], "n_null")


def ses_null(spark, d):
    """Combined SES of the first two diseases against random gene sets."""
    return _null_report(ses.combine(cut(_null_scores(spark, d), "null-scores"), ("it",)).withColumn("pair", F.lit("first")), "pair")


def ses_null_by_category(spark, d):
    """The same per category."""
    return _null_report(cut(_null_scores(spark, d), "null-scores"), "category")


def _first_disease_proteins(n: Network) -> DataFrame:
    """``side, node``: all proteins of the first two diseases that have any."""
    ids = cut(n.disease_sets.select("set_id").distinct().orderBy("set_id").limit(2), "first-diseases")
    side = F.when(F.col("set_id") == ids.agg(F.min("set_id").alias("s")).scalar(), "A").otherwise("B")
    found = n.resolver.diseases(ids.select(F.col("set_id").alias("query"), F.col("set_id").alias("id")))
    return cut(found.select(F.col("query").alias("set_id"), F.col("ensp").alias("node")).distinct().select(side.alias("side"), "node"), "first-proteins")


def ses_ensp(spark, d):
    """SES per category of the first two diseases, given as protein lists that are mapped to genes first."""
    n = Network(spark, d)
    return set_scores(n, _first_disease_proteins(n), q_cut=1.0).select("category", F.round("ses", 8).alias("ses"), "n_terms")


def ses_null_matched_sets(spark, d):
    """The degree-matched random protein sets of the first two diseases, drawn from all interactions."""
    n = Network(spark, d)
    return random_sets(n, _first_disease_proteins(n), background(n, "ppi"), NULL_DRAWS, SEED, True)


def ses_null_matched(spark, d):
    """SES per category of the first two diseases' proteins against degree-matched random protein sets."""
    n = Network(spark, d)
    sets = _first_disease_proteins(n)
    drawn = random_sets(n, sets, background(n, "ppi"), NULL_DRAWS, SEED, True)
    return _null_report(cut(set_scores(n, sets, drawn, q_cut=1.0), "null-scores"), "category")


def set_texts(spark, d):
    """Every disease's genes as one text, as a remote provider takes them."""
    return ses.joined_ids(Network(spark, d).disease_sets, ",")


# ---- payloads, codes, tables


def _payloads(spark, d) -> DataFrame:
    """One JSON payload per edge row, with the other end as a key and its kind in the value."""
    rows = load(spark, d, "herb_edges", "node_1", "node_2", "tp").where("node_1 is not null and node_2 is not null")
    text = F.concat(F.lit('{"items":[{"'), "node_2", F.lit('":"'), F.coalesce("tp", F.lit("none")), F.lit(' of '), "node_1", F.lit('"}]}'))
    return rows.select(F.col("node_1").alias("code"), text.alias("payload"))


def payload_id_extract(spark, d):
    """Kept ids in every payload."""
    return payload.payload_ids(_payloads(spark, d))


def payload_edges(spark, d):
    """Edges of the payloads' codes and ids."""
    return payload.payload_edges(_payloads(spark, d))


def payload_counts(spark, d):
    """Ids per code."""
    return payload.per_code(_payloads(spark, d))


def edge_merge(spark, d):
    """Payload edges and table edges as one."""
    return edges.merge_edges(payload_edges(spark, d), _edges(spark, d))


def code_gaps(spark, d):
    """Herb codes within the range of Herb_info that no row has. Numbers that a bigint can't hold are an error, as the range would end before them."""
    ids = load(spark, d, "herb_info", "herb_id").select(same_id("herb_id").alias("code")).where(F.col("code").rlike(r"^HERB[0-9]{6,}\z")).distinct()
    number = F.substring("code", 5, 1 << 30).try_cast("bigint")
    ends = ids.agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.min(F.when(number.isNull(), F.col("code"))).alias("long"), F.count_if(number.isNull()).alias("n")).first()
    if ends["n"]:
        raise ValueError(f"{ends['n']} herb ids are longer than a bigint, the first is {ends['long']}")
    return payload.code_range(spark, "HERB", ends["lo"], ends["hi"]).join(ids, "code", "left_anti")


def kind_of_files(spark, d):
    """Delivered files with the kind their name tells, and their lines."""
    files = load(spark, d, "ingredient_raw", "file_name").groupBy("file_name").agg(F.count(F.lit(1)).alias("n_lines"))
    return files.withColumn("kind", kind_from_name("file_name"))


def infos_union(spark, d):
    """All info tables as one, missing columns null: ids and names per kind, without repeats."""
    names = {"Herb": "herb_en_name", "Ingredient": "ingredient_name", "Disease": "disgenet_id", "Target": "ensembl_id"}
    out = None
    for kind in edges.KINDS:
        extra = [names[kind]] if kind in names else []
        df = load(spark, d, f"{kind.lower()}_info", f"{kind.lower()}_id", *extra)
        df = df.select(F.lit(kind).alias("kind"), same_id(f"{kind.lower()}_id").alias("id"), *[F.col(c).alias("name") for c in extra]).distinct()
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def table_counts(spark, d):
    """Rows per table."""
    tables = ["human_ppi", "herb_edges", "ensembl_xref", *[f"{k.lower()}_info" for k in edges.KINDS]]
    out = None
    for t in tables:
        n = load(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("tab_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out



QUERIES = {
    f.__name__: f
    for f in (
        proximity_z, proximity_null, degree_matched_sample, ppi_cutoff, ppi_strip_prefix, ppi_canonical_edges, node_degree_simple, node_degree_multi,
        degree_buckets, degree_bins, background_ppi, background_string_ids, background_xref, ppi_fallback_scan, xref_import_clean, ensg_to_ensp, ensp_to_ensg,
        edge_typed, edges_clean, edges_clean_adme, edge_type_counts, adme_strict, adme_profile_balanced, adme_profile_lenient, adme_gate, adme_fallback,
        resolve_herb, resolve_ingredient, resolve_disease, resolve_herb_name, resolve_ingredient_like, resolve_disease_name, resolve_gated, resolve_router,
        resolve_diagnostics, xref_import_counts, id_prefix_counts, resolve_raw, resolve_raw_disease, ensg_passed_through, core_to_string_ids, first_names, proximity_mean_z, proximity_many,
        ses_ensp, ses_null_matched_sets, ses_null_matched, set_texts, resolve_stats, bfs_single_source, bfs_set, distance_rows, pair_distances, distance_lookup, set_distances, ora_counts, ora_enrich, ora_top_terms,
        term_rank_fdr, ses_pair, ses_by_category, ses_weighted, uniform_sample, binned_sample, ses_null, ses_null_by_category, payload_id_extract, payload_edges,
        payload_counts, edge_merge, code_gaps, kind_of_files, infos_union, table_counts,
    )
}
