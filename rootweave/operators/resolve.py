"""From entities to proteins, many queries in one plan: entity -> edges -> targets -> genes -> proteins.

Every step is an equi join; the "either end" joins are unions of two of them, so none is a nested loop.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import gene_core, same_id, trim_id
from rootweave.operators.unions import Unions
from rootweave.session import cut


def other_ends(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``query, node``: for ``seeds`` (``query, id``) the opposite ends of all their edges (``a, b``).

    A union of two equi joins; where both ends are the seed the edge counts once and leads to itself.
    """
    left = seeds.join(edges.select(F.col("a").alias("id"), F.col("b").alias("node")), "id")
    right = seeds.join(edges.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("node")), "id")
    return left.unionByName(right).select("query", "node").distinct()


def targets_to_genes(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``query, ensg``: nodes that are target ids or gene ids, as genes (version off)."""
    t = targets.select(same_id("target_id").alias("target"), gene_core("ensembl_id").alias("ensg")).where("ensg is not null").distinct()
    by_id = nodes.join(t.select(F.col("target").alias("node"), "ensg"), "node")
    by_gene = nodes.join(t.select(F.col("ensg").alias("node"), "ensg").distinct(), "node")
    return by_id.unionByName(by_gene).select("query", "ensg").distinct()


def genes_to_proteins(genes: DataFrame, xref: DataFrame) -> DataFrame:
    """``query, ensg, ensp`` by the gene; genes without a protein drop out."""
    x = xref.select(gene_core("ensg").alias("ensg"), gene_core("ensp").alias("ensp"))
    x = x.where(F.startswith("ensg", F.lit("ENSG")) & F.startswith("ensp", F.lit("ENSP"))).distinct()
    return genes.join(x, "ensg").select("query", "ensg", "ensp").distinct()


def clean_xref(xref: DataFrame) -> DataFrame:
    """Distinct ``ensg, ensp`` with symbol and UniProt id: capitals, version off, prefixes checked.

    Of several rows of a pair the least non-null symbol and id stay; missing ones ('' and 'nan' too) are null.
    """
    word = lambda c: F.when(~F.lower(trim_id(c)).isin("", "nan"), trim_id(c))
    x = xref.select(gene_core("ensg").alias("ensg"), gene_core("ensp").alias("ensp"), word("hgnc_symbol").alias("hgnc_symbol"), word("uniprot").alias("uniprot"))
    x = x.where(F.startswith("ensg", F.lit("ENSG")) & F.startswith("ensp", F.lit("ENSP")))
    return x.groupBy("ensg", "ensp").agg(F.min("hgnc_symbol").alias("hgnc_symbol"), F.min("uniprot").alias("uniprot"))


def import_counts(xref: DataFrame) -> DataFrame:
    """What an import of cross references keeps: one row of ``n_rows, n_valid, n_unique`` (rows, rows with a gene and a
    protein id, distinct pairs of them)."""
    valid = F.startswith(gene_core("ensg"), F.lit("ENSG")) & F.startswith(gene_core("ensp"), F.lit("ENSP"))
    rows = xref.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(valid, F.lit(False))).alias("n_valid"))
    return rows.withColumn("n_unique", clean_xref(xref).agg(F.count(F.lit(1)).alias("n")).scalar())


def map_ids(ids: DataFrame, column: str, xref: DataFrame | None, source: str, goal: str) -> DataFrame:
    """Distinct pairs ``source, goal`` for the ids in ``column``, with symbol and UniProt id.

    Ids without a partner drop out. Without a cross-reference table (None) every id stands for itself.
    """
    wanted = ids.select(gene_core(column).alias(source)).where(F.col(source).isNotNull()).distinct()
    if xref is None:
        none = F.lit(None).cast("string")
        return wanted.select(source, F.col(source).alias(goal), none.alias("hgnc_symbol"), none.alias("uniprot"))
    return clean_xref(xref).join(wanted, source, "left_semi").select(source, goal, "hgnc_symbol", "uniprot")


def raw_ends(names: DataFrame, edges: DataFrame, label: str | None = None) -> DataFrame:
    """``query, node``: the other ends of raw edges (``node_1, node_2, tp``) that have one of the ``names`` (``query,
    name``) at either end, compared trimmed and in capitals; null ends lead nowhere.

    ``label`` is a LIKE pattern for the edge's type in small letters; a table without ``tp`` isn't filtered by it.
    Where both ends carry names of the query, the second end is the one that comes out.
    """
    if label is not None and "tp" in {c.lower() for c in edges.columns}:
        edges = edges.where(F.lower("tp").like(label))
    ends = edges.select(same_id("node_1").alias("a"), same_id("node_2").alias("b"))
    wanted = names.select("query", same_id("name").alias("name")).where("name is not null").distinct()
    first = wanted.join(ends, wanted["name"] == ends["a"]).select("query", F.col("b").alias("node"))
    second = wanted.join(ends, wanted["name"] == ends["b"]).select("query", "a", "b").join(wanted.withColumnRenamed("name", "a"), ["query", "a"], "left_anti")
    return first.unionByName(second.select("query", F.col("a").alias("node"))).where("node is not null").distinct()


def by_kind(nodes: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """Nodes (``query, node``) of one kind."""
    ids = kinds.where(F.col("kind") == kind).select(F.col("id").alias("node"))
    return nodes.join(ids, "node", "left_semi")


def lookup(table: DataFrame, id_column: str, name_columns: list[str], queries: DataFrame) -> DataFrame:
    """``query, id`` for queries (``query``) that equal the id or any name, trimmed and without regard to case.

    Names become rows, so this is one equi join, however many columns there are.
    """
    names = table.select(
        same_id(id_column).alias("id"),
        F.explode(F.array_distinct(F.array(*[F.lower(trim_id(c)) for c in [id_column, *name_columns]]))).alias("name"),
    ).where("id is not null and name is not null and name <> ''").distinct()
    wanted = queries.select("query", F.lower(trim_id("query")).alias("name")).distinct()
    return wanted.join(names, "name").select("query", "id").distinct()


def lookup_like(table: DataFrame, id_column: str, name_columns: list[str], part: str) -> DataFrame:
    """``query, id`` of the records in which the id or a name contains ``part``; a filter inside the scan."""
    hit = F.lit(False)
    for c in [id_column, *name_columns]:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(part.strip().lower())), F.lit(False))
    return table.where(hit).select(F.lit(part).alias("query"), same_id(id_column).alias("id")).where("id is not null").distinct()


class Resolver:
    """The tables that resolution walks over. ``edges`` are clean edges (``tp, node_1, node_2``).

    What a target or gene id stands for (``node, ensg, ensp``) is worked out once and shared by all paths.
    """

    def __init__(self, edges: DataFrame, kinds: DataFrame, targets: DataFrame, xref: DataFrame):
        self.pairs = edges.select(F.col("node_1").alias("a"), F.col("node_2").alias("b"), "tp")
        self.kinds, self.targets, self.xref = kinds, targets, xref

    @cached_property
    def products(self) -> DataFrame:
        t = self.targets.select(same_id("target_id").alias("node"), gene_core("ensembl_id").alias("ensg")).where("ensg is not null")
        named = t.unionByName(t.select(F.col("ensg").alias("node"), "ensg")).where("node is not null")
        return cut(genes_to_proteins(named.withColumnRenamed("node", "query"), self.xref).withColumnRenamed("query", "node"), "products")

    def _hop(self, seeds: DataFrame, tp: str) -> DataFrame:
        return other_ends(seeds, self.pairs.where(F.col("tp") == tp).select("a", "b"))

    def _proteins(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.products, "node").select("query", "ensg", "ensp").distinct()

    def ingredients(self, seeds: DataFrame) -> DataFrame:
        """Proteins of ingredients: ``query, ensg, ensp`` for ``seeds`` (``query, id``)."""
        return self._proteins(self._hop(seeds, "Ingredient–Target"))

    def herbs(self, seeds: DataFrame, columns: tuple[str, ...] = ("ensg", "ensp")) -> DataFrame:
        """Proteins of herbs, by their ingredients: ``query`` and ``columns``.

        Each ingredient that is reached is resolved once, to a set; a herb's proteins are the union of its
        ingredients' sets (see ``Unions``). Only the columns that are asked for take part.
        """
        drugs = cut(self._hop(seeds, "Herb–Ingredient"), "herb-ingredients")
        found = self.ingredients(drugs.select(F.col("node").alias("query"), F.col("node").alias("id")).distinct())
        return Unions(drugs, cut(found.select(F.col("query").alias("node"), *columns).distinct(), "ingredient-proteins")).rows()

    def diseases(self, seeds: DataFrame) -> DataFrame:
        """Proteins of diseases."""
        return self._proteins(self._hop(seeds, "Target–Disease"))

    def _routed(self, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ids of any of the three kinds, by their prefix, as unions of sets: ``query, node`` with the ingredients and
        diseases that an id stands for, and ``node, ensg, ensp`` with the proteins of these."""
        part = lambda prefix: seeds.where(F.startswith("id", F.lit(prefix)))
        named = lambda df, c, kind: df.select("query", F.concat(F.lit(kind), c).alias("node"))
        drugs = self._hop(part("HERB"), "Herb–Ingredient").select("query", "node").unionByName(part("HBIN").select("query", F.col("id").alias("node")))
        nodes = cut(named(drugs, "node", "I:").unionByName(named(part("HBDIS"), "id", "D:")).distinct(), "routed-nodes")
        sets = []
        for kind, find in (("I:", self.ingredients), ("D:", self.diseases)):
            ids = nodes.where(F.startswith("node", F.lit(kind))).select(F.substring("node", 3, 1 << 30).alias("id")).distinct()
            sets.append(find(ids.select(F.col("id").alias("query"), "id")).select(F.concat(F.lit(kind), "query").alias("node"), "ensg", "ensp"))
        return nodes, cut(sets[0].unionByName(sets[1]), "routed-proteins")

    def stats(self, seeds: DataFrame) -> DataFrame:
        """``resolution_stats`` of ``route`` without its rows, which may be many times the input. A query of one set has its
        size; only those of several are unions."""
        nodes, sets = self._routed(seeds)
        alone = nodes.groupBy("query").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1").select("query", "node")
        several = cut(nodes.join(alone, "query", "left_anti"), "several-nodes")
        sizes = sets.groupBy("node").agg(F.count_distinct("ensg").alias("n_ensg"), F.count_distinct("ensp").alias("n_ensp"))
        named = sets.join(several, "node", "left_semi")
        n = [Unions(several, cut(named.select("node", c).distinct(), f"{c}-sets")).counts().select("query", F.col("n").alias(f"n_{c}")) for c in ("ensg", "ensp")]
        return n[0].join(n[1], "query").unionByName(alone.join(sizes, "node").select("query", "n_ensg", "n_ensp"))

    def route(self, seeds: DataFrame) -> DataFrame:
        """Proteins of ids of any of the three kinds, by their prefix; other ids resolve to nothing."""
        return Unions(*self._routed(seeds)).rows()


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Diagnostics per query: distinct genes and proteins."""
    return resolved.groupBy("query").agg(F.count_distinct("ensg").alias("n_ensg"), F.count_distinct("ensp").alias("n_ensp"))


def diagnostics(r: Resolver, seeds: DataFrame, checked: DataFrame) -> DataFrame:
    """How every ingredient of ``seeds`` (``query, id``) was resolved: ``query, n_targets, n_ensg, n_ensp`` and the rows
    of ``checked`` (``id, eligible``) it has, all and failing; 0 where nothing was found."""
    count = lambda df, **c: df.groupBy("query").agg(*[x.alias(k) for k, x in c.items()])
    targets = count(r._hop(seeds, "Ingredient–Target"), n_targets=F.count(F.lit(1)))
    found = count(r.ingredients(seeds), n_ensg=F.count_distinct("ensg"), n_ensp=F.count_distinct("ensp"))
    rows = count(seeds.join(checked, "id"), n_rows=F.count(F.lit(1)), n_failed=F.count_if(~F.col("eligible")))
    out = seeds.select("query").distinct()
    for part in (targets, found, rows):
        out = out.join(part, "query", "left")
    return out.fillna(0)


def first_by_position(values: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of every key by position, other columns with it; with equal positions the least row."""
    rest = [c for c in values.columns if c != key]
    row = F.struct(F.col(pos), *[F.col(c) for c in rest if c != pos])
    return values.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_first(core: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """``core`` (``key``) with the first ``value`` of ``found``; a key that isn't found maps to itself."""
    first = found.groupBy(key).agg(F.min(value).alias(value))
    return core.select(key).distinct().join(first, key, "left").withColumn(value, F.coalesce(value, key))
