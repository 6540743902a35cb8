"""Files of many shapes as tables, and the discovery of kinds, keys and columns. Small decisions (a header, a
file name) are taken on the driver; rows are read by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import gene_core
from rootweave.operators.graph import simple_graph

# Kinds in the order in which a file name is searched for them, separators, and names to look for, each
# in the order in which it is tried.
KIND_ORDER = ("disease", "formula", "ingredient", "target", "herb")
SEPARATORS = (",", "\t", "|", ";")
PREFERRED_TABLE = "STRING_PPI"
PAIR_TABLES = ("Human_PPI", "STRING_PPI", "PPI", "ppi", "edges")
PAIR_COLUMNS = (("protein1", "protein2"), ("node1", "node2"), ("a", "b"), ("source", "target"))
XREF_COLUMNS = {
    "ensg": ("Ensembl Gene ID", "Gene stable ID", "Gene ID", "ensg", "Ensembl_ID", "Ensembl_id"),
    "ensp": ("Ensembl Protein ID", "Protein stable ID", "Protein ID", "ensp"),
    "hgnc_symbol": ("HGNC symbol", "Gene name", "HGNC Symbol", "hgnc_symbol", "Gene", "Symbol"),
    "uniprot": ("UniProtKB/Swiss-Prot ID", "UniProtKB ID", "Uniprot ID", "uniprot", "UniProtKB accession"),
}
_SPACE = r"^[\s ﻿]+|[\s ]+$"


def kind_from_name(name: Column | str) -> Column:
    """Kind of a file by its name, as an expression: the first of ``KIND_ORDER`` that stands as a part between
    non-letters; null if none does."""
    base = F.lower(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"([^/\\]*)$", 1))
    kind = F.lit(None).cast("string")
    for k in reversed(KIND_ORDER):
        kind = F.when(base.rlike(rf"(^|[^a-z]){k}s?([^a-z]|$)"), k).otherwise(kind)
    return kind


def kind_of(name: str) -> str | None:
    """The same for one name, on the driver."""
    base = re.split(r"[/\\]", name)[-1].lower()
    return next((k for k in KIND_ORDER if re.search(rf"(^|[^a-z]){k}s?([^a-z]|$)", base)), None)


def guess_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """A column by candidate names without regard to case: first an equal one, then one that contains a candidate."""
    columns = list(columns)
    by_name = {c.strip().lower(): c for c in reversed(columns)}
    wanted = [c.lower() for c in candidates]
    equal = next((by_name[w] for w in wanted if w in by_name), None)
    return equal or next((c for w in wanted for c in columns if w in c.lower()), None)


def guess_key(columns: Iterable[str], kind: str) -> str | None:
    """The column that holds the records' ids: <kind>_id, else id, else one that ends in _id."""
    columns = list(columns)
    return guess_column([c for c in columns if c.lower() in (f"{kind.lower()}_id", "id")], [f"{kind}_id", "id"]) or next((c for c in columns if c.lower().endswith("_id")), None)


def _lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The words of the header line, and all other lines that aren't blank as ``value``. Spark's CSV reader takes the
    first line of every file off by its position; with a separator that no text holds, a line is one field."""
    df = spark.read.csv(path, header=True, sep="\x01", quote="", escape="\x02", inferSchema=False, encoding="UTF-8")
    if not df.columns:
        raise ValueError(f"{path} has no header")
    return df.columns[0].lstrip("\ufeff").split(), df.toDF("value").where(F.trim("value") != "")


def read_delimited_spaces(spark: SparkSession, path: str) -> DataFrame:
    """A header line and rows whose fields are split by any white space; blank lines are skipped."""
    names, rows = _lines(spark, path)
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return rows.select(parts.alias("p")).select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(names)])


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A delimited file with header: separator from the header line, all strings, trimmed, without repeats.

    '' is null; a BOM is dropped; records of a wrong width keep the fields they have. ``multi_line`` reads line breaks
    within quotes as part of the field; such a file can't be split among tasks.
    """
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head:
        raise ValueError(f"{path} has no header")
    line = head[0]["value"].lstrip("\ufeff")
    sep = max(SEPARATORS, key=line.count)
    if not line.count(sep):
        df = read_delimited_spaces(spark, path)
    else:
        df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="PERMISSIVE", nullValue="", encoding="UTF-8", escape='"', multiLine=multi_line)
        df = df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])
    return df.select(*[F.nullif(F.regexp_replace(f"`{c}`", _SPACE, ""), F.lit("")).alias(c) for c in df.columns]).distinct()


def read_directory(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, include_unknown: bool = False) -> dict[str, DataFrame]:
    """Files by the kind in their names: table name -> union of its files without repeats, missing columns null."""
    groups: dict[str, list[DataFrame]] = {}
    for path in sorted(paths):
        kind = kind_of(path)
        if kind is None and not include_unknown:
            continue
        table = (names or {}).get(kind or "", f"{(kind or 'unknown').capitalize()}_info")
        groups.setdefault(table, []).append(read_delimited(spark, path))
    return {t: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct() for t, parts in groups.items()}


def read_ppi(spark: SparkSession, path: str, cutoff: int = 700) -> DataFrame:
    """A white-space-delimited interaction file with header: rows with a score at or above ``cutoff``."""
    df = read_delimited_spaces(spark, path)
    return df.select("protein1", "protein2", F.col("combined_score").try_cast("int").alias("combined_score")).where(F.col("combined_score") >= cutoff)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge CSV as it is: all strings, repeats kept."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """An edge list (two fields per line, # lines skipped) as a simple graph."""
    p = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return simple_graph(rows.select(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b")))


def read_gmt(spark: SparkSession, path: str, id_kind: str = "ENSG", drop_empty: bool = True) -> DataFrame:
    """``term, gene`` of a GMT file. Lines with fewer than three fields are skipped; of several lines of a term
    the last one that is kept counts. With ``drop_empty=False`` a term without genes has one row with a null gene."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    genes = F.array_distinct(F.filter(F.transform(F.expr("slice(p, 3, size(p))"), lambda g: gene_core(g)), lambda g: F.startswith(g, F.lit(id_kind)) if id_kind else g.isNotNull()))
    kept = lines.select("line", F.get("p", F.lit(0)).alias("term"), genes.alias("genes"))
    kept = kept.where(F.size("genes") > 0) if drop_empty else kept
    last = kept.groupBy("term").agg(F.max_by("genes", "line").alias("genes"))
    return last.select("term", F.explode_outer("genes").alias("gene"))


def term_genes(spark: SparkSession, source) -> DataFrame:
    """``term, gene`` from a GMT path, a dict of sets, or a DataFrame that has these columns."""
    if isinstance(source, DataFrame):
        return source.select("term", "gene")
    if isinstance(source, dict):
        return spark.createDataFrame([(t, g) for t, gs in source.items() for g in sorted(gs)], "term string, gene string")
    return read_gmt(spark, str(source))


def read_xref(spark: SparkSession, path: str) -> DataFrame:
    """A cross-reference file under any known headers as ``ensg, ensp, hgnc_symbol, uniprot`` (the latter two null
    if absent). Clean it with ``resolve.clean_xref``."""
    df = read_delimited(spark, path)
    free, found = list(df.columns), {}
    for k, names in XREF_COLUMNS.items():
        found[k] = guess_column(free, names)
        if found[k]:
            free.remove(found[k])  # 'Gene' is part of 'Gene stable ID' too; a column serves once
    if not found["ensg"] or not found["ensp"]:
        raise ValueError(f"no gene or protein column among {df.columns}")
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])


def scan_pairs(tables: dict[str, DataFrame], preferred: str | None = None, columns: tuple[str, str] | None = None) -> DataFrame:
    """``a, b`` from the first known table with known columns. None known: an error that says what was there."""
    names = {t.lower(): t for t in tables}
    for t in [preferred or PREFERRED_TABLE, *PAIR_TABLES]:
        df = tables.get(names.get(t.lower(), ""))
        if df is None:
            continue
        there = {c.lower(): c for c in df.columns}
        for x, y in [columns or ("", ""), *PAIR_COLUMNS]:
            if x.lower() in there and y.lower() in there:
                return df.select(F.col(there[x.lower()]).alias("a"), F.col(there[y.lower()]).alias("b"))
    raise ValueError(f"no interaction table among {sorted(tables)}")


def has_header(spark: SparkSession, path: str, magic: bytes) -> bool:
    """Whether the file begins with ``magic``."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, len(magic)).alias("head")).first()
    return row is not None and bytes(row["head"]) == magic
