"""Queries that write the given tables in the formats the readers and sinks know and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import cut_version, protein_core, same_id, trim_id
from rootweave.operators import edges, graph, resolve, ses
from rootweave.plans.network import Network, _neighbour_pairs, _edges, _graph, _kinds, _payloads, _xref
from rootweave.plans.network_sql import FORMULA, KINDS, PPI, TRIM, XREF, id_sql
from rootweave.plans.network_sql import ORACLES as NETWORK_SQL
from rootweave.plans.quality import core_sql
from rootweave.session import cut, new_place
from rootweave.sources import files, payload, sinks
from rootweave.sources.tables import load
from rootweave.streaming.edges import grow_edges, payload_stream

NAMES = ["herb_id", "herb_pinyin_name", "herb_cn_name", "herb_alias_name", "herb_en_name", "herb_latin_name"]


def _text(lines: DataFrame, name: str, head: str | None = None) -> str:
    """A folder of text files of ``lines.value``; every file begins with ``head``."""
    place = new_place(lines.sparkSession, name)
    if head is None:
        lines.select("value").write.text(place)
    else:  # the CSV writer puts a header on every file
        lines.select(F.col("value").alias(head)).write.option("header", True).option("sep", "\x01").option("quote", "\x02").option("ignoreLeadingWhiteSpace", False).csv(place)
    return place


def _csv(df: DataFrame, name: str, sep: str = ",") -> str:
    place = new_place(df.sparkSession, name)
    df.write.options(header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(place)
    return place


# ---- readers


def read_ppi_text(spark: SparkSession, d: str) -> DataFrame:
    """The interactions as a white-space-delimited file, read with the score cutoff."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2", "combined_score").select(protein_core("protein1").alias("a"), protein_core("protein2").alias("b"), "combined_score").dropna()
    return files.read_ppi(spark, _text(rows.select(F.concat_ws("  ", "a", "b", "combined_score").alias("value")), "ppi.txt", "protein1 protein2 combined_score"))


def read_delimited_herbs(spark, d):
    """Herb_info as a file with another separator."""
    return files.read_delimited(spark, _csv(load(spark, d, "herb_info", *NAMES), "herbs.txt", "|"))


def read_directory_infos(spark, d):
    """Files whose names tell their kind, as tables: ids per table."""
    paths = []
    for kind in ("herb", "target", "disease"):
        ids = load(spark, d, f"{kind}_info", f"{kind}_id").withColumn("x", F.lit(kind))
        for part, rows in enumerate((ids.where(F.crc32(F.coalesce(f"{kind}_id", F.lit(""))) % 2 == 0), ids.where(F.crc32(F.coalesce(f"{kind}_id", F.lit(""))) % 2 == 1))):
            place = f"{new_place(spark, 'infos')}/HERB_{kind}_info_{part}.csv"
            rows.write.options(header=True).csv(place)
            paths.append(place)
    tables = files.read_directory(spark, paths)
    out = [df.select(F.lit(t).alias("tab_name"), F.col(f"{t.split('_')[0].lower()}_id").alias("id")) for t, df in sorted(tables.items())]
    return out[0].unionByName(out[1]).unionByName(out[2])


def read_edges_csv(spark, d):
    """The edges as a CSV file, repeats kept."""
    ends = _edges(spark, d).select(same_id("node_1").alias("node_1"), same_id("node_2").alias("node_2"))
    return files.read_edges(spark, _csv(ends, "edges.csv"))


def read_edge_list_ppi(spark, d):
    """The interaction graph as an edge list."""
    return files.read_edge_list(spark, _text(_graph(spark, d).select(F.concat_ws(" ", "b", "a").alias("value")), "edges.edgelist"))


def read_gmt_symbols(spark, d):
    """Genes by the first three letters of their symbol, as a GMT file."""
    genes = resolve.clean_xref(_xref(spark, d)).where("hgnc_symbol is not null").select(F.substring("hgnc_symbol", 1, 3).alias("term"), "ensg").distinct()
    lines = genes.groupBy("term").agg(F.concat_ws("\t", F.collect_set("ensg")).alias("g")).select(F.concat_ws("\t", "term", F.lit("by symbol"), "g").alias("value"))
    return files.term_genes(spark, _text(lines, "terms.gmt"))


def read_xref_csv(spark, d):
    """The cross references under another source's headers, guessed and cleaned."""
    rows = load(spark, d, "ensembl_xref", "ensg", "ensp", "hgnc_symbol", "uniprot").select(*[F.translate(c, "\r\n", "  ").alias(c) for c in ("ensg", "ensp", "hgnc_symbol", "uniprot")])
    rows = rows.toDF("Ensembl Gene ID", "Ensembl Protein ID", "Gene name", "UniProtKB/Swiss-Prot ID")
    return resolve.clean_xref(files.read_xref(spark, _csv(rows, "mart.csv")))


def ses_of_results(spark, d):
    """SES of neighbouring diseases per category from results that a service delivered as files, half of them
    tab-separated, half as JSON lines."""
    n = Network(spark, d)
    sets, place = cut(_neighbour_pairs(n).select(F.concat_ws("#", "pair", "side").alias("set_id"), "pair", "side", "gene"), "pairs"), [new_place(spark, f"results-{i}") for i in range(2)]
    results = cut(ses.local_provider(n.terms)(sets.select("set_id", "gene")), "results")
    half = F.crc32("set_id") % 2
    results.where(half == 0).withColumn("x", F.lit("other")).write.options(header=True, sep="\t", quote="").csv(place[0])
    results.where(half == 1).write.json(place[1])
    both = ses.read_results(spark, place[0]).unionByName(ses.read_results(spark, place[1], "json"))
    out = ses.by_category(sets.select("pair", "side", "gene"), ses.given_provider(both), ("pair",), q_cut=1.0)
    return out.select("pair", "category", F.round("ses", 8).alias("ses"), "n_terms")


def read_codes_file(spark, d):
    """Herb codes as a file with comments and blank lines."""
    codes = load(spark, d, "herb_info", "herb_id").select(same_id("herb_id").alias("value")).where("value is not null").distinct()
    lines = codes.unionByName(codes.select(F.concat(F.lit("# "), "value").alias("value"))).unionByName(codes.select(F.lit(" ").alias("value")))
    return payload.code_list(spark, "HERB", codes_file=_text(lines, "codes.txt"), code_last=True).select("code")


def file_magic(spark, d):
    """Whether the tables' files begin as Parquet files do."""
    names = ["formula_info", "disease_info", "eval_items"]
    there = [(n, files.has_header(spark, f"{d.rstrip('/')}/{n}.parquet", b"PAR1")) for n in names]
    return spark.createDataFrame(there, "tab_name string, is_parquet boolean")


def table_columns(spark, d):
    """Columns of the network tables."""
    names = ["human_ppi", "herb_edges", "ensembl_xref", "target_info"]
    return spark.createDataFrame([(t, c) for t in names if sinks.exists(spark, f"{d.rstrip('/')}/{t}.parquet") for c in load(spark, d, t).columns], "tab_name string, col_name string")


# ---- sinks


def _pairs(spark, d) -> DataFrame:
    x = load(spark, d, "ensembl_xref", "ensg", "ensp", "load_no").select(cut_version("ensg").alias("ensg"), cut_version("ensp").alias("ensp"), "load_no")
    return x.where("ensg is not null and ensp is not null")


def sink_append_new(spark, d):
    """A table replaced by the cross references of the first four loads, then grown by the keys of all loads."""
    rows, place = _pairs(spark, d), new_place(spark, "grown")
    sinks.replace(rows.where("load_no <= 4").select("ensg", "ensp").distinct(), place)
    sinks.append_new(rows.select("ensg", "ensp"), place, ["ensg", "ensp"])
    return spark.read.parquet(place)


def sink_duplicates(spark, d):
    """Target ids that a unique index would refuse."""
    ids = load(spark, d, "target_info", "target_id").select(same_id("target_id").alias("target_id")).where("target_id is not null")
    return sinks.duplicates(ids, ["target_id"])


def sink_clean_edges(spark, d):
    """Clean edges as a table in the place of the raw one, which is dropped: its rows and whether the raw one is there."""
    raw, place = new_place(spark, "raw-edges"), new_place(spark, "clean-edges")
    _edges(spark, d).write.parquet(raw)
    sinks.replace(edges.clean_edges(spark.read.parquet(raw), _kinds(spark, d)), place, original=raw)
    return spark.read.parquet(place).withColumn("raw_is_there", F.lit(sinks.exists(spark, raw)))


def sink_flush_edges(spark, d):
    """An edge table that takes the edges in two flushes."""
    rows, place = load(spark, d, "herb_edges", "node_1", "node_2", "load_no"), new_place(spark, "flushed")
    sinks.flush_edges(rows.where("load_no <= 4").select("node_1", "node_2"), place)
    sinks.flush_edges(rows.where("load_no > 3 or load_no is null").select("node_1", "node_2"), place)
    return spark.read.parquet(place)


def sink_json(spark, d):
    """Herb names as JSON lines, read back."""
    place = new_place(spark, "herbs.json")
    sinks.to_json_lines(load(spark, d, "herb_info", *NAMES), place)
    return spark.read.schema(", ".join(f"{c} string" for c in NAMES)).json(place)


def sink_distance_cache(spark, d):
    """A table of distances from five formulas that grows to all of them; kept, as the graph still has its nodes."""
    n, place = Network(spark, d), new_place(spark, "distances")
    g = cut(graph.simple_graph(edges.clean_edges(_edges(spark, d), n.kinds), "node_1", "node_2"), "graph")
    formulas = n.kinds.where("kind = 'Formula'").select(F.col("id").alias("node"))
    cache = sinks.extend_distances(g, formulas.orderBy("node").limit(5), place)
    if not graph.same_nodes(g, cache):
        raise ValueError("the cache speaks of nodes the graph lacks")
    return sinks.extend_distances(g, formulas, place)


def stream_payload_edges(spark, d):
    """Payload files as a stream of micro-batches into an edge table."""
    inbox, table = new_place(spark, "inbox"), new_place(spark, "stream-edges")
    _payloads(spark, d).repartition(3).write.json(inbox)
    grow_edges(payload_stream(spark, inbox, 2), table, new_place(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(table)


def payload_all_ids(spark, d):
    """Ids of all nine prefixes in every payload, in any spelling, per code in comparison form."""
    ids = payload.payload_ids(_payloads(spark, d)).select(trim_id("code").alias("code"), "id")
    return ids.distinct()


QUERIES = {
    f.__name__: f
    for f in (
        read_ppi_text, read_delimited_herbs, read_directory_infos, read_edges_csv, read_edge_list_ppi, read_gmt_symbols, read_xref_csv, ses_of_results, read_codes_file, file_magic,
        table_columns, sink_append_new, sink_duplicates, sink_clean_edges, sink_flush_edges, sink_json, sink_distance_cache, stream_payload_edges, payload_all_ids,
    )
}

_CLEAN_TEXT = lambda c: f"nullif(regexp_replace({c}, '^[\\s\\x{{0b}}\\x{{a0}}\\x{{feff}}]+|[\\s\\x{{0b}}\\x{{a0}}]+$', '', 'g'), '')"
_VERSION = lambda c: f"nullif(trim(split_part({TRIM(c)}, '.', 1), concat(' ', chr(9), chr(10), chr(13), chr(160))), '')"
_ALL_IDS = """pay as (select node_1 code, concat('{"items":[{"', node_2, '":"', coalesce(tp, 'none'), ' of ', node_1, '"}]}') payload from herb_edges where node_1 is not null and node_2 is not null),
  found as (select distinct code, upper(id) id from (select code, unnest(regexp_extract_all(payload, '(?i)\\b(?:HBIN|HBDIS|HBTAR|HBCT|HBMA|HERB|HBFO|HBREF|HBEXP)[0-9]+\\b')) id from pay))"""
_XREF_FILE = XREF.replace("from ensembl_xref)", "from (select " + ", ".join(f"{_CLEAN_TEXT(c)} {c}" for c in ("ensg", "ensp", "hgnc_symbol", "uniprot")) + " from ensembl_xref))")
ORACLES = {
    "read_ppi_text": f"select a protein1, b protein2, combined_score from (select {core_sql('protein1')} a, {core_sql('protein2')} b, combined_score from human_ppi) where a is not null and b is not null and combined_score >= 700",
    "read_delimited_herbs": f"select distinct {', '.join(f'{_CLEAN_TEXT(c)} {c}' for c in NAMES)} from herb_info",
    "read_directory_infos": " union all ".join(f"select distinct '{k.capitalize()}_info' tab_name, {_CLEAN_TEXT(k + '_id')} id from {k}_info" for k in ("herb", "target", "disease")),
    "read_edges_csv": f"select {id_sql('node_1')} node_1, {id_sql('node_2')} node_2 from herb_edges",
    "read_edge_list_ppi": f"with {PPI} select a, b from g",
    "read_gmt_symbols": f"with {XREF} select distinct substr(hgnc_symbol, 1, 3) term, ensg gene from x where hgnc_symbol is not null",
    "read_xref_csv": f"with {_XREF_FILE} select * from x",
    "ses_of_results": NETWORK_SQL["ses_by_category"],
    "read_codes_file": f"select distinct {id_sql('herb_id')} code from herb_info where {id_sql('herb_id')} is not null",
    "file_magic": "select unnest(['formula_info', 'disease_info', 'eval_items']) tab_name, true is_parquet",
    "table_columns": " union all ".join(f"select '{t}' tab_name, column_name col_name from (describe {t})" for t in ("human_ppi", "herb_edges", "ensembl_xref", "target_info")),
    "sink_append_new": f"select distinct {_VERSION('ensg')} ensg, {_VERSION('ensp')} ensp from ensembl_xref where {_VERSION('ensg')} is not null and {_VERSION('ensp')} is not null",
    "sink_duplicates": f"select {id_sql('target_id')} target_id, count(*) n from target_info where {id_sql('target_id')} is not null group by 1 having count(*) > 1",
    "sink_clean_edges": f"with {KINDS} select *, false raw_is_there from cl",
    "sink_flush_edges": f"select distinct least(a, b) node_1, greatest(a, b) node_2 from (select {id_sql('node_1')} a, {id_sql('node_2')} b from herb_edges) where a is not null and b is not null",
    "sink_json": f"select {', '.join(NAMES)} from herb_info",
    "sink_distance_cache": f"with recursive {KINDS}, {FORMULA} select src, dst, d from fd",
    "stream_payload_edges": f"with {_ALL_IDS}, e as (select {id_sql('code')} c, id from found) select distinct least(c, id) node_1, greatest(c, id) node_2 from e where c is not null",
    "payload_all_ids": f"with {_ALL_IDS} select distinct {TRIM('code')} code, id from found",
}
