"""Queries of the training-data operators and, where SQL can express one, the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import protein_core, same_id
from rootweave.llm import leaks, sentences, tokenizer
from rootweave.llm.similar_sets import SimilarSets
from rootweave.llm.topn import top_n
from rootweave.sources.tables import load

# ---- p2: similar sets


def _herb_sets(spark: SparkSession, d: str) -> SimilarSets:
    ends = load(spark, d, "herb_edges", "node_1", "node_2").select(same_id("node_1").alias("a"), same_id("node_2").alias("b"))
    herb, item = r"^HERB[0-9]+\z", r"^HBIN[0-9]+\z"
    one = F.when(F.col("a").rlike(herb) & F.col("b").rlike(item), F.struct(F.col("a").alias("rec"), F.col("b").alias("item"))).when(
        F.col("b").rlike(herb) & F.col("a").rlike(item), F.struct(F.col("b").alias("rec"), F.col("a").alias("item"))
    )
    return SimilarSets(ends.select(one.alias("m")).where("m is not null").select("m.*"), 3, 5, min_size=5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of herbs with nearly the same ingredients."""
    return _herb_sets(spark, d).expanded().select(F.col("rec_a").alias("herb_a"), F.col("rec_b").alias("herb_b"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per herb: its class of equal sets and its number of links."""
    m = _herb_sets(spark, d).membership()
    return m.select(F.col("rec").alias("herb"), F.col("rep").alias("class_herb"), F.col("n").alias("n_ingredients"), "n_copies", "n_links")


_SPACE = "concat(' ', chr(9), chr(10), chr(13), chr(160))"
_SETS_SQL = f"""
e as (select upper(trim(node_1, {_SPACE})) a, upper(trim(node_2, {_SPACE})) b from herb_edges),
m as (select a h, b i from e where regexp_full_match(a, 'HERB[0-9]+') and regexp_full_match(b, 'HBIN[0-9]+')
      union select b, a from e where regexp_full_match(b, 'HERB[0-9]+') and regexp_full_match(a, 'HBIN[0-9]+')),
s as (select h, count(*) n, list(i order by i) l from m group by h having count(*) >= 5),
k as (select x.h a, y.h b, count(*) c from m x join m y on x.i = y.i and x.h < y.h group by 1, 2),
f as (select a herb_a, b herb_b from k join s p on p.h = a join s q on q.h = b where c * 5 >= (p.n + q.n - c) * 3)"""
P2_FOUND_SQL = f"with {_SETS_SQL} select * from f"
P2_CLASSES_SQL = f"""with {_SETS_SQL},
r as (select h, n, min(h) over (partition by l) rep, count(*) over (partition by l) copies from s),
g as (select herb_a h, herb_b o from f union all select herb_b, herb_a from f)
select r.h herb, rep class_herb, cast(n as int) n_ingredients, copies n_copies, count(g.o) n_links from r left join g on g.h = r.h group by all"""

# ---- p5: top N of every group


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five partners of every protein1 with the highest score."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2", "combined_score").where("combined_score between 0 and 1000")
    rows = rows.select(protein_core("protein1").alias("grp"), protein_core("protein2").alias("item"), F.col("combined_score").alias("score"))
    best = top_n(rows.where("grp <> item"), 5)
    return best.select(F.col("grp").alias("protein1"), F.col("item").alias("protein2"), F.col("place").cast("int").alias("place"))


_CORE = lambda c: f"split_part(case when starts_with(upper(trim({c}, {_SPACE})), '9606.') then substr(upper(trim({c}, {_SPACE})), 6) else upper(trim({c}, {_SPACE})) end, '.', 1)"
P5_FOUND_SQL = f"""
with e as (select {_CORE('protein1')} a, {_CORE('protein2')} b, combined_score s from human_ppi where combined_score between 0 and 1000),
m as (select a, b, max(s) s from e where regexp_full_match(a, 'ENSP[0-9]+') and regexp_full_match(b, 'ENSP[0-9]+') and a <> b group by a, b),
r as (select a protein1, b protein2, cast(row_number() over (partition by a order by s desc, b) as int) place from m)
select * from r where place <= 5"""

# ---- p7: token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return tokenizer.encode(load(spark, d, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document: whether its ids decode to its text again, and the length of what they give."""
    docs = load(spark, d, "documents", "doc_id", "text")
    back = tokenizer.decode(p7_ids(spark, d)).withColumnRenamed("text", "back")
    pairs = docs.join(back, "doc_id")
    return pairs.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"), F.length("back").alias("n_chars"))


# ---- p8: leaked evaluation items


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share 12 consecutive words."""
    found = leaks.leaks(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "eval_items", "item_id", "item_text"))
    return found.select("doc_id", "item_id")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same with the longest common run and the number of places."""
    return leaks.leaks(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "eval_items", "item_id", "item_text"))


def p8_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents with the leaked spans cut out, or dropped if more than half of their words leaked."""
    return leaks.scrub(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "eval_items", "item_id", "item_text"))


# ---- p9: sentences


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.sentences(load(spark, d, "documents", "doc_id", "text"))


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Units and their mean length per document."""
    units = p9_found(spark, d).groupBy("doc_id")
    return units.agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 3).alias("mean_chars"))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p5_found, p7_ids, p7_round_trip, p8_found, p8_runs, p8_scrubbed, p9_found, p9_lengths)}
ORACLES = {"p2_found": P2_FOUND_SQL, "p2_classes": P2_CLASSES_SQL, "p5_found": P5_FOUND_SQL}
