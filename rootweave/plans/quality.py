"""Queries of the table-quality problems and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import gene_core, protein_core, same_id
from rootweave.functions.problems import FIELD_RULES, INGREDIENT_FIELDS, PROFILED_INGREDIENT, PROFILED_XREF
from rootweave.operators import heavy_keys, orphans, profile
from rootweave.session import new_place, utc
from rootweave.sources import rejects
from rootweave.sources.tables import load

# ---- p1: column profiles


def _profiled(spark: SparkSession, d: str) -> list[tuple[DataFrame, list[profile.ColumnRule]]]:
    return [
        (profile.cells(load(spark, d, rules[0].tab_name, "row_no", "load_no", *[r.col_name for r in rules]), rules), rules)
        for rules in (PROFILED_INGREDIENT, PROFILED_XREF)
    ]


def _value_counts(spark: SparkSession, d: str) -> profile.ValueCounts:
    """A store that takes the tables' loads in turn."""
    store = profile.ValueCounts(spark, new_place(spark, "value-counts"))
    parts = [profile.signed_counts(cells) for cells, _ in _profiled(spark, d)]
    store.apply(parts[0].unionByName(parts[1]))
    return store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken cells and changed loads of the profiled columns."""
    found = [profile.cell_findings(cells).withColumnRenamed("row_no", "ref_no") for cells, _ in _profiled(spark, d)]
    shifts = profile.load_shifts(_value_counts(spark, d).deltas(), PROFILED_INGREDIENT + PROFILED_XREF)
    return found[0].unionByName(found[1]).unionByName(shifts.withColumnRenamed("load_no", "ref_no"))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every profiled column and load, from the maintained counts."""
    m = profile.metrics(_value_counts(spark, d).deltas())
    return m.withColumns({"entropy": F.round("entropy", 6), "x_min": F.col("x_min").cast("double"), "x_max": F.col("x_max").cast("double")})


# Year and month of load 1; a load comes every month.
LOAD_1 = (2022, 1)


def p1_live_profile(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the live cells of Ingredient_info after each load.

    Signed deltas: a row adds its cells in its load and takes them back in the load of the month in which it
    is deleted. The state after a load is the sum of all deltas up to it; the last load is the
    table's, and what is deleted after it is still alive in it.
    """
    t = load(spark, d, "ingredient_info", "row_no", "load_no", "deleted_at", *[r.col_name for r in PROFILED_INGREDIENT])
    year, month = LOAD_1
    gone_in = (F.year(utc("deleted_at")) - year) * 12 + F.month(utc("deleted_at")) - (month - 1)
    gone = t.where("deleted_at is not null").withColumn("load_no", F.greatest(F.col("load_no"), gone_in))
    counts = [profile.signed_counts(profile.cells(rows, PROFILED_INGREDIENT), sign) for rows, sign in ((t, 1), (gone, -1))]
    last = t.agg(F.max("load_no").alias("last")).first()["last"] or 0
    store = profile.ValueCounts(spark, new_place(spark, "live-counts"))
    store.apply(counts[0].unionByName(counts[1]).where(F.col("load_no") <= last))
    m = profile.metrics(store.states(range(1, last + 1)))
    return m.select("tab_name", "col_name", "load_no", "cells", "missing", "malformed", "formed", "distinct_formed", F.round("entropy", 6).alias("entropy"))


_COUNT_SQL = "0|[1-9][0-9]{0,2}"
_CELLS_SQL = f"""
rule(tab_name, col_name, pat, low, high, by_len) as (values
  ('ingredient_info','numhdonors','{_COUNT_SQL}',0,30,false),
  ('ingredient_info','mollogp','-?[0-9]{{1,2}}\\.[0-9]{{1,4}}',-12,18,false),
  ('ingredient_info','numrotatablebonds','{_COUNT_SQL}',0,60,false),
  ('ensembl_xref','uniprot','[OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}}',null,null,true)),
raw as (
  select 'ingredient_info' tab_name, 'numhdonors' col_name, row_no, load_no, nullif(numhdonors,'') v, deleted_at from ingredient_info
  union all select 'ingredient_info', 'mollogp', row_no, load_no, nullif(mollogp,''), deleted_at from ingredient_info
  union all select 'ingredient_info', 'numrotatablebonds', row_no, load_no, nullif(numrotatablebonds,''), deleted_at from ingredient_info
  union all select 'ensembl_xref', 'uniprot', row_no, load_no, nullif(uniprot,''), deleted_at from ensembl_xref),
cell as (
  select raw.*, coalesce(regexp_full_match(v, pat), false) ok, low, high,
         case when coalesce(regexp_full_match(v, pat), false) then case when by_len then length(v) else cast(v as double) end end x
  from raw join rule using (tab_name, col_name))"""

P1_FOUND_SQL = f"""
with {_CELLS_SQL},
l as (select tab_name, col_name, load_no, count(*) n, count(*) filter (v is null) miss, count(*) filter (ok) w,
      count(distinct v) filter (ok) dv from cell group by all),
p as (select a.*, b.n pn, b.miss pmiss, b.w pw, b.dv pdv from l a join l b
      on a.tab_name = b.tab_name and a.col_name = b.col_name and a.load_no = b.load_no + 1),
h as (select tab_name, col_name, load_no, x, count(*) c from cell where ok group by all),
xs as (select distinct tab_name, col_name, x from h),
cdf as (select xs.tab_name, xs.col_name, l.load_no, xs.x, l.w, coalesce(sum(h.c), 0) c from xs
        join l on l.tab_name = xs.tab_name and l.col_name = xs.col_name
        left join h on h.tab_name = xs.tab_name and h.col_name = xs.col_name and h.load_no = l.load_no and h.x = xs.x
        group by all),
run as (select *, sum(c) over (partition by tab_name, col_name, load_no order by x) s from cdf)
select tab_name, col_name, case when v is not null and not ok then 'format' else 'range' end finding, cast(row_no as bigint) ref_no
from cell where (v is not null and not ok) or (ok and (x < low or x > high) and low is not null)
union all select tab_name, col_name, 'null_rate', load_no from p where abs(miss * pn - pmiss * n) * 10 > n * pn
union all select tab_name, col_name, 'distinct', load_no from p where col_name = 'uniprot' and w > 0 and pw > 0 and abs(dv * pw - pdv * w) * 5 > w * pw
union all select distinct a.tab_name, a.col_name, 'shape', a.load_no from run a join run b
  on a.tab_name = b.tab_name and a.col_name = b.col_name and a.x = b.x and a.load_no = b.load_no + 1
  where a.w > 0 and b.w > 0 and abs(a.s * b.w - b.s * a.w) * 5 > a.w * b.w"""

_METRICS_SQL = """
select tab_name, col_name, load_no, cast(sum(n) as bigint) cells, cast(coalesce(sum(n) filter (v is null), 0) as bigint) missing,
       cast(coalesce(sum(n) filter (v is not null and not ok), 0) as bigint) malformed, cast(coalesce(sum(n) filter (ok), 0) as bigint) formed,
       count(*) filter (ok) distinct_formed{more},
       round(log2(sum(n) filter (ok)) - sum(n * log2(n)) filter (ok) / sum(n) filter (ok), 6) entropy
from c group by tab_name, col_name, load_no"""
P1_PROFILE_SQL = f"""
with {_CELLS_SQL}, c as (select tab_name, col_name, cast(load_no as bigint) load_no, v, ok, x, count(*) n from cell group by all)
{_METRICS_SQL.format(more=", cast(min(x) as double) x_min, cast(max(x) as double) x_max")}"""
P1_LIVE_SQL = f"""
with {_CELLS_SQL},
s as (select tab_name, col_name, v, ok, x, load_no, 1 n from cell where tab_name = 'ingredient_info'
      union all select tab_name, col_name, v, ok, x, greatest(load_no, (year(deleted_at at time zone 'UTC') - 2022) * 12 + month(deleted_at at time zone 'UTC')), -1
      from cell where tab_name = 'ingredient_info' and deleted_at is not null),
c as (select tab_name, col_name, k as load_no, v, ok, x, sum(n) n from s join (select cast(unnest(range(1, 9)) as bigint) k) on k >= s.load_no
      group by all having sum(n) <> 0)
{_METRICS_SQL.format(more="")}"""

# ---- p3: a few keys hold most rows


def _ends() -> list:
    return [protein_core("protein1"), protein_core("protein2")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Proteins at either end of at least 3 % of all rows."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2")
    return heavy_keys.keys_over_share(rows, _ends(), 3, 100).select(F.col("key").alias("protein"))


def p3_protein_stats(spark: SparkSession, d: str) -> DataFrame:
    """Row count and score statistics of every protein, hot ones included; impossible scores don't count."""
    rows = load(spark, d, "human_ppi", "protein1", "protein2", "combined_score")
    score = F.when(F.col("combined_score").between(0, 1000), F.col("combined_score"))
    return heavy_keys.per_end_states(rows, _ends(), score).withColumnRenamed("key", "protein")


SPACE_SQL = "concat(' ', chr(9), chr(10), chr(13), chr(160))"
_CORE = lambda c: f"split_part(case when starts_with(upper(trim({c}, {SPACE_SQL})), '9606.') then substr(upper(trim({c}, {SPACE_SQL})), 6) else upper(trim({c}, {SPACE_SQL})) end, '.', 1)"
core_sql = lambda c: f"case when regexp_full_match({_CORE(c)}, 'ENSP[0-9]+') then {_CORE(c)} end"
id_sql = lambda c: f"nullif(upper(trim({c}, {SPACE_SQL})), '')"
_ENDS_SQL = f"""
e as (select {core_sql('protein1')} a, {core_sql('protein2')} b, case when combined_score between 0 and 1000 then combined_score end s from human_ppi),
k as (select a p, s from e where a is not null union all select b, s from e where b is not null and b is distinct from a)"""
P3_FOUND_SQL = f"with {_ENDS_SQL} select p protein from k group by p having count(*) * 100 >= 3 * (select count(*) from human_ppi)"
P3_STATS_SQL = f"""with {_ENDS_SQL} select p protein, count(*) n_rows, count(s) n_scored, cast(sum(s) as bigint) score_sum,
min(s) score_min, max(s) score_max from k group by p"""

# ---- p4: references without a record


# Scopes of ids, and the columns that refer; references carry their places in these lists, not the names.
ENTITY, GENE = 0, 1
REFERRING = [("herb_edges", "node_1"), ("herb_edges", "node_2"), ("target_info", "ensembl_id")]


def _references(spark: SparkSession, d: str) -> DataFrame:
    """``src, row_no, scope, key, t``."""
    small = lambda n: F.lit(n).cast("tinyint")
    ends = F.explode(F.array(*[F.struct(small(i).alias("src"), same_id(c).alias("key")) for i, (_, c) in enumerate(REFERRING[:2])])).alias("e")
    edges = load(spark, d, "herb_edges", "edge_no", "node_1", "node_2", "seen_at").select(
        F.col("edge_no").alias("row_no"), small(ENTITY).alias("scope"), F.col("seen_at").alias("t"), ends
    ).select("e.src", "row_no", "scope", "e.key", "t")
    genes = load(spark, d, "target_info", "row_no", "ensembl_id", "added_at").select(
        small(2).alias("src"), "row_no", small(GENE).alias("scope"), gene_core("ensembl_id").alias("key"), F.col("added_at").alias("t"),
    )
    return edges.unionByName(genes)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """``scope, key, added_at, deleted_at``."""
    part = lambda table, scope, column, key: load(spark, d, table, column, "added_at", "deleted_at").select(
        F.lit(scope).cast("tinyint").alias("scope"), key(column).alias("key"), "added_at", "deleted_at"
    )
    df = part("ensembl_xref", GENE, "ensg", gene_core)
    for k in ("herb", "formula", "ingredient", "target", "disease"):
        df = df.unionByName(part(f"{k}_info", ENTITY, f"{k}_id", same_id))
    return df


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference with its reason and month."""
    found = orphans.orphan_references(_references(spark, d), _records(spark, d))
    name = lambda i: F.array(*[F.lit(x[i]) for x in REFERRING])[F.col("src")]
    return found.select(name(0).alias("tab_name"), name(1).alias("col_name"), "row_no", "reason", "seen_month")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, column, month and reason."""
    return orphans.orphan_report(p4_found(spark, d))


_GENE = lambda c: f"nullif(trim(split_part({id_sql(c)}, '.', 1), {SPACE_SQL}), '')"
P4_FOUND_SQL = f"""
with r as (
  select 'herb_edges' tab_name, 'node_1' col_name, edge_no row_no, 'e' sc, {id_sql('node_1')} k, seen_at t from herb_edges
  union all select 'herb_edges', 'node_2', edge_no, 'e', {id_sql('node_2')}, seen_at from herb_edges
  union all select 'target_info', 'ensembl_id', row_no, 'g', {_GENE('ensembl_id')}, added_at from target_info),
i as (
  select 'e' sc, {id_sql('herb_id')} k, added_at, deleted_at from herb_info
  union all select 'e', {id_sql('formula_id')}, added_at, deleted_at from formula_info
  union all select 'e', {id_sql('ingredient_id')}, added_at, deleted_at from ingredient_info
  union all select 'e', {id_sql('target_id')}, added_at, deleted_at from target_info
  union all select 'e', {id_sql('disease_id')}, added_at, deleted_at from disease_info
  union all select 'g', {_GENE('ensg')}, added_at, deleted_at from ensembl_xref),
j as (select tab_name, col_name, row_no, r.k, t, count(i.k) n, count(*) filter (i.added_at > t) later,
        count(*) filter (i.added_at <= t and (i.deleted_at is null or t < i.deleted_at)) alive
      from r left join i on i.sc = r.sc and i.k = r.k where r.k is not null group by tab_name, col_name, row_no, r.k, t)
select tab_name, col_name, row_no, case when n = 0 then 'missing' when later = n then 'late' else 'deleted' end reason,
       strftime(t at time zone 'UTC', '%Y-%m') seen_month from j where alive = 0"""
P4_REPORT_SQL = f"select tab_name, col_name, seen_month, reason, count(*) n_orphans from ({P4_FOUND_SQL}) group by all"

# ---- p6: rows that fail to parse


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Failing delivered lines and failing cells of the loaded table."""
    lines = rejects.line_rejects(load(spark, d, "ingredient_raw", "line_no", "raw_line"), INGREDIENT_FIELDS, FIELD_RULES)
    loaded = rejects.table_rejects(load(spark, d, "ingredient_info", "row_no", *FIELD_RULES), FIELD_RULES)
    out = lambda df, name: df.select(F.lit(name).alias("source_table"), "row_no", "reason", "field_name")
    return out(lines, "ingredient_raw").unionByName(out(loaded, "ingredient_info"))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The delivered lines that parse and hold only valid values, as a table."""
    return rejects.load_valid(load(spark, d, "ingredient_raw", "line_no", "raw_line"), INGREDIENT_FIELDS, FIELD_RULES)


# Lines as fields: in good quoting (RE2, as in the operator), cut at the commas outside quotes, quotes taken off.
_F = '(?:"(?:[^"]|"")*"|[^",]*)'
LINES_SQL = f"""
ln as (select line_no, case when ends_with(r, chr(13)) then left(r, length(r) - 1) else r end raw from (select line_no, coalesce(raw_line, '') r from ingredient_raw)),
lf as (select line_no, raw, regexp_full_match(raw, '{_F}(?:,{_F})*') quoted,
  list_transform(regexp_extract_all(raw || ',', '({_F}),', 1), lambda f: case when starts_with(f, '"') then replace(substr(f, 2, length(f) - 2), '""', '"') else f end) f from ln),
lv as (select line_no, {', '.join(f'nullif(f[{i}], {chr(39) * 2}) {c}' for i, c in enumerate(INGREDIENT_FIELDS, 1))} from lf where quoted and len(f) = 13)"""
_NUMBER = lambda c, low, high: f"({c} is not null and not (regexp_full_match({c}, '[0-9]+(\\.[0-9]+)?') and coalesce(try_cast({c} as decimal(38,18)) {low} and try_cast({c} as decimal(38,18)) <= {high}, false)))"
REJECTS_SQL = f"""{LINES_SQL},
ce as (select 'ingredient_raw' source_table, line_no row_no, ob_score, drug_likeness, molwt, canonical_smiles s from lv
  union all select 'ingredient_info', row_no, nullif(ob_score, ''), nullif(drug_likeness, ''), nullif(molwt, ''), nullif(canonical_smiles, '') from ingredient_info),
us as (select distinct s from ce where s is not null),
ch as (select s, i, substr(s, i, 1) c from us, unnest(range(1, length(s) + 1)) t(i)),
dp as (select s, sum(case c when '(' then 1 when ')' then -1 else 0 end) over w r, sum(case c when '[' then 1 when ']' then -1 else 0 end) over w q, i from ch window w as (partition by s order by i)),
sm as (select s, min(r) r_low, min(q) q_low, max(q) q_high, arg_max(r, i) r_end, arg_max(q, i) q_end from dp group by s),
bs as (select s, not regexp_full_match(s, '[A-Za-z0-9@+\\-\\[\\]()=#$:/\\\\%.*]*') or r_low < 0 or q_low < 0 or q_high > 1 or r_end <> 0 or q_end <> 0 bad from sm),
bad as (select source_table, row_no, unnest(list_filter([case when {_NUMBER('ob_score', '>= 0', 100)} then 'ob_score' end, case when {_NUMBER('drug_likeness', '>= 0', 1)} then 'drug_likeness' end,
  case when {_NUMBER('molwt', '> 0', 5000)} then 'molwt' end, case when bs.bad then 'canonical_smiles' end], lambda v: v is not null)) field_name from ce left join bs using (s))"""
P6_FOUND_SQL = f"""with {REJECTS_SQL}
select 'ingredient_raw' source_table, cast(line_no as bigint) row_no, case when not quoted then 'quoting' else 'column_count' end reason, '' field_name from lf where not quoted or len(f) <> 13
union all select source_table, row_no, 'value', field_name from bad"""
P6_LOADED_SQL = f"with {REJECTS_SQL} select line_no row_no, {', '.join(INGREDIENT_FIELDS)} from lv where line_no not in (select row_no from bad where source_table = 'ingredient_raw')"

QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_live_profile, p3_found, p3_protein_stats, p4_found, p4_report, p6_found, p6_loaded)}
ORACLES = {
    "p1_found": P1_FOUND_SQL, "p1_profile": P1_PROFILE_SQL, "p1_live_profile": P1_LIVE_SQL, "p3_found": P3_FOUND_SQL,
    "p3_protein_stats": P3_STATS_SQL, "p4_found": P4_FOUND_SQL, "p4_report": P4_REPORT_SQL, "p6_found": P6_FOUND_SQL, "p6_loaded": P6_LOADED_SQL,
}
