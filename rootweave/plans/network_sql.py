"""DuckDB SQL of the network queries, written from their definitions as plain joins and recursive queries."""

from rootweave.plans.quality import LINES_SQL, SPACE_SQL, core_sql, id_sql

GENE = lambda c: f"nullif(trim(split_part({id_sql(c)}, '.', 1), {SPACE_SQL}), '')"
TRIM = lambda c: f"trim({c}, {SPACE_SQL})"
NUM = lambda c: f"case when regexp_full_match(trim({c}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({c}) as double) end"

PPI = f"""
ppi as (select * from (select {core_sql('protein1')} a, {core_sql('protein2')} b from human_ppi where combined_score between 700 and 1000) where a is not null and b is not null),
g as (select distinct least(a, b) a, greatest(a, b) b from ppi),
gn as (select a n from g union select b from g),
u as (select a n, b m from g where a <> b union all select b, a from g where a <> b)"""
KINDS = f"""
kinds as (
  select {id_sql('herb_id')} id, 'Herb' kind from herb_info union select {id_sql('ingredient_id')}, 'Ingredient' from ingredient_info
  union select {id_sql('target_id')}, 'Target' from target_info union select {id_sql('disease_id')}, 'Disease' from disease_info
  union select {id_sql('formula_id')}, 'Formula' from formula_info),
ki as (select * from kinds where id is not null),
ed as (select distinct least(x, y) a, greatest(x, y) b from (select {id_sql('node_1')} x, {id_sql('node_2')} y from herb_edges) where x is not null and y is not null),
tk as (select ed.a, p.kind a_kind, ed.b, q.kind b_kind from ed left join ki p on p.id = ed.a left join ki q on q.id = ed.b),
lab as (select *, case when (a_kind = 'Formula' and b_kind = 'Herb') or (a_kind = 'Herb' and b_kind = 'Formula') then 'Formula–Herb'
    when (a_kind = 'Herb' and b_kind = 'Ingredient') or (a_kind = 'Ingredient' and b_kind = 'Herb') then 'Herb–Ingredient'
    when (a_kind = 'Ingredient' and b_kind = 'Target') or (a_kind = 'Target' and b_kind = 'Ingredient') then 'Ingredient–Target'
    when (a_kind = 'Target' and b_kind = 'Disease') or (a_kind = 'Disease' and b_kind = 'Target') then 'Target–Disease' end tp from tk where a <> b),
cl as (select distinct tp, a node_1, b node_2 from lab where tp is not null)"""
WORD = lambda c: f"case when lower({TRIM(c)}) not in ('', 'nan') then {TRIM(c)} end"
XREF = f"""
x as (select ensg, ensp, min(s) hgnc_symbol, min(p) uniprot from (select {GENE('ensg')} ensg, {GENE('ensp')} ensp, {WORD('hgnc_symbol')} s, {WORD('uniprot')} p from ensembl_xref)
      where starts_with(ensg, 'ENSG') and starts_with(ensp, 'ENSP') group by all),
tg as (select distinct {id_sql('target_id')} target, {GENE('ensembl_id')} ensg from target_info where {GENE('ensembl_id')} is not null)"""


def hop(name: str, seeds: str, tp: str) -> str:
    return f"""{name} as (select s.query, c.node_2 id from {seeds} s join cl c on c.node_1 = s.id and tp = '{tp}'
      union select s.query, c.node_1 from {seeds} s join cl c on c.node_2 = s.id and tp = '{tp}')"""


def proteins(name: str, nodes: str) -> str:
    return f"""{name}_g as (select n.query, tg.ensg from {nodes} n join tg on tg.target = n.id union select n.query, tg.ensg from {nodes} n join tg on tg.ensg = n.id),
{name} as (select distinct query, ensg, x.ensp from {name}_g join x using (ensg))"""


def seeds(name: str, kind: str) -> str:
    return f"{name} as (select distinct id query, id from ki where kind = '{kind}')"


HERB = ", ".join([seeds("sh", "Herb"), hop("h1", "sh", "Herb–Ingredient"), hop("h2", "h1", "Ingredient–Target"), proteins("hp", "h2")])
DRUG = ", ".join([seeds("si", "Ingredient"), hop("i1", "si", "Ingredient–Target"), proteins("ip", "i1")])
DIS = ", ".join([seeds("sd", "Disease"), hop("d1", "sd", "Target–Disease"), proteins("dp", "d1")])
BASE = f"with recursive {KINDS}, {XREF}"
FIRST = f"""{PPI}, {HERB}, {DIS},
ha as (select distinct query, ensp from hp join gn on gn.n = ensp), hb as (select distinct query, ensp from dp join gn on gn.n = ensp),
sets as (select 'first' pair, 'A' side, ensp node from ha where query = (select min(query) from ha)
         union all select 'first', 'B', ensp from hb where query = (select min(query) from hb))"""
DEG = """deg as (select n node, count(*) degree from (select a n from g union all select b from g) group by n),
bk as (select *, row_number() over (partition by degree order by node) - 1 idx, count(*) over (partition by degree) size from deg)"""
HASH = lambda t: f"(('0x' || substr(md5({t}), 1, 15))::bigint)"
SAMPLES = f"""{DEG},
dr as (select pair, side, it, degree, {HASH("concat('42|', pair, '|', it, '|', side, '|', s.node)")} % size idx
       from sets s join bk on bk.node = s.node, (select unnest(range(1, 101)) it)),
sm as (select pair, side, 0 it, node from sets union all select pair, side, it, bk.node from dr join bk on bk.degree = dr.degree and bk.idx = dr.idx)"""
NULLS = """bf(it, n, d) as (select distinct it, node, 0 from sm where side = 'B' union select bf.it, u.m, bf.d + 1 from bf join u on u.n = bf.n where bf.d < 7),
lv as (select it, n, min(d) d from bf group by it, n),
ds as (select pair, sm.it, coalesce(avg(lv.d), 'inf'::double) d from sm left join lv on lv.it = sm.it and lv.n = sm.node where side = 'A' group by pair, sm.it)"""
FORMULA = """gg as (select distinct node_1 a, node_2 b from cl), gu as (select a n, b m from gg union all select b, a from gg),
fb(src, n, d) as (select id, id, 0 from ki where kind = 'Formula' and id in (select n from gu) union select fb.src, gu.m, fb.d + 1 from fb join gu on gu.n = fb.n where fb.d < 8),
fd as (select src, n dst, min(d) d from fb group by src, n)"""
ADME_OK = f"""{NUM('ob_score')} >= 30 and {NUM('drug_likeness')} >= 0.18 and {NUM('molwt')} <= 500 and {NUM('numhacceptors')} <= 10
  and {NUM('numhdonors')} <= 5 and {NUM('mollogp')} <= 5.5 and {NUM('numrotatablebonds')} <= 10"""


def checked(ob, dl, logp, most, tail=""):
    v = f"(coalesce(({NUM('molwt')} > 500)::int, 0) + coalesce(({NUM('numhacceptors')} > 10)::int, 0) + coalesce(({NUM('numhdonors')} > 5)::int, 0) + coalesce(({NUM('mollogp')} > {logp})::int, 0))"
    return f"""select row_no, {id_sql('ingredient_id')} id, violations, fails, fails = '' eligible from (select *, concat_ws(';', case when {NUM('ob_score')} < {ob} then 'OB_score<{ob}' end,
      case when {NUM('drug_likeness')} < {dl} then 'Drug_likeness<{dl}' end, case when violations > {most} then 'Lipinski_violations>{most}' end) fails
      from (select *, {v} violations from ingredient_info)){tail}"""


TERMS = f"""{DRUG}, {DIS},
tm as (select distinct 'Ingredient' category, query term, ensg gene from ip union all select distinct 'Family', substr(hgnc_symbol, 1, 3), ensg from x where hgnc_symbol is not null
       union all select distinct 'Symbol', substr(hgnc_symbol, 1, 2), ensg from x where hgnc_symbol is not null),
st as (select distinct query set_id, ensg gene from dp)"""
LF = "lgamma({0} + 1)"
CH = lambda a, b: f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"


FIN = lambda v: f"(case when isfinite({v}) then round({v}, 8) end)"


def ora(st="st", cut=0):
    return f"""kn as (select distinct gene from tm), tsz as (select category, term, count(*) m from tm group by all), nt as (select category, count(*) n_tests from tsz group by all),
ssz as (select set_id, count(*) n, count(*) filter (kn.gene is null) outside from {st} left join kn using (gene) group by set_id),
kk as (select set_id, category, term, count(*) k from {st} join tm using (gene) group by all),
ov as (select set_id, category, term, k, m, n, (select count(*) from kn) + outside total, n_tests from kk join tsz using (category, term) join nt using (category) join ssz using (set_id)),
pv as (select *, least(1.0, list_sum(list_transform(range(k, least(m, n) + 1), lambda i: case when n - i > total - m then 0.0 else
        exp({CH('m', 'i')} + {CH('total - m', 'n - i')} - {CH('total', 'n')}) end))) p from ov),
rk as (select *, row_number() over (partition by set_id, category order by p, term) rnk from pv),
qv as (select *, least(1.0, min(p * n_tests / rnk) over (partition by set_id, category order by rnk desc rows unbounded preceding)) q from rk),
lg as (select *, round(log10(greatest(p, 1e-300)), 6) lp, round(log10(greatest(q, 1e-300)), 6) lq from qv)"""


NAMES = "herb_id herb_pinyin_name herb_cn_name herb_alias_name herb_en_name herb_latin_name".split()
HASH_U = HASH("concat('42|', it, '|', side, '|', node)")
PAY = "pay as (select node_1 code, concat('{\"items\":[{\"', node_2, '\":\"', coalesce(tp, 'none'), ' of ', node_1, '\"}]}') payload from herb_edges where node_1 is not null and node_2 is not null)"
PID = f"""{PAY}, pid as (select distinct code, id from (select code, unnest(regexp_extract_all(payload, '\\bHB[A-Z0-9]+\\b')) id from pay)
  where regexp_full_match(id, '(HBIN|HBDIS|HBTAR|HBCT|HBMA|HERB|HBFO|HBREF|HBEXP)[0-9]+'))"""
SES = f"""ids as (select set_id, lead(set_id) over (order by set_id) other from (select distinct set_id from st)),
pr as (select concat(set_id, '~', other) pair, set_id, other from ids where other is not null),
rt as (select pair, side, category, concat(category, ':', term) k2, row_number() over (partition by pair, side, category order by lq, lp, concat(category, ':', term)) place
       from (select pair, 'A' side, lg.* from pr join lg on lg.set_id = pr.set_id union all select pair, 'B', lg.* from pr join lg on lg.set_id = pr.other)),
r2 as (select * from rt where place <= 20),
sz as (select pair, category, coalesce(max(place) filter (side = 'A'), 0) na, coalesce(max(place) filter (side = 'B'), 0) nb from r2 group by all),
fp as (select pair, category, k2, min(place) filter (side = 'A') a, min(place) filter (side = 'B') b from r2 group by all),
kk2 as (select sz.pair, sz.category, k, least(na, nb) n_terms, count(*) filter (a <= k and b <= k) i, count(*) filter (a <= k or b <= k) u
        from sz join (select unnest(range(1, 21)) k) on k <= least(na, nb) join fp on fp.pair = sz.pair and fp.category = sz.category group by all),
sc as (select sz.pair, sz.category, coalesce(avg(i / u), 0) ses, least(na, nb) n_terms from sz left join kk2 on kk2.pair = sz.pair and kk2.category = sz.category group by sz.pair, sz.category, na, nb)"""
SES_ALL = SES.replace("select pair, side, category, concat(category, ':', term) k2, row_number() over (partition by pair, side, category order by", "select pair, side, 'all' category, concat(category, ':', term) k2, row_number() over (partition by pair, side order by")

SES_TAIL = SES[SES.index("r2 as"):]
# Sets named it#side, and their scores per category.
NULL_SES = f"""rt as (select split_part(set_id, '#', 1) pair, split_part(set_id, '#', 2) side, category, concat(category, ':', term) k2,
  row_number() over (partition by set_id, category order by lq, lp, concat(category, ':', term)) place from lg), {SES_TAIL}"""


def null_report(scores: str, by: str) -> str:
    return f"""o as (select {by}, ses from {scores} where it = 0), nu as (select {by}, ses from {scores} where it > 0)
    select o.{by}, round(o.ses, 8) ses, round((count(*) filter (round(nu.ses, 9) >= round(o.ses, 9)) + 1) / (count(nu.ses) + 1), 8) p_emp, round(avg(nu.ses), 8) null_mean,
    round(case when count(nu.ses) = 1 then 0 else stddev_samp(nu.ses) end, 8) null_std, count(nu.ses) n_null from o left join nu on nu.{by} = o.{by} group by o.{by}, o.ses"""


def binned(draws: int) -> str:
    """Draws by bin from ``bg`` (node, bin) for ``tgt`` (side, node, bin)."""
    h = HASH("concat('42|', it, '|', side, '|', need_bin, '|', node)")
    return f"""nd as (select side, bin need_bin, count(*) need from tgt group by all), bz as (select bin, count(*) size from bg group by bin),
    rc as (select *, coalesce(sum(size) over (partition by side, need_bin order by abs(bin - need_bin), bin rows between unbounded preceding and 1 preceding), 0) bef from nd, bz),
    tk2 as (select *, least(size, need - bef) take from rc where least(size, need - bef) > 0),
    rr as (select side, need_bin, bg.bin, take, node, it, row_number() over (partition by side, it, need_bin, bg.bin order by {h}, node) r
           from bg join tk2 on tk2.bin = bg.bin, (select unnest(range(1, {draws + 1})) it)),
    bd as (select side, cast(it as int) it, node from rr where r <= take)"""


def cuts(of: str) -> str:
    return f"cu as (select distinct round(unnest(quantile_cont(degree::double, [0, 0.2, 0.4, 0.6, 0.8, 1.0])), 9) x from {of})"


FIRST_SETS = "fs as (select case when set_id = (select min(set_id) from st) then 'A' else 'B' end side, gene from st where set_id in (select distinct set_id from st order by 1 limit 2))"
NULL_SETS = f"""{FIRST_SETS}, fz as (select side, count(*) n from fs group by side), gb as (select distinct ensg node from x),
hu as (select side, it, node, n, {HASH("concat('42|', it, '|', side, '|', node)")} h from gb, fz, (select unnest(range(1, 101)) it)),
du as (select side, it, node, n, row_number() over (partition by side, it order by h, node) r from hu),
sn as (select distinct concat(it, '#', side) set_id, gene from (select 0 it, side, gene from fs union all select it, side, node from du where r <= n))"""
STRIP = lambda c: f"(case when starts_with({TRIM(c)}, '9606.') then substr({TRIM(c)}, 6) else {TRIM(c)} end)"
ENSP = lambda c: f"(case when starts_with({STRIP(c)}, 'ENSP') then split_part({STRIP(c)}, '.', 1) end)"
FIRST_PROTEINS = "fp2 as (select distinct case when query = (select min(query) from dp) then 'A' else 'B' end side, ensp node from dp where query in (select distinct query from dp order by 1 limit 2))"
MATCHED = f"""{FIRST_PROTEINS}, ap as (select {ENSP('protein1')} a, {ENSP('protein2')} b from human_ppi),
ad as (select node, count(*) degree from (select a node from ap where a is not null and b is not null union all select b from ap where a is not null and b is not null) group by node),
bb as (select n.node, coalesce(ad.degree, 0) degree from (select a node from ap where a is not null union select b from ap where b is not null) n left join ad on ad.node = n.node),
{cuts('bb')}, bg as (select node, cast((select count(*) from cu where x < degree) as int) bin from bb),
tgt as (select side, fp2.node, cast((select count(*) from cu where x < coalesce(ad.degree, 0)) as int) bin from fp2 left join ad on ad.node = fp2.node), {binned(100)}"""
MAPPED = lambda rows: f"sn as (select distinct concat(it, '#', side) set_id, x.ensg gene from ({rows}) r join x on x.ensp = r.node)"
RAW_NAMES = f"nm as (select distinct {id_sql('ingredient_id')} query, {id_sql('v')} n from (select ingredient_id, unnest([ingredient_id, ingredient_name, ingredient_alias_name]) v from ingredient_info) where {id_sql('ingredient_id')} is not null and {id_sql('v')} is not null)"


def raw_ends(where: str = "true") -> str:
    return f"""rw as (select {id_sql('node_1')} a, {id_sql('node_2')} b from herb_edges where {where})
    select distinct query, node from (select query, b node from rw join nm on nm.n = a union all select m.query, a from rw join nm m on m.n = b
    where not exists (select 1 from nm k where k.query = m.query and k.n = a)) where node is not null"""


MANY = f"""dq as (select distinct query, ensp node from dp), dl as (select query, lead(query) over (order by query) other from (select distinct query from dq)),
sets as (select pair, side, node from (select concat(dl.query, '~', other) pair, 'A' side, node from dl join dq on dq.query = dl.query where other is not null
  union all select concat(dl.query, '~', other), 'B', node from dl join dq on dq.query = dl.other) where node in (select n from gn))"""
SAMPLES_N = lambda n: SAMPLES.replace("range(1, 101)", f"range(1, {n + 1})")
MANY_NULLS = """bf(pair, it, n, d) as (select distinct pair, it, node, 0 from sm where side = 'B' union select pair, it, u.m, bf.d + 1 from bf join u on u.n = bf.n where bf.d < 8),
lv as (select pair, it, n, min(d) d from bf group by all),
ds as (select sm.pair, sm.it, coalesce(avg(lv.d), 'inf'::double) d from sm left join lv on lv.pair = sm.pair and lv.it = sm.it and lv.n = sm.node where side = 'A' group by all)"""
MEAN_NULLS = """bf(s, n, d) as (select distinct node, node, 0 from sm where side = 'A' union select bf.s, u.m, bf.d + 1 from bf join u on u.n = bf.n where bf.d < 14),
lv as (select s, n, min(d) d from bf group by s, n),
ds as (select p.pair, p.it, coalesce(avg(lv.d), 'inf'::double) d from sm p join sm q on q.pair = p.pair and q.it = p.it and q.side = 'B' left join lv on lv.s = p.node and lv.n = q.node where p.side = 'A' group by all)"""
Z = """o as (select pair, d from ds where it = 0),
s as (select o.pair, avg(ds.d) mean, stddev_pop(ds.d) std, avg((ds.d <= o.d)::int) p, count(*) n from ds join o on o.pair = ds.pair where it > 0 and ds.d < 'inf'::double group by o.pair)
select o.pair, round(o.d, 6) d, round(case when std < 1e-12 then 0 else (o.d - mean) / std end, 6) z, round(mean, 6) mean, round(std, 6) std, round(p, 6) p, n from o join s on s.pair = o.pair"""
KIND_SQL = "case " + " ".join(f"when regexp_matches(lower(regexp_extract(file_name, '([^/\\\\]*)$', 1)), '(^|[^a-z]){k}s?([^a-z]|$)') then '{k}'" for k in ("disease", "formula", "ingredient", "target", "herb")) + " end"

ORACLES = {
    "ppi_cutoff": "select protein1, protein2, combined_score from human_ppi where combined_score >= 700",
    "ppi_strip_prefix": "select case when starts_with(protein1, '9606.') then substr(protein1, 6) else protein1 end p1, case when starts_with(protein2, '9606.') then substr(protein2, 6) else protein2 end p2 from human_ppi",
    "ppi_canonical_edges": f"with {PPI} select a, b from g",
    "node_degree_simple": f"with {PPI}, {DEG} select node, degree from deg",
    "node_degree_multi": f"with {PPI} select n node, count(*) degree from (select a n from ppi union all select b from ppi) group by n",
    "degree_buckets": f"with {PPI}, {DEG} select node, degree, idx, size from bk",
    "degree_bins": f"with {PPI}, {DEG}, e as (select distinct round(unnest(quantile_cont(degree::double, [0, 0.2, 0.4, 0.6, 0.8, 1.0])), 9) x from deg) select node, degree, cast((select count(*) from e where x < degree) as int) bin from deg",
    "background_ppi": f"""select distinct node from (select case when starts_with(s, 'ENSP') then split_part(s, '.', 1) end node from (select case when starts_with(t, '9606.') then substr(t, 6) else t end s
        from (select {TRIM('protein1')} t from human_ppi union all select {TRIM('protein2')} from human_ppi))) where node is not null""",
    "background_string_ids": f"select distinct t node from (select {TRIM('protein1')} t from human_ppi union all select {TRIM('protein2')} from human_ppi) where starts_with(t, '9606.')",
    "background_xref": f"with {XREF} select distinct ensp node from x",
    "ppi_fallback_scan": f"select distinct a, b from (select {core_sql('protein1')} a, {core_sql('protein2')} b from human_ppi) where a is not null and b is not null",
    "xref_import_clean": f"with {XREF} select * from x",
    "ensg_to_ensp": f"with {XREF} select ensg, ensp, hgnc_symbol, uniprot from x where ensg in (select {GENE('ensembl_id')} from target_info)",
    "ensp_to_ensg": f"with {XREF} select ensp, ensg, hgnc_symbol, uniprot from x where ensp in (select {core_sql('protein1')} from human_ppi)",
    "edge_typed": f"with {KINDS} select a, a_kind, b, b_kind from tk",
    "edges_clean": f"with {KINDS} select * from cl",
    "edges_clean_adme": f"""with {KINDS}, ok as (select distinct {id_sql('ingredient_id')} id from ingredient_info where {ADME_OK})
        select distinct tp, a node_1, b node_2 from lab where tp is not null and case when a_kind = 'Ingredient' then a in (select id from ok) when b_kind = 'Ingredient' then b in (select id from ok) else true end""",
    "edge_type_counts": f"with {KINDS} select tp, count(*) n_edges from cl group by tp",
    "adme_strict": f"select row_no, {id_sql('ingredient_id')} ingredient_id from ingredient_info where {ADME_OK}",
    "adme_profile_balanced": f"select row_no, violations, fails, eligible from ({checked('30.0', '0.18', 5.5, 1)})",
    "adme_profile_lenient": f"select row_no, violations, fails, eligible from ({checked('20.0', '0.1', 6.0, 2)})",
    "adme_gate": f"""with {KINDS}, {seeds('sh', 'Herb')}, {hop('h1', 'sh', 'Herb–Ingredient')}, c as ({checked('30.0', '0.18', 5.5, 1)})
        select query, count(*) n, count(*) filter (not eligible) n_failed, bool_and(eligible) as "open" from h1 join c using (id) group by query""",
    "resolve_herb": f"{BASE}, {HERB} select distinct query, ensp from hp",
    "resolve_ingredient": f"{BASE}, {DRUG} select distinct query, ensp from ip",
    "resolve_disease": f"{BASE}, {DIS} select distinct query, ensp from dp",
    "resolve_herb_name": f"""{BASE}, nm as (select distinct {id_sql('herb_id')} id, lower({TRIM('v')}) name from (select herb_id, unnest([{', '.join(NAMES)}]) v from herb_info)),
        sq as (select distinct herb_latin_name query, nm.id from herb_info join nm on nm.name = lower({TRIM('herb_latin_name')}) and nm.name <> '' and nm.id is not null where herb_latin_name <> ''),
        {hop('h1', 'sq', 'Herb–Ingredient')}, {hop('h2', 'h1', 'Ingredient–Target')}, {proteins('hp', 'h2')} select distinct query, ensp from hp""",
    "resolve_ingredient_like": f"""{BASE}, sq as (select distinct 'quito' query, {id_sql('ingredient_id')} id from ingredient_info where {id_sql('ingredient_id')} is not null and
        (contains(lower(coalesce(ingredient_id, '')), 'quito') or contains(lower(coalesce(ingredient_name, '')), 'quito') or contains(lower(coalesce(ingredient_alias_name, '')), 'quito'))),
        {hop('i1', 'sq', 'Ingredient–Target')}, {proteins('ip', 'i1')} select distinct query, ensp from ip""",
    "resolve_disease_name": f"""{BASE}, nm as (select distinct {id_sql('disease_id')} id, lower({TRIM('v')}) name from (select disease_id, unnest([disease_id, disgenet_id]) v from disease_info)),
        sq as (select distinct disgenet_id query, nm.id from disease_info join nm on nm.name = lower({TRIM('disgenet_id')}) and nm.name <> '' and nm.id is not null where disgenet_id <> ''),
        {hop('d1', 'sq', 'Target–Disease')}, {proteins('dp', 'd1')} select distinct query, ensp from dp""",
    "resolve_gated": f"""{BASE}, c as ({checked('20.0', '0.1', 6.0, 2)}), op as (select id from c where id is not null group by id having bool_and(eligible)),
        {DRUG} select distinct query, ensp from ip where query in (select id from op)""",
    "resolve_router": f"{BASE}, {HERB}, {DRUG}, {DIS} select * from hp union select * from ip union select * from dp",
    "resolve_stats": f"{BASE}, {HERB}, {DRUG}, {DIS}, r as (select * from hp union select * from ip union select * from dp) select query, count(distinct ensg) n_ensg, count(distinct ensp) n_ensp from r group by query",
    "bfs_single_source": f"""with recursive {PPI}, bf(n, d) as (select min(n), 0 from gn union select u.m, bf.d + 1 from bf join u on u.n = bf.n where bf.d < 8)
        select (select min(n) from gn) src, n dst, min(d) d from bf group by n""",
    "bfs_set": f"""{BASE}, {FIRST}, bf(n, d) as (select distinct node, 0 from sets where side = 'B' union select u.m, bf.d + 1 from bf join u on u.n = bf.n where bf.d < 8)
        select n node, min(d) d from bf group by n""",
    "distance_rows": f"with recursive {KINDS}, {FORMULA} select src, dst, d from fd",
    "pair_distances": f"with recursive {KINDS}, {FORMULA} select src x, dst y, d from fd where dst in (select id from ki where kind = 'Disease')",
    "distance_lookup": f"""with recursive {KINDS}, {FORMULA}, p as (select id x, lead(id) over (order by id) y from ki where kind = 'Formula')
        select x, y, fd.d from p left join fd on fd.src = x and fd.dst = y where y is not null""",
    "set_distances": f"""{BASE}, {FIRST}, a as (select node from sets where side = 'A'), b as (select node from sets where side = 'B'),
        bf(s, n, d) as (select distinct node, node, 0 from sets union select bf.s, u.m, bf.d + 1 from bf join u on u.n = bf.n where bf.d < 14),
        lv as (select s, n, min(d) d from bf group by s, n),
        ab as (select s, n, d from lv where s in (from a) and n in (from b)),
        na as (select a.node, coalesce(min(d), 'inf'::double) d from a left join ab on ab.s = a.node group by a.node), nb as (select b.node, coalesce(min(d), 'inf'::double) d from b left join ab on ab.n = b.node group by b.node),
        ia as (select a.node, coalesce(min(d), 'inf'::double) d from a left join lv on s = a.node and n <> s and n in (from a) group by a.node), ib as (select b.node, coalesce(min(d), 'inf'::double) d from b left join lv on s = b.node and n <> s and n in (from b) group by b.node),
        c as (select avg(d) v from (select d from na union all select d from nb))
        select {FIN('c.v')} closest, {FIN("c.v - ((case when (select count(*) from a) <= 1 then 0 else (select avg(d) from ia) end) + (case when (select count(*) from b) <= 1 then 0 else (select avg(d) from ib) end)) / 2")} separation,
        {FIN("case when (select count(*) from ab) < (select count(*) from a) * (select count(*) from b) then 'inf'::double else (select avg(d) from ab) end")} shortest,
        {FIN("(select avg(d) from ab)")} mean_all_pairs, {FIN("(select avg(d) from na where d < 'inf'::double)")} closest_directed from c""",
    "degree_matched_sample": f"{BASE}, {FIRST}, {SAMPLES} select pair, side, cast(it as int) it, node from sm",
    "proximity_null": f"{BASE}, {FIRST}, {SAMPLES}, {NULLS} select pair, cast(it as int) it, round(d, 8) d from ds",
    "proximity_z": f"""{BASE}, {FIRST}, {SAMPLES}, {NULLS}, o as (select pair, d from ds where it = 0),
        s as (select o.pair, avg(ds.d) mean, stddev_pop(ds.d) std, avg((ds.d <= o.d)::int) p, count(*) n from ds join o on o.pair = ds.pair where it > 0 and ds.d < 'inf'::double group by o.pair)
        select o.pair, round(o.d, 6) d, round(case when std < 1e-12 then 0 else (o.d - mean) / std end, 6) z, round(mean, 6) mean, round(std, 6) std, round(p, 6) p, n from o join s on s.pair = o.pair""",
    "ora_counts": f"{BASE}, {TERMS}, {ora()} select * from ov",
    "ora_enrich": f"{BASE}, {TERMS}, {ora()} select set_id, category, term, k, round(log10(greatest(p, 1e-300)), 4) + 0 log_p, round(log10(greatest(q, 1e-300)), 4) + 0 log_q from qv",
    "ora_top_terms": f"""{BASE}, {TERMS}, {ora()}, t as (select set_id, category, term, row_number() over (partition by set_id, category order by lq, lp, k desc, category, term) place from lg where round(q, 9) <= 0.05)
        select set_id, category, term, cast(place as int) place from t where place <= 20""",
    "term_rank_fdr": f"""{BASE}, {TERMS}, {ora()}, t as (select set_id, concat(category, ':', term) as "key", row_number() over (partition by set_id order by lq, lp, concat(category, ':', term)) place from lg where category <> 'Symbol')
        select set_id, "key", cast(place as int) place from t where place <= 10""",
    "ses_by_category": f"{BASE}, {TERMS}, {ora()}, {SES} select pair, category, round(ses, 8) ses, cast(n_terms as int) n_terms from sc",
    "ses_pair": f"{BASE}, {TERMS}, {ora()}, {SES_ALL} select pair, round(ses, 8) ses, cast(n_terms as int) n_terms from sc",
    "ses_weighted": f"{BASE}, {TERMS}, {ora()}, {SES} select pair, round(coalesce(sum(ses * n_terms) / nullif(sum(n_terms), 0), 0), 8) ses, cast(sum(n_terms) as bigint) n_total from sc group by pair",
    "uniform_sample": f"""{BASE}, {FIRST}, z as (select side, count(*) n from sets group by side), h as (select side, it, node, z.n, {HASH_U} h from (select n node from gn), z, (select unnest(range(1, 11)) it)),
        r as (select side, it, node, n, row_number() over (partition by side, it order by h, node) r from h) select side, cast(it as int) it, node from r where r <= n""",
    "payload_id_extract": f"with {PID} select * from pid",
    "payload_edges": f"with {PID} select distinct least({TRIM('code')}, id) node_1, greatest({TRIM('code')}, id) node_2 from pid",
    "payload_counts": f"with {PID} select p.code, count(id) n_ids from (select distinct code from pay) p left join pid on pid.code = p.code group by p.code",
    "edge_merge": f"""with {PID}, e as (select least({TRIM('code')}, id) node_1, greatest({TRIM('code')}, id) node_2 from pid union all select node_1, node_2 from herb_edges),
        f as (select {id_sql('node_1')} a, {id_sql('node_2')} b from e) select distinct least(a, b) node_1, greatest(a, b) node_2 from f where a is not null and b is not null""",
    "code_gaps": f"""with i as (select distinct {id_sql('herb_id')} c from herb_info where regexp_full_match({id_sql('herb_id')}, 'HERB[0-9]{{6,9}}')),
        r as (select unnest(range((select min(substr(c, 5)::bigint) from i), (select max(substr(c, 5)::bigint) from i) + 1)) k) select format('HERB{{:06d}}', k) code from r where format('HERB{{:06d}}', k) not in (from i)""",
    "kind_of_files": f"select file_name, count(*) n_lines, {KIND_SQL} kind from ingredient_raw group by file_name",
    "infos_union": f"""select distinct 'Herb' kind, {id_sql('herb_id')} id, herb_en_name name from herb_info union all select distinct 'Ingredient', {id_sql('ingredient_id')}, ingredient_name from ingredient_info
        union all select distinct 'Target', {id_sql('target_id')}, ensembl_id from target_info union all select distinct 'Disease', {id_sql('disease_id')}, disgenet_id from disease_info
        union all select distinct 'Formula', {id_sql('formula_id')}, null from formula_info""",
    "table_counts": " union all ".join(f"select '{t}' tab_name, count(*) n_rows from {t}" for t in "human_ppi herb_edges ensembl_xref herb_info ingredient_info target_info disease_info formula_info".split()),
    "binned_sample": f"""{BASE}, {FIRST}, {DEG}, {cuts('deg')}, bg as (select node, cast((select count(*) from cu where x < degree) as int) bin from deg),
        tgt as (select side, sets.node, bin from sets join bg on bg.node = sets.node), {binned(10)} select * from bd""",
    "ses_null": f"""{BASE}, {TERMS}, {NULL_SETS}, {ora('sn')}, {NULL_SES}, cb as (select 'first' pair, cast(pair as int) it, coalesce(sum(ses * n_terms) / nullif(sum(n_terms), 0), 0) ses from sc group by all), {null_report('cb', 'pair')}""",
    "ses_null_by_category": f"{BASE}, {TERMS}, {NULL_SETS}, {ora('sn')}, {NULL_SES}, cb as (select category, cast(pair as int) it, ses from sc), {null_report('cb', 'category')}",
    "ses_ensp": f"{BASE}, {TERMS}, {FIRST_PROTEINS}, {MAPPED('select 0 it, side, node from fp2')}, {ora('sn')}, {NULL_SES} select category, round(ses, 8) ses, cast(n_terms as int) n_terms from sc",
    "ses_null_matched_sets": f"{BASE}, {DIS}, {MATCHED} select * from bd",
    "ses_null_matched": f"""{BASE}, {TERMS}, {MATCHED}, {MAPPED('select 0 it, side, node from fp2 union all select it, side, node from bd')}, {ora('sn')}, {NULL_SES},
        cb as (select category, cast(pair as int) it, ses from sc), {null_report('cb', 'category')}""",
    "set_texts": f"{BASE}, {DIS} select query set_id, string_agg(distinct ensg, ',' order by ensg) ids from dp group by query",
    "proximity_mean_z": f"{BASE}, {FIRST}, {SAMPLES_N(10)}, {MEAN_NULLS}, {Z}",
    "proximity_many": f"{BASE}, {PPI}, {DIS}, {MANY}, {SAMPLES_N(3)}, {MANY_NULLS}, {Z}",
    "resolve_raw": f"with {RAW_NAMES}, " + raw_ends("lower(tp) like '%ingredient%target%'"),
    "resolve_raw_disease": f"with nm as (select distinct {id_sql('disease_id')} query, {id_sql('disease_id')} n from disease_info where {id_sql('disease_id')} is not null), {raw_ends()}",
    "ensg_passed_through": f"select distinct {GENE('ensembl_id')} ensg, {GENE('ensembl_id')} ensp, null::varchar hgnc_symbol, null::varchar uniprot from target_info where {GENE('ensembl_id')} is not null",
    "core_to_string_ids": f"""select core, coalesce(min(t) filter (starts_with(t, '9606.')), core) string_id from (select {core_sql('p')} core, {TRIM('p')} t from (select protein1 p from human_ppi union all select protein2 from human_ppi))
        where core is not null group by core""",
    "first_names": f"select {id_sql('ingredient_id')} ingredient_id, min(row_no) row_no, arg_min(ingredient_name, row_no) ingredient_name from ingredient_info where {id_sql('ingredient_id')} is not null group by 1",
    "adme_fallback": f"""with {LINES_SQL}, en as (select distinct {id_sql('v')} i from (select unnest([node_1, node_2]) v from herb_edges) where {id_sql('v')} like 'HBIN%'),
        own as (select {id_sql('ingredient_id')} i, ob_score, drug_likeness, molwt, numhacceptors, numhdonors, mollogp, numrotatablebonds from ingredient_info)
        select i ingredient_id, ob_score, drug_likeness, molwt, numhacceptors, numhdonors, mollogp, numrotatablebonds from en join own using (i)
        union all select en.i, ob_score, drug_likeness, molwt, numhacceptors, numhdonors, mollogp, numrotatablebonds from en join (select {id_sql('ingredient_id')} i, ob_score, drug_likeness, molwt, numhacceptors, numhdonors, mollogp, numrotatablebonds from lv) l on l.i = en.i where en.i not in (select i from own where i is not null)""",
    "resolve_diagnostics": f"""{BASE}, {DRUG}, c as ({checked('30.0', '0.18', 5.5, 1)})
        select si.query, (select count(*) from i1 where i1.query = si.query) n_targets, (select count(distinct ensg) from ip where ip.query = si.query) n_ensg,
        (select count(distinct ensp) from ip where ip.query = si.query) n_ensp, (select count(*) from c where c.id = si.query) n_rows, (select count(*) from c where c.id = si.query and not eligible) n_failed from si""",
    "xref_import_counts": f"with {XREF}, v as (select starts_with({GENE('ensg')}, 'ENSG') and starts_with({GENE('ensp')}, 'ENSP') ok from ensembl_xref) select count(*) n_rows, count(*) filter (ok) n_valid, (select count(*) from x) n_unique from v",
    "id_prefix_counts": f"select nullif(regexp_extract({id_sql('v')}, '^(HBIN|HBDIS|HBTAR|HBCT|HBMA|HERB|HBFO|HBREF|HBEXP)[0-9]+$', 1), '') prefix, count(*) n_ends from (select unnest([node_1, node_2]) v from herb_edges) group by 1",
}
