"""Cases of the second review: each fails on the code before it."""

import itertools
import os
import random
import types
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rootweave import session
from rootweave.operators import bits, edges, graph, orphans, proximity, resolve, sampling, ses
from rootweave.plans import files_io, quality
from rootweave.sources import files, payload, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# ---- intermediate tables


def test_only_a_local_master_goes_without_a_shared_folder():
    fake = lambda master: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))


def test_a_query_leaves_nothing_behind(spark):
    place = session.run_dir(spark).removeprefix("file:")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    with session.scratch(spark):
        n = quality.p4_found(spark, "/root/testdata/sf0.001").count()
        assert set(os.listdir(place)) > before
    assert n > 0 and set(os.listdir(place)) == before


# ---- searches


def test_a_path_of_a_hundred_nodes(spark):
    pairs = table(spark, "a string, b string", *[(f"n{i:03d}", f"n{i + 1:03d}") for i in range(99)])
    found = graph.distances(graph.simple_graph(pairs), table(spark, "node string", ("n000",), ("none",)))
    assert rows(found) == [("n000", f"n{i:03d}", i) for i in range(100)]


def plain_distances(pairs, start):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen = {x: 0 for x in start}
    level = list(start)
    while level:
        level = [y for x in level for y in near.get(x, ()) if y not in seen and not seen.update({y: seen[x] + 1})]
    return seen


def test_many_searches_against_plain(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(75)] + [("x", "y")]
    seeds = [(f"k{k:03d}", f"n{rng.randrange(60):02d}") for k in range(150) for _ in range(rng.randrange(1, 4))] + [("far", "x"), ("gone", "nowhere")]
    wanted = [(f"k{k:03d}", f"n{rng.randrange(60):02d}") for k in range(150) for _ in range(3)] + [("far", "n00"), ("far", "y"), ("unknown", "x")]
    near = graph.neighbours(graph.simple_graph(table(spark, "a string, b string", *pairs)))
    s = table(spark, "key string, node string", *seeds)
    plain = {k: plain_distances(pairs, [x for _, x in g]) for k, g in itertools.groupby(sorted(seeds), key=lambda p: p[0])}
    everything = sorted((k, x, d) for k, found in plain.items() for x, d in found.items())
    assert rows(graph.bfs(near, s)) == everything
    assert rows(graph.bfs(near, s, table(spark, "key string, node string", *wanted))) == [r for r in everything if r[:2] in set(wanted)]
    assert rows(graph.bfs(near, s.where("false"))) == []


def test_mean_over_all_pairs_against_plain(spark):
    rng = random.Random(6)
    pairs = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(40)] + [("x", "y")]
    data = [("p", it, s, f"n{rng.randrange(30):02d}") for it in range(4) for s in "AB" for _ in range(9)] + [("q", 0, "A", "x"), ("q", 0, "B", "n00"), ("r", 0, "A", "x")]
    got = {(r["pair"], r["it"]): r["d"] for r in proximity.mean_all_pairs(graph.simple_graph(table(spark, "a string, b string", *pairs)), table(spark, "pair string, it int, side string, node string", *data)).collect()}
    assert set(got) == {("p", i) for i in range(4)} | {("q", 0)} and got["q", 0] == float("inf")
    for it in range(4):
        a, b = ([x for _, i, s, x in data[:72] if i == it and s == side] for side in "AB")
        ds = [d[y] for x in a for d in [plain_distances(pairs, [x])] for y in b if y in d]
        assert got["p", it] == pytest.approx(sum(ds) / len(ds))


def test_sets_as_bits(spark):
    sets = table(spark, "grp string, item string", *[(f"g{g}", f"i{i}") for g in range(5) for i in range(0, 200, g + 1)])
    numbers = bits.number(sets.select("item"))
    assert rows(bits.unpack(bits.pack(sets.unionByName(sets), numbers, "grp"), numbers)) == rows(sets)


# ---- draws


def test_draws_are_complete_under_any_bound(spark):
    nodes = table(spark, "node string", *[(f"n{i:03d}",) for i in range(300)])
    whole = rows(sampling.uniform(nodes, {"A": 40, "B": 7}, 5, 1, most=1e9))
    assert len(whole) == 5 * 47 and rows(sampling.uniform(nodes, {"A": 40, "B": 7}, 5, 1, most=0.0, more=1)) == whole
    assert rows(sampling.uniform(nodes, {"A": 40, "B": 7}, 5, 1, most=0.9, more=0)) == whole
    assert len(rows(sampling.uniform(nodes, {"A": 400}, 2, 1))) == 600 and rows(sampling.uniform(nodes.where("false"), {"A": 4}, 2, 1)) == []


# ---- references


def test_a_record_with_very_many_lives(spark):
    day = lambda n: datetime(2000, 1, 1) + timedelta(days=n)
    records = [("e", "A", day(3 * i), day(3 * i + 2)) for i in range(3000)] + [("e", "B", day(0), day(5)), ("e", "B", day(1), day(2)), ("e", "B", day(5), day(6)), ("e", "B", None, day(9))]
    found = {r["key"]: r for r in orphans.lives(table(spark, "scope string, key string, added_at timestamp, deleted_at timestamp", *records)).collect()}
    assert len(found["A"]["spans"]) == 3000 and found["A"]["first_added"] == day(0)
    assert [tuple(s) for s in found["B"]["spans"]] == [(day(0), day(6))] and found["B"]["first_added"] is None
    refs = [("A", i, day(i)) for i in range(0, 9000, 7)]
    got = orphans.orphan_references(table(spark, "key string, row_no int, t timestamp", *refs).withColumn("scope", F.lit("e")), table(spark, "scope string, key string, added_at timestamp, deleted_at timestamp", *records))
    assert rows(got.select("row_no", "reason")) == sorted(((i, "deleted") for i in range(0, 9000, 7) if i % 3 == 2), key=str)


# ---- files, codes, names


def test_the_header_goes_by_its_place(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    text = w("p.txt", "\nprotein1 protein2  combined_score\nprotein1 x 900\n\ta\tb 800 \nprotein1 protein2 combined_score\n")
    assert rows(files.read_delimited_spaces(spark, text)) == [("a", "b", "800"), ("protein1", "protein2", "combined_score"), ("protein1", "x", "900")]
    assert rows(files.read_ppi(spark, text)) == [("a", "b", 800), ("protein1", "x", 900)]
    assert rows(files.read_delimited(spark, w("q.csv", 'a,b\n"x\ny",1\n'), multi_line=True)) == [("x\ny", "1")]


def test_headers_of_cross_references(spark, tmp_path):
    for i, head in enumerate(("Ensembl Gene ID,Ensembl Protein ID", "Gene ID,Protein ID", "Gene stable ID,Protein stable ID", "ENSG,x ensp y")):
        (tmp_path / f"{i}.csv").write_text(f"{head}\nENSG1,ENSP1\n")
        assert rows(files.read_xref(spark, str(tmp_path / f"{i}.csv"))) == [("ENSG1", "ENSP1", None, None)]


def test_pair_tables_in_order(spark):
    t = lambda *c: table(spark, ", ".join(f"{x} string" for x in c), tuple(c))
    assert rows(files.scan_pairs({"edges": t("source", "target"), "human_ppi": t("node1", "node2", "source", "target")})) == [("node1", "node2")]
    assert rows(files.scan_pairs({"String_PPI": t("a", "b"), "human_ppi": t("node1", "node2")})) == [("a", "b")]


def test_codes_in_both_orders(spark, tmp_path):
    (tmp_path / "c.txt").write_text("HERB7\n")
    got = payload.code_list(spark, "HERB", "HERB1", ["HERB2"], str(tmp_path / "c.txt"), "4-3", code_last=True).orderBy("part", "pos")
    assert [r["code"] for r in got.collect()] == ["HERB2", "HERB7", "HERB000003", "HERB000004", "HERB1"]
    with pytest.raises(ValueError):
        payload.code_list(spark, "HERB")


def test_the_original_table_is_dropped(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    table(spark, "x int", (1,)).write.parquet(old)
    sinks.replace(spark.read.parquet(old), new, original=old)
    assert rows(spark.read.parquet(new)) == [(1,)] and not sinks.exists(spark, old)


# ---- resolution and SES


def test_raw_edges_by_name(spark):
    e = table(spark, "node_1 string, node_2 string, tp string", ("HBIN1", "HBTAR1", "Ingredient–Target"), (" ren Shen", "HBTAR2", "ingredient-target"), ("HBTAR3", "hbin1", None), ("HBIN1", "Ren shen", "Ingredient x Target"), ("HBIN1", None, "ingredient target"))
    names = table(spark, "query string, name string", ("q", "HBIN1"), ("q", "REN SHEN "), ("q", None))
    assert rows(resolve.raw_ends(names, e, "%ingredient%target%")) == [("q", "HBTAR1"), ("q", "HBTAR2"), ("q", "REN SHEN")]
    assert rows(resolve.raw_ends(names, e.drop("tp"), "%ingredient%target%")) == [("q", "HBTAR1"), ("q", "HBTAR2"), ("q", "HBTAR3"), ("q", "REN SHEN")]


def test_ids_pass_through_without_a_table(spark):
    ids = table(spark, "id string", (" ensg1.2 ",), (None,), ("ENSG1",), ("",))
    assert rows(resolve.map_ids(ids, "id", None, "ensg", "ensp")) == [("ENSG1", "ENSG1", None, None)]


def test_herbs_share_what_their_ingredients_reach(spark):
    pairs = [("Herb–Ingredient", f"HERB{h}", f"HBIN{i}") for h in range(4) for i in range(h, 6)] + [("Ingredient–Target", f"HBIN{i}", f"HBTAR{t}") for i in range(6) for t in range(0, 90, i + 1)]
    kinds = edges.node_kinds({"Herb": table(spark, "herb_id string", *[(f"HERB{h}",) for h in range(4)])})
    targets = table(spark, "target_id string, ensembl_id string", *[(f"HBTAR{t}", f"ENSG{t}") for t in range(90)])
    xref = table(spark, "ensg string, ensp string", *[(f"ENSG{t}", f"ENSP{t}") for t in range(90)])
    r = resolve.Resolver(table(spark, "tp string, node_1 string, node_2 string", *pairs), kinds, targets, xref)
    seeds = table(spark, "query string, id string", *[(f"HERB{h}", f"HERB{h}") for h in range(4)])
    want = sorted({(f"HERB{h}", f"ENSP{t}") for h in range(4) for i in range(h, 6) for t in range(0, 90, i + 1)}, key=str)
    assert rows(r.herbs(seeds, ("ensp",))) == want and rows(r.herbs(seeds).select("query", "ensp")) == want
    assert rows(r.herbs(seeds.where("false"))) == []


def test_presets_and_texts(spark):
    assert ses.PRESETS["functional"] == [*ses.PRESETS["go"], *ses.PRESETS["pathways"]] and ses.PRESETS["all"] is None
    got = table(spark, "category string", ("KEGG",), ("Component",), ("PMID",), (None,))
    assert rows(ses.allowed(got, ses.PRESETS["functional"])) == [("Component",), ("KEGG",)] and len(rows(ses.allowed(got, ses.PRESETS["all"]))) == 3
    sets = table(spark, "set_id string, gene string", ("s", "b"), ("s", "a"), ("s", "b"), ("s", None), (None, "a"))
    assert rows(ses.joined_ids(sets)) == [("s", "a\rb")]


@pytest.mark.parametrize("name", sorted(set(files_io.QUERIES) - {"sink_distance_cache"}))
def test_tables_come_back(spark, name):
    df = files_io.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not df.isEmpty()


def test_p_values_below_the_least_double_still_rank(spark):
    from rootweave.operators import enrich

    # k shared genes of sets and terms of 300 among 100,000: all p underflow, yet more shared genes rank first.
    t = table(spark, "set_id string, category string, term string, k int, m int, n int, total int, n_tests int", *[("s", "c", f"t{300 - k}", k, 300, 300, 100_000, 3) for k in (250, 270, 299)])
    t = t.withColumn("log_p", enrich.hypergeom_log_tail("k", "m", "n", "total")).withColumn("p", F.coalesce(F.exp("log_p"), F.lit(0.0)))
    top = enrich.top_terms(enrich.adjust(t))
    assert [r["k"] for r in top.orderBy("place").collect()] == [299, 270, 250] and all(r["p"] < 1e-300 for r in top.collect())
