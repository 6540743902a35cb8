import json
import math
import random
from collections import defaultdict, deque
from math import comb

import pytest
from pyspark.sql import functions as F

from rootweave.operators import adme, edges, enrich, graph, proximity, resolve, sampling, ses
from rootweave.sources import files, payload, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def simple(spark, pairs):
    return graph.simple_graph(spark.createDataFrame(pairs, "a string, b string"))


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_degrees(spark):
    loop = [("a", "a"), ("a", "b")]
    assert rows(graph.degrees(simple(spark, loop))) == [("a", 3), ("b", 1)]
    dup = [("a", "b"), ("b", "a"), ("a", "b"), (None, "a")]
    assert rows(graph.degrees(simple(spark, dup))) == [("a", 1), ("b", 1)]
    assert rows(graph.degrees(spark.createDataFrame(dup[:3], "a string, b string"))) == [("a", 3), ("b", 3)]
    star = simple(spark, [("h", str(i)) for i in range(5)])
    assert rows(graph.degree_buckets(graph.degrees(star)))[-1] == ("h", 5, 0, 1)
    assert sorted(r["idx"] for r in graph.degree_buckets(graph.degrees(star)).where("degree = 1").collect()) == [0, 1, 2, 3, 4]
    assert graph.degrees(simple(spark, [])).count() == 0


def test_set_distances(spark):
    g = simple(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")])
    run = lambda a, b: graph.set_distances(graph.distances(g, nodes(spark, *a, *b).distinct()), nodes(spark, *a), nodes(spark, *b)).first()
    r = run("a", "cd")
    assert r["closest_directed"] == 2 and r["mean_all_pairs"] == 2.5 and r["shortest"] == 2.5
    assert r["closest"] == pytest.approx((2 + 2 + 3) / 3) and r["separation"] == pytest.approx(7 / 3 - (0 + 1) / 2)
    assert run("ab", "b")["closest_directed"] == 0.5
    r = run("a", "x")
    assert math.isinf(r["closest"]) and math.isinf(r["closest_directed"]) and math.isinf(r["shortest"])
    pairs = spark.createDataFrame([("a", "d"), ("a", "x"), ("a", "?")], "x string, y string")
    assert rows(graph.look_up(graph.distances(g, nodes(spark, "a")), pairs)) == [("a", "?", math.inf), ("a", "d", 3.0), ("a", "x", math.inf)]
    assert rows(graph.missing_sources(graph.distances(g, nodes(spark, "a")), nodes(spark, "a", "b"))) == [("b",)]


def plain_bfs(adj, starts):
    d, q = {s: 0 for s in starts}, deque(starts)
    while q:
        n = q.popleft()
        for m in adj[n]:
            if m not in d:
                d[m] = d[n] + 1
                q.append(m)
    return d


def test_bfs_against_plain(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("n0", f"n{i}") for i in range(20)]
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    g, starts = simple(spark, pairs), {"k1": ["n1", "n2"], "k2": ["n50"]}
    seeds = spark.createDataFrame([(k, n) for k, ns in starts.items() for n in ns], "key string, node string")
    want = sorted(((k, n, d) for k, ns in starts.items() for n, d in plain_bfs(adj, ns).items()), key=str)
    assert rows(graph.bfs(graph.neighbours(g), seeds)) == want


def test_proximity(spark):
    pairs = [(f"n{i}", f"n{(i * 7 + 3) % 40}") for i in range(40)] + [(f"n{i}", f"n{i + 1}") for i in range(39)]
    g = simple(spark, pairs)
    sets = spark.createDataFrame([("p", "A", "n1"), ("p", "A", "n5"), ("p", "B", "n9"), ("p", "B", "gone"), ("q", "A", "n1")], "pair string, side string, node string")
    drawn = proximity.samples(g, sets, 20, 1)
    deg = {r["node"]: r["degree"] for r in graph.degrees(g).collect()}
    for side, n in (("A", "n1"), ("B", "n9")):
        assert {deg[r["node"]] for r in drawn.where((F.col("side") == side) & (F.col("pair") == "p") & (F.col("it") > 0)).collect()} <= {deg["n1"], deg["n5"], deg["n9"]}
    r = proximity.proximity(g, sets, 20, 1)
    assert r.count() == 1 and r.where("pair = 'p'").first()["n"] == 20
    p = r.where("pair = 'p'").first()
    assert 0 <= p["p"] <= 1 and p["z"] == pytest.approx((p["d"] - p["mean"]) / p["std"])
    values = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, math.inf)], "pair string, it int, d double")
    assert rows(proximity.summary(values)) == [("a", 2.0, 0.0, 2.0, 0.0, 1.0, 2)]


def test_sampling(spark):
    background = nodes(spark, *[f"b{i}" for i in range(500)])
    out = sampling.uniform(background, {"A": 5, "B": 30}, 8, 3)
    n = {(r["side"], r["it"]): (r["n"], r["d"]) for r in out.groupBy("side", "it").agg(F.count("*").alias("n"), F.count_distinct("node").alias("d")).collect()}
    assert len(n) == 16 and all(v == ((5, 5) if k[0] == "A" else (30, 30)) for k, v in n.items())
    bins = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 3)], "node string, bin int")
    targets = spark.createDataFrame([("A", "x", 0), ("A", "y", 0), ("A", "z", 3)], "side string, node string, bin int")
    got = [r["node"] for r in sampling.bin_matched(targets, bins, 1, 1).collect()]
    assert len(got) == 3 and "a" in got and "d" in got and set(got) & {"b", "c"}


def tail(k, m, n, total):
    return 0.0 if k > n or k > m else sum(comb(m, i) * comb(total - m, n - i) for i in range(k, min(m, n) + 1)) / comb(total, n)


def test_hypergeom(spark):
    cases = [(5, 5, 5, 9), (1, 5, 5, 9), (0, 3, 2, 9), (3, 2, 5, 9), (2, 8, 8, 10), (6, 40, 60, 500), (30, 400, 900, 16000), (1, 1, 1, 1)]
    df = spark.createDataFrame(cases, "k int, m int, n int, total int").withColumn("p", enrich.hypergeom_tail("k", "m", "n", "total"))
    for r in df.collect():
        assert r["p"] == pytest.approx(tail(r["k"], r["m"], r["n"], r["total"]), rel=1e-9, abs=1e-300)


def test_bh_and_top(spark):
    df = spark.createDataFrame([("s", "c", t, p, 4, 1) for t, p in zip("abcd", (0.01, 0.02, 0.03, 0.5))], "set_id string, category string, term string, p double, n_tests int, k int")
    q = {r["term"]: r["q"] for r in enrich.adjust(df).collect()}
    assert [round(q[t], 9) for t in "abcd"] == [0.04, 0.04, 0.04, 0.5]
    assert [r["term"] for r in enrich.top_terms(enrich.adjust(df), 2).orderBy("place").collect()] == ["a", "b"]


def test_enrich_against_plain(spark):
    rng = random.Random(1)
    genes = [f"g{i}" for i in range(40)]
    terms = {f"t{i}": set(rng.sample(genes, rng.randrange(1, 12))) for i in range(12)}
    query = set(rng.sample(genes, 9)) | {"outside"}
    sets = spark.createDataFrame([("s", g) for g in query] * 2 + [("s", None)], "set_id string, gene string")
    td = spark.createDataFrame([("c", t, g) for t, gs in terms.items() for g in gs], "category string, term string, gene string")
    total = len(set().union(*terms.values()) | query)
    p = {t: tail(len(query & gs), len(gs), len(query), total) for t, gs in terms.items()}
    order = sorted(p, key=lambda t: (p[t], t))
    q, low = {}, 1.0
    for i in range(len(order), 0, -1):
        low = min(low, p[order[i - 1]] * len(order) / i)
        q[order[i - 1]] = low
    got = {r["term"]: r for r in enrich.enrich(sets, td).collect()}
    assert set(got) == {t for t in terms if terms[t] & query}
    for t, r in got.items():
        assert r["p"] == pytest.approx(p[t], rel=1e-9) and r["q"] == pytest.approx(q[t], rel=1e-9)


def plain_ses(a, b):
    n = min(len(a), len(b))
    return sum(len(set(a[:k]) & set(b[:k])) / len(set(a[:k]) | set(b[:k])) for k in range(1, n + 1)) / n if n else 0.0


def test_ses(spark):
    rng = random.Random(2)
    lists = {"x": (["t1", "t2", "t3"], ["t1", "t3", "t4"]), "none": (["a"], []), "same": (["a", "b"], ["a", "b"])}
    lists |= {f"r{i}": (rng.sample("abcdefghij", rng.randrange(1, 9)), rng.sample("abcdefghij", rng.randrange(1, 9))) for i in range(20)}
    data = [(g, s, k, i) for g, (a, b) in lists.items() for s, ks in (("A", a), ("B", b)) for i, k in enumerate(ks, 1)]
    got = {r["g"]: r["ses"] for r in ses.ses(spark.createDataFrame(data, "g string, side string, key string, place int"), ("g",)).collect()}
    assert got["x"] == pytest.approx((1 + 1 / 3 + 2 / 4) / 3) and got["same"] == 1.0
    assert all(got[g] == pytest.approx(plain_ses(a, b)) for g, (a, b) in lists.items())


def test_ses_summaries(spark):
    scores = spark.createDataFrame([(0, c, s, 20) for c, s in zip("abcd", (0.0294, 0.1446, 0.1371, 0.1555))] + [(1, "a", 0.0, 0)], "it int, category string, ses double, n_terms int")
    got = {r["it"]: (r["ses"], r["n_total"]) for r in ses.combine(scores, ("it",)).collect()}
    assert got[0] == (pytest.approx(0.11665), 80) and got[1] == (0.0, 0)
    values = spark.createDataFrame([("p", i, v) for i, v in enumerate([0.3, 0.3, 0.1, 0.2])] + [("q", 0, 0.1), ("o", 0, 0.1), ("o", 1, 0.0)], "pair string, it int, ses double")
    got = {r["pair"]: r for r in ses.null_summary(values, ("pair",)).collect()}
    assert got["p"]["p_emp"] == 0.5 and got["p"]["null_std"] == pytest.approx(0.1) and got["q"]["p_emp"] == 1.0 and got["o"]["null_std"] == 0.0
    res = spark.createDataFrame([("s", "KEGG", " ", "n", None, 0.2), ("s", "pmid", "i", "n", 0.1, 0.1), ("s", None, "i", None, float("nan"), 0.1)], "set_id string, category string, term_id string, term string, fdr double, p_value double")
    assert rows(ses.rank_terms(ses.allowed(res).withColumn("key", ses.term_key()), ("set_id",), q_cut=1.0).select("key", "place")) == [("KEGG:n", 1)]
    assert ses.allowed(res, ["kegg"]).count() == 1


def small_world(spark):
    kinds = spark.createDataFrame([("HERB1", "Herb"), ("HBIN1", "Ingredient"), ("HBIN2", "Ingredient"), ("HBTAR1", "Target"), ("HBDIS1", "Disease"), ("HBFO1", "Formula")], "id string, kind string")
    pairs = [("HBIN1", "herb1 "), ("HERB1", "HBIN1"), ("HERB1", "HERB1"), ("HBTAR1", "HBIN1"), ("HBIN2", "HBTAR1"), ("HBDIS1", "HBTAR1"), ("HBFO1", "HERB1"), ("HBFO1", "HBDIS1"), (None, "HERB1"), ("", "x")]
    return spark.createDataFrame(pairs, "node_1 string, node_2 string"), kinds


def test_edges_and_resolution(spark):
    e, kinds = small_world(spark)
    clean = edges.clean_edges(e, kinds)
    assert rows(clean) == [("Formula–Herb", "HBFO1", "HERB1"), ("Herb–Ingredient", "HBIN1", "HERB1"), ("Ingredient–Target", "HBIN1", "HBTAR1"), ("Ingredient–Target", "HBIN2", "HBTAR1"), ("Target–Disease", "HBDIS1", "HBTAR1")]
    assert rows(edges.merge_edges(clean.select("node_1", "node_2"), clean.select("node_1", "node_2"))) == rows(clean.select("node_1", "node_2"))
    metrics = {c: "1" for c in adme.STRICT} | {"ob_score": "45", "drug_likeness": "0.2"}
    drugs = spark.createDataFrame([("hbin1", *metrics.values()), ("HBIN2", "45", None, "", "1", "1", "1", "1")], "ingredient_id string, " + ", ".join(f"{c} string" for c in metrics))
    assert rows(edges.clean_edges(e, kinds, drugs)) == [r for r in rows(clean) if "HBIN2" not in r]
    checked = {r["ingredient_id"]: r for r in adme.profile_check(drugs).collect()}
    assert checked["HBIN2"]["eligible"] and checked["HBIN2"]["fails"] == []
    worse = drugs.withColumn("ob_score", F.lit("1")).withColumn("molwt", F.lit("900")).withColumn("numhdonors", F.lit("9"))
    assert adme.profile_check(worse, "BALANCED ").first()["fails"] == ["OB_score<30.0", "Lipinski_violations>1"]
    assert adme.profile_check(worse, "lenient").first()["fails"] == ["OB_score<20.0"]
    other = drugs.where("false").unionByName(drugs.where("ingredient_id = 'HBIN2'")).drop("molwt")
    ids = spark.createDataFrame([("HBIN1",), ("HBIN2",), ("HBIN3",)], "ingredient_id string")
    got = {r["ingredient_id"]: r["molwt"] for r in adme.metrics_with_fallback(ids, drugs.where("ingredient_id = 'hbin1'"), other).collect()}
    assert got == {"HBIN1": "1", "HBIN2": None}
    targets = spark.createDataFrame([("HBTAR1", "ENSG1.5"), ("HBTAR2", None)], "target_id string, ensembl_id string")
    xref = spark.createDataFrame([("ensg1", "ENSP1.2", "S", "nan"), ("ENSG1", "ENSP2", None, ""), ("ENSG1.9", "ENSP1", "A", "P1"), ("x", "ENSP3", None, None)], "ensg string, ensp string, hgnc_symbol string, uniprot string")
    assert rows(resolve.clean_xref(xref)) == [("ENSG1", "ENSP1", "A", "P1"), ("ENSG1", "ENSP2", None, None)]
    r = resolve.Resolver(clean, kinds, targets, xref)
    seeds = spark.createDataFrame([(x, x) for x in ("HERB1", "HBIN2", "HBDIS1", "HBFO1", "nothing")], "query string, id string")
    assert rows(r.route(seeds).select("query", "ensp")) == [(q, p) for q in ("HBDIS1", "HBIN2", "HERB1") for p in ("ENSP1", "ENSP2")]
    assert rows(resolve.resolution_stats(r.route(seeds)))[0] == ("HBDIS1", 1, 2)
    assert r.route(seeds.where("false")).count() == 0
    names = spark.createDataFrame([("HERB1", " Ren Shen", None), ("HERB2", "x", "ren shen")], "herb_id string, a string, b string")
    queries = spark.createDataFrame([("REN SHEN",), ("herb2",), ("none",)], "query string")
    assert rows(resolve.lookup(names, "herb_id", ["a", "b"], queries)) == [("REN SHEN", "HERB1"), ("REN SHEN", "HERB2"), ("herb2", "HERB2")]
    assert rows(resolve.lookup_like(names, "herb_id", ["a", "b"], "N SH")) == [("N SH", "HERB1"), ("N SH", "HERB2")]


def test_first_and_merge(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 0, "z")], "k string, pos int, v string")
    assert rows(resolve.first_by_position(df, "k", "pos")) == [("a", 1, "y"), ("b", 1, None)]
    assert rows(resolve.merge_first(df.where("k is not null"), df.where("k = 'a'"), "k", "v")) == [("a", "x"), ("b", "b")]
    g = simple(spark, [("a", "b")])
    assert graph.same_nodes(g, graph.distances(g, nodes(spark, "a"))) and not graph.same_nodes(simple(spark, [("a", "c")]), graph.distances(g, nodes(spark, "a")))


def test_payloads_and_codes(spark, tmp_path):
    text = json.dumps({"a": [{"HBIN000001": "see HBTAR000002, hbin3 and HBXX1"}], "b": "HERB000001"})
    p = spark.createDataFrame([("HBFO1", text), ("HBFO2", None), (None, text)], "code string, payload string")
    assert rows(payload.payload_ids(p.where("code is not null"))) == [("HBFO1", "HBIN000001"), ("HBFO1", "HBTAR000002")]
    assert rows(payload.per_code(p)) == [("HBFO1", 2), ("HBFO2", 0)]
    assert [r[0] for r in payload.code_range(spark, "HB", 1000001, 999999).orderBy("code").collect()] == ["HB1000000", "HB1000001", "HB999999"]
    f = tmp_path / "codes.txt"
    f.write_text("# c\n\nHERB3\n")
    got = payload.code_list(spark, "HERB", "HERB1", ["HERB1"], str(f), "4-5").orderBy("part", "pos").collect()
    assert [r["code"] for r in got] == ["HERB1", "HERB1", "HERB3", "HERB000004", "HERB000005"]


def test_sinks_and_stream(spark, tmp_path):
    from rootweave.streaming.edges import grow_edges, payload_stream

    table = str(tmp_path / "edges")
    pairs = lambda *x: spark.createDataFrame(x, "node_1 string, node_2 string")
    sinks.flush_edges(pairs(("B", "a"), ("A", "B")), table)
    sinks.flush_edges(pairs(("C", "C"), ("B", "A")), table)
    assert rows(spark.read.parquet(table)) == [("A", "B"), ("C", "C")]
    keyed = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(keyed, str(tmp_path / "t"), ["k"])
    assert rows(sinks.append_new(keyed.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), str(tmp_path / "t"), ["k"])) in ([], [(3, "c")])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert rows(sinks.duplicates(keyed.unionByName(keyed), ["k"])) == [(1, 2), (2, 2)]
    g = simple(spark, [("a", "b"), ("b", "c")])
    assert sinks.extend_distances(g, nodes(spark, "a"), str(tmp_path / "d")).count() == 3
    assert sinks.extend_distances(g, nodes(spark, "a", "b"), str(tmp_path / "d")).count() == 6
    sinks.to_json_lines(keyed, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"code": "HERB1", "payload": '["HBIN1"]'}) + "\n")
    q = grow_edges(payload_stream(spark, str(tmp_path / "in")), str(tmp_path / "grown"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "grown"))) == [("HBIN1", "HERB1")]


def test_files(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    ppi = w("ppi.txt", "protein1 protein2 combined_score\n9606.ENSP1   9606.ENSP2 700\n9606.ENSP1 9606.ENSP3 699\n\nx y z\n")
    assert rows(files.read_ppi(spark, ppi)) == [("9606.ENSP1", "9606.ENSP2", 700)]
    a = w("HERB_herb_info_1.csv", "﻿Herb_id,Name\nHERB1, n \nHERB1,n\nHERB2,\n")
    b = w("x_herb_info_2.txt", "Herb_id\tOther\nHERB3\to\n")
    w("skip_me.csv", "a,b\n1,2\n")
    got = files.read_directory(spark, [a, b, str(tmp_path / "skip_me.csv")])
    assert list(got) == ["Herb_info"] and rows(got["Herb_info"]) == [("HERB1", "n", None), ("HERB2", None, None), ("HERB3", None, "o")]
    assert files.kind_of("a/x_disease_target.csv") == "disease" and files.kind_of("total.csv") is None
    gmt = w("t.gmt", "t1\td\tENSG1.2\tENSG1\tX\nt2\td\nt3\td\tX\nt1\td\tENSG5\n")
    assert rows(files.read_gmt(spark, gmt)) == [("t1", "ENSG5")]
    assert rows(files.read_gmt(spark, gmt, drop_empty=False)) == [("t1", "ENSG5"), ("t3", None)]
    assert rows(files.term_genes(spark, {"t": {"a", "b"}})) == [("t", "a"), ("t", "b")]
    xref = w("x.csv", "Gene stable ID,Protein stable ID,HGNC symbol\nENSG1,ENSP1,S\n")
    assert rows(files.read_xref(spark, xref)) == [("ENSG1", "ENSP1", "S", None)]
    with pytest.raises(ValueError):
        files.read_xref(spark, str(tmp_path / "skip_me.csv"))
    assert files.guess_column(["My Gene", "GENE"], ["gene"]) == "GENE" and files.guess_key(["x", "Herb_id"], "herb") == "Herb_id"
    assert rows(files.read_edge_list(spark, w("e.txt", "# c\na b\nb,a\n\n"))) == [("a", "b")]
    assert rows(files.scan_pairs({"Human_PPI": spark.createDataFrame([(1, "p", "q")], "i int, Protein1 string, protein2 string")})) == [("p", "q")]
    with pytest.raises(ValueError):
        files.scan_pairs({"other": spark.range(1)})
    assert files.has_header(spark, ppi, b"prot") and not files.has_header(spark, ppi, b"SQL")
    assert rows(files.read_edges(spark, w("e.csv", "Node_1,Node_2\na,\na,\n"))) == [("a", None), ("a", None)]
