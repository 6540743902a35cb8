"""Findings of the second round's check."""

import glob

import pyarrow.parquet as pq
import pytest

from rootweave.operators import edges, resolve, unions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


@pytest.fixture
def hubs(spark, monkeypatch):
    """A resolver whose first ingredients are hubs over several blocks, with seeds of all kinds, and the rows of all of them."""
    monkeypatch.setattr(unions, "HUB", 30)
    monkeypatch.setattr(unions, "BLOCK", 16)
    kinds = edges.node_kinds({
        "Herb": table(spark, "herb_id string", *[(f"HERB{h}",) for h in range(5)]),
        "Ingredient": table(spark, "ingredient_id string", *[(f"HBIN{i}",) for i in range(6)]),
        "Disease": table(spark, "disease_id string", ("HBDIS1",)),
        "Target": table(spark, "target_id string", *[(f"HBTAR{t}",) for t in range(90)]),
    })
    drugs = {h: range(h, 6) for h in range(4)}
    targets = {i: range(0, 90, i + 1) for i in range(6)}
    pairs = [("Herb–Ingredient", f"HERB{h}", f"HBIN{i}") for h in drugs for i in drugs[h]] + [("Ingredient–Target", f"HBIN{i}", f"HBTAR{t}") for i in targets for t in targets[i]]
    pairs += [("Target–Disease", f"HBTAR{t}", "HBDIS1") for t in range(80, 90)]
    # Two targets share a gene and the proteins of every third gene are two, so genes and proteins differ in number.
    gene = lambda t: f"ENSG{t // 2}"
    proteins = {gene(t): [f"ENSP{t // 2}", f"ENSP{t // 2}00"][: 2 if t // 2 % 3 == 0 else 1] for t in range(90)}
    r = resolve.Resolver(
        table(spark, "tp string, node_1 string, node_2 string", *pairs), kinds,
        table(spark, "target_id string, ensembl_id string", *[(f"HBTAR{t}", gene(t)) for t in range(90)]),
        table(spark, "ensg string, ensp string", *[(g, p) for g in proteins for p in proteins[g]]),
    )
    reach = {f"HERB{h}": {t for i in drugs[h] for t in targets[i]} for h in drugs} | {f"HBIN{i}": set(targets[i]) for i in targets} | {"HBDIS1": set(range(80, 90))}
    want = sorted({(q, gene(t), p) for q in reach for t in reach[q] for p in proteins[gene(t)]}, key=str)
    return r, table(spark, "query string, id string", *[(x, x) for x in [*reach, "HERB4", "HBFO1"]]), want


def test_stats_without_rows(spark, hubs, monkeypatch):
    r, seeds, want = hubs
    monkeypatch.setattr(resolve.Resolver, "route", lambda *_: pytest.fail("the rows of all resolved ids are listed"))
    stats = sorted(((q, len({g for x, g, _ in want if x == q}), len({p for x, _, p in want if x == q})) for q in {x[0] for x in want}), key=str)
    assert rows(r.stats(seeds)) == stats
    monkeypatch.setattr(unions, "MOST_MEMBERS", 100)  # one hub only, the others go as rows
    assert rows(r.stats(seeds)) == stats
    monkeypatch.setattr(unions, "HUB", 1000)  # no hub at all
    assert rows(r.stats(seeds)) == stats


def no_join_by_number(df):
    """Whether the rows of a union leave the tasks that make them without another shuffle or a sorted join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0]


def test_herbs_as_unions(spark, hubs):
    r, seeds, want = hubs
    of = [x for x in want if x[0].startswith("HERB")]
    herbs = seeds.where("id like 'HERB%'")
    assert rows(r.herbs(herbs, ("ensp",))) == sorted({(q, p) for q, _, p in of}, key=str)
    assert no_join_by_number(r.herbs(herbs, ("ensp",)))


def test_names_of_several_herbs(spark, hubs):
    r, _, want = hubs
    both = table(spark, "query string, id string", ("a name", "HERB1"), ("a name", "HERB3"), ("another", "HERB2"))
    of = {"HERB1": ["a name"], "HERB3": ["a name"], "HERB2": ["another"]}
    named = r.herbs(both, ("ensp",))
    assert rows(named) == sorted({(n, p) for q, _, p in want for n in of.get(q, [])}, key=str)
    assert no_join_by_number(named)


def test_route_as_one_union(spark, hubs):
    r, seeds, want = hubs
    routed = r.route(seeds)
    assert rows(routed) == want and no_join_by_number(routed)
    mixed = seeds.where("id in ('HERB1', 'HBIN0', 'HBDIS1')").selectExpr("'all' query", "id")
    assert rows(r.route(mixed)) == sorted({("all", g, p) for q, g, p in want if q in ("HERB1", "HBIN0", "HBDIS1")}, key=str)


def test_unions_are_written_with_a_dictionary(spark, tmp_path):
    """Queries with more members than a file's first page has rows, over two blocks."""
    named = spark.range(24).selectExpr("'name ' || id query", "explode(array('big', 'small')) node")
    sets = spark.range(40_000).selectExpr("'big' node", "'ENSP' || lpad(id, 11, '0') ensp").unionByName(spark.createDataFrame([("small", "ENSP00000000007"), ("small", "ENSPx")], "node string, ensp string"))
    u = unions.Unions(named, sets)
    assert len(u.hubs) == 1
    u.rows().write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 24 * 40_001
    assert rows(u.counts()) == sorted(((f"name {i}", 40_001) for i in range(24)), key=str)
    assert got.groupBy("query").count().where("count <> 40001").isEmpty() and got.select("ensp").distinct().join(sets, "ensp", "left_anti").isEmpty()
    for f in glob.glob(str(tmp_path / "out/*.parquet")):
        groups = pq.ParquetFile(f).metadata
        for g in (groups.row_group(i) for i in range(groups.num_row_groups)):
            assert g.num_rows < 10_000 or g.column(1).has_dictionary_page and "PLAIN" not in g.column(1).encodings
