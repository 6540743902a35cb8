"""Distances over all pairs of two sets without a row for each (findings F3 and F6)."""

import random
from collections import Counter

import pytest

from rootweave.operators import graph, pairs, proximity


def table(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


@pytest.fixture
def hubbed(spark, monkeypatch):
    """Edges of a graph with three hubs, small parts that hang on them or on nothing, a long chain and a loop; and its table."""
    monkeypatch.setattr(pairs, "HUB", 12)
    monkeypatch.setattr(pairs, "PARTS", 3)
    rng = random.Random(4)
    near = [(f"h{k % 3}", f"n{rng.randrange(80):02d}") for k in range(90)] + [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(0, 78, 2)]
    near += [(f"n{k:02d}", f"n{k + 3:02d}") for k in range(0, 70, 12)] + [(f"c{k}", f"c{k + 1}") for k in range(8)] + [("n05", "c0"), ("x", "y"), ("y", "z"), ("n07", "n07")]
    g = graph.simple_graph(table(spark, "a string, b string", *near))
    assert set(pairs.hubs(g)) == {"h0", "h1", "h2"}
    return near, g


def plain_distances(edges, start):
    d, front = {start: 0}, [start]
    while front:
        front = [y for x in front for e in edges if x in e for y in e if y not in d and not d.update({y: d[x] + 1})]
    return d


def sampled(near):
    rng = random.Random(5)
    every = sorted({x for e in near for x in e}) + ["nowhere"]
    return [("p", it, s, rng.choice(every)) for it in range(3) for s in "AB" for _ in range(25)] + [("q", 0, "A", "x"), ("q", 0, "B", "n00"), ("r", 0, "A", "x"), ("t", 0, "A", "h0"), ("t", 0, "B", "h0")]


def test_mean_over_all_pairs_by_hubs(spark, hubbed, monkeypatch):
    near, g = hubbed
    data = sampled(near)
    monkeypatch.setattr(pairs, "_of_bits", lambda *_: pytest.fail("one search for every node of side A"))
    got = {(r["pair"], r["it"]): r["d"] for r in proximity.mean_all_pairs(g, table(spark, "pair string, it int, side string, node string", *data)).collect()}
    assert set(got) == {("p", i) for i in range(3)} | {("q", 0), ("t", 0)} and got["q", 0] == float("inf") and got["t", 0] == 0
    for it in range(3):
        a, b = ([x for p, i, s, x in data if (p, i, s) == ("p", it, side)] for side in "AB")
        ds = [d[y] for x in a for d in [plain_distances(near, x)] for y in b if y in d]
        assert got["p", it] == pytest.approx(sum(ds) / len(ds), abs=1e-12)


def test_sums_by_hubs_as_by_bits(spark, hubbed):
    near, g = hubbed
    times = Counter(sampled(near))
    s = table(spark, "pair string, it int, side string, node string, times bigint", *[(*k, n) for k, n in times.items()])
    found = lambda df: sorted(tuple(r) for r in df.where("n > 0").collect())
    assert found(pairs.sums(g, s)) == found(pairs._of_bits(g, s))


def test_graph_that_stays_whole_has_no_hubs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HUB", 12)
    rng = random.Random(6)
    dense = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(300)]
    assert pairs.hubs(graph.simple_graph(table(spark, "a string, b string", *dense))) == []
    assert pairs.hubs(graph.simple_graph(table(spark, "a string, b string", *[("h", f"n{k}") for k in range(20)]))) == ["h"]
    assert pairs.hubs(graph.simple_graph(table(spark, "a string, b string"))) == []


def test_set_distances_without_rows_of_all_nodes(spark, hubbed, monkeypatch):
    near, g = hubbed
    rng = random.Random(7)
    every = sorted({x for e in near for x in e} - {"x", "y", "z"})
    sets = lambda *xs: table(spark, "node string", *[(x,) for x in xs])
    monkeypatch.setattr(graph, "distances", lambda *_: pytest.fail("rows of all nodes"))
    mean = lambda xs: sum(xs) / len(xs)
    inf = float("inf")
    for a, b in [(rng.sample(every, 20), rng.sample(every, 30)), (["x", "n01", "n05"], ["z"])]:
        d = {x: plain_distances(near, x) for x in {*a, *b}}
        low = lambda xs, ys: [min([d[x].get(y, inf) for y in ys if y != x or xs is not ys], default=inf) for x in xs]
        inner = lambda xs: 0 if len(xs) == 1 else mean(low(xs, xs))
        pairs_ = [d[x].get(y, inf) for x in a for y in b]
        ends, there = low(a, b), [x for x in pairs_ if x < inf]
        closest = mean(ends + low(b, a))
        got = pairs.set_distances(g, sets(*a), sets(*b)).first().asDict()
        want = [closest, closest - (inner(a) + inner(b)) / 2, mean(pairs_), mean(there), mean([x for x in ends if x < inf])]
        assert list(got.values()) == pytest.approx(want, nan_ok=True)
