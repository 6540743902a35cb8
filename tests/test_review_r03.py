"""Findings of the third round's check."""

import glob
import os

import pytest

from rootweave.operators import unions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_members_of_shared_sets_take_little_disk(spark, tmp_path):
    """Six sets that overlap, three of them in each query; the result is some hundred times what it is made of."""
    named = spark.range(512).selectExpr("'HERB' || lpad(id, 6, '0') query", "explode(array(pmod(hash(id), 6), pmod(hash(id, 1), 6), pmod(hash(id, 2), 6))) s").selectExpr("query", "'set' || s node").distinct()
    sets = spark.range(6 * 2000).selectExpr("'set' || id % 6 node", "'ENSP' || lpad(pmod(hash(id), 9000), 11, '0') ensp").distinct()
    u = unions.Unions(named, sets)
    u.rows().write.parquet(str(tmp_path / "out"))
    want = named.join(sets, "node").select("query", "ensp").distinct()
    got = spark.read.parquet(str(tmp_path / "out"))
    n = got.count()
    assert n == want.count() > 1_000_000 and got.exceptAll(want).isEmpty()
    assert sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "out/*.parquet"))) < 0.7 * n


@pytest.fixture
def crowded(spark, monkeypatch):
    """Large sets that one query names each, and smaller ones that many name; not all find room as hubs."""
    monkeypatch.setattr(unions, "MOST_MEMBERS", 1000)
    own = spark.range(4).selectExpr("'HBDIS' || id query", "'D' || id node")
    many = spark.range(200).selectExpr("'HERB' || id query", "explode(array('I0', 'I1', 'I' || (id % 20 + 2))) node")
    large = spark.range(2400).selectExpr("'D' || id % 4 node", "'ENSP' || id ensp")
    small = spark.range(600).selectExpr("'I' || id % 2 node", "'ENSP' || id * 2 ensp").unionByName(spark.range(60).selectExpr("'I' || (id % 20 + 2) node", "'ENSP' || id ensp"))
    named, sets = own.unionByName(many), large.unionByName(small)
    return unions.Unions(named, sets), named.join(sets, "node").select("query", "ensp").distinct()


def test_hubs_are_the_sets_that_would_give_most_rows(crowded):
    u, want = crowded
    assert set(u.hubs) == {"I0", "I1"}
    assert u._rows.count() <= 4 * 600 + 200 * 3
    assert rows(u.rows()) == rows(want)


def test_counts_with_crowded_hubs(crowded):
    u, want = crowded
    assert rows(u.counts()) == rows(want.groupBy("query").count())
    assert u._rows.count() <= 4 * 600 + 200 * 3
