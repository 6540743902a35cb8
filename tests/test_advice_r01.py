"""Cases of the first review: each fails on the code before it."""

from datetime import datetime

import pytest

from rootweave.operators import graph
from rootweave.plans import network, quality
from rootweave.sources import payload


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_payload_ids_of_every_prefix_in_any_spelling(spark):
    text = '{"HERB000001":"of hbin000002, HbTar3; HBXX1 HERB1x xHERB2 HERB"}'
    p = spark.createDataFrame([(" hbin000002", text), ("HBFO1", '["HERB000001", "herb000001"]'), (" ", text), (None, text)], "code string, payload string")
    found = rows(payload.payload_ids(p.where("trim(code) <> ''")))
    assert found == [(" hbin000002", "HBIN000002"), (" hbin000002", "HBTAR3"), (" hbin000002", "HERB000001"), ("HBFO1", "HERB000001")]
    assert rows(payload.payload_edges(p)) == [("HBFO1", "HERB000001"), ("HBIN000002", "HBIN000002"), ("HBIN000002", "HBTAR3"), ("HBIN000002", "HERB000001")]
    assert rows(payload.per_code(p.where("trim(code) <> ''"))) == [(" hbin000002", 3), ("HBFO1", 1)]


def test_live_profile_keeps_what_is_deleted_after_the_last_load(spark, tmp_path):
    def live(name, *cells):
        schema = "row_no bigint, load_no int, deleted_at timestamp, numhdonors string, mollogp string, numrotatablebonds string"
        spark.createDataFrame([(i, *c, "1", "1.0", "1") for i, c in enumerate(cells)], schema).write.parquet(str(tmp_path / name / "ingredient_info.parquet"))
        df = quality.p1_live_profile(spark, str(tmp_path / name)).where("col_name = 'mollogp'")
        return rows(df.select("load_no", "cells"))

    late = (1, datetime(2022, 9, 3))
    assert live("eight", (1, None), late, (8, datetime(2022, 10, 1)), (8, datetime(2022, 8, 1))) == [(n, 2) for n in range(1, 8)] + [(8, 3)]
    assert live("nine", (1, None), late, (9, None)) == [(n, 2) for n in range(1, 10)]


def test_search_follows_a_long_chain_to_its_end(spark):
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(68)], "a string, b string")
    found = graph.distances(graph.simple_graph(pairs), spark.createDataFrame([("n000",)], "node string"))
    assert rows(found) == [("n000", f"n{i:03d}", i) for i in range(69)]


def test_code_gaps_counts_long_ids(spark, tmp_path):
    def gaps(name, *ids):
        spark.createDataFrame([(i,) for i in ids], "herb_id string").write.parquet(str(tmp_path / name / "herb_info.parquet"))
        return rows(network.code_gaps(spark, str(tmp_path / name)))

    assert gaps("ten", "HERB999999998", "herb1000000001 ", "HERBx", None) == [("HERB1000000000",), ("HERB999999999",)]
    with pytest.raises(ValueError, match="HERB9{19}"):
        gaps("long", "HERB000001", "HERB" + "9" * 19)
