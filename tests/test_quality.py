import csv
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rootweave.functions.ids import cut_version, protein_core, same_id
from rootweave.functions.problems import FIELD_RULES, INGREDIENT_FIELDS, PROFILED_INGREDIENT, PROFILED_XREF
from rootweave.operators import heavy_keys, orphans, profile
from rootweave.session import new_place
from rootweave.sources import rejects


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids(spark):
    df = spark.createDataFrame([(" 9606.ensp12.3\r\n",), ("ENSP7",), ("ENSP7 .1",), ("9606.NA",), ("",), (None,), ("9606.9606.ENSP1",), ("ENSP1x",), ("ENSP5\n.1",)], "x string")
    assert [r[0] for r in df.select(protein_core("x")).collect()] == ["ENSP12", "ENSP7", None, None, None, None, None, None, None]
    df = spark.createDataFrame([("\t hbin1 ",), (" ",), (None,)], "x string")
    assert [r[0] for r in df.select(same_id("x")).collect()] == ["HBIN1", None, None]
    df = spark.createDataFrame([(" ENSG1.2.3 ",), (".5",), (None,)], "x string")
    assert [r[0] for r in df.select(cut_version("x")).collect()] == ["ENSG1", None, None]


CELLS = "row_no bigint, load_no int, numhdonors string, mollogp string, numrotatablebonds string, extra string"


def test_profile_cells(spark):
    t = spark.createDataFrame([(1, 1, "31", "-12.0001", "007", "x"), (2, 1, None, "1.5", "60", "x"), (3, None, "", "18.0", "1\n", "x"), (4, 1, "30", "1,5", "61", "x")], CELLS)
    got = rows(profile.cell_findings(profile.cells(t, PROFILED_INGREDIENT)).select("col_name", "finding", "row_no"))
    assert got == [
        ("mollogp", "format", 4), ("mollogp", "range", 1), ("numhdonors", "range", 1),
        ("numrotatablebonds", "format", 1), ("numrotatablebonds", "format", 3), ("numrotatablebonds", "range", 4),
    ]


def test_profile_counts_are_idempotent_and_signed(spark):
    store = profile.ValueCounts(spark, new_place(spark, "t"))
    one = spark.createDataFrame([(1, 1, "3", "1.0", "4", None), (2, 1, "3", "1.0", None, None)], CELLS)
    two = spark.createDataFrame([(3, 2, "5", "1.0", "4", None)], CELLS)
    for _ in range(2):  # a load written twice counts once
        store.apply(profile.signed_counts(profile.cells(one, PROFILED_INGREDIENT)))
    gone = profile.signed_counts(profile.cells(one.where("row_no = 1").withColumn("load_no", F.lit(2)), PROFILED_INGREDIENT), -1)
    store.apply(profile.signed_counts(profile.cells(two, PROFILED_INGREDIENT)).unionByName(gone))
    live = {r["col_name"]: r for r in profile.metrics(store.after(2), ("tab_name", "col_name")).collect()}
    assert live["numhdonors"]["cells"] == 2 and live["numhdonors"]["distinct_formed"] == 2 and live["numhdonors"]["entropy"] == 1.0
    assert live["mollogp"]["cells"] == 2 and live["mollogp"]["entropy"] == 0.0
    assert live["numrotatablebonds"]["missing"] == 1 and live["numrotatablebonds"]["x_min"] == Decimal("4.0000")


def test_profile_shifts_at_the_bound(spark):
    # 1/10 more missing cells is no finding, a little more is; without the load before there is none.
    cells = [(i, 1, "1", "1.0", "1", None) for i in range(10)] + [(i, 2, None if i < 1 else "1", "1.0", "1", None) for i in range(10)]
    cells += [(i, 3, None if i < 3 else "2", "1.0", "1", None) for i in range(10)] + [(i, 5, None, "1.0", "1", None) for i in range(3)]
    got = rows(profile.load_shifts(profile.signed_counts(profile.cells(spark.createDataFrame(cells, CELLS), PROFILED_INGREDIENT)), PROFILED_INGREDIENT))
    assert got == [("ingredient_info", "numhdonors", "null_rate", 3), ("ingredient_info", "numhdonors", "shape", 3)]
    empty = spark.createDataFrame([], CELLS)
    counts = profile.signed_counts(profile.cells(empty, PROFILED_INGREDIENT))
    assert rows(profile.load_shifts(counts, PROFILED_INGREDIENT)) == [] and rows(profile.metrics(counts)) == []


def test_profile_distinct(spark):
    schema = "row_no bigint, load_no int, uniprot string"
    t = spark.createDataFrame([(i, 1, f"P{i:05d}"[:6]) for i in range(10)] + [(i, 2, "P00001") for i in range(10)], schema)
    got = rows(profile.load_shifts(profile.signed_counts(profile.cells(t, PROFILED_XREF)), PROFILED_XREF))
    assert got == [("ensembl_xref", "uniprot", "distinct", 2)]


def test_heavy_keys(spark):
    data = [("A", "A", 1), ("A", "B", None), (None, None, 5), ("B", None, 3), ("A", "C", 2)]
    df = spark.createDataFrame(data, "a string, b string, s int")
    ends = [F.col("a"), F.col("b")]
    assert rows(heavy_keys.keys_over_share(df, ends, 3, 5)) == [("A", 3)]
    assert rows(heavy_keys.per_end_states(df, ends, F.col("s"))) == [("A", 3, 2, 3, 1, 2), ("B", 2, 1, 3, 3, 3), ("C", 1, 1, 2, 2, 2)]
    empty = df.where("false")
    assert rows(heavy_keys.keys_over_share(empty, ends, 3, 5)) == [] and rows(heavy_keys.per_end_states(empty, ends)) == []


def t(day):
    return datetime(2022, 1, day)


@pytest.mark.parametrize("heavy_parts", [1, 1000, 1_000_000])
def test_orphans(spark, heavy_parts):
    records = spark.createDataFrame(
        [("e", "A", t(1), t(5)), ("e", "A", t(5), t(8)), ("e", "A", t(12), None), ("e", "B", t(9), None), ("e", "C", t(3), t(2)), ("e", "A", t(1), t(5)), ("e", None, t(1), None), ("e", "D", None, None)],
        "scope string, key string, added_at timestamp, deleted_at timestamp",
    )
    refs = [("x", "c", i, "e", k, t(d) if d else None) for i, (k, d) in enumerate([("A", 4), ("A", 5), ("A", 8), ("A", 12), ("B", 3), ("Z", 1), (None, 1), ("C", 4), ("A", None), ("D", 2), ("C", 1)])]
    df = spark.createDataFrame(refs * 2, "tab_name string, col_name string, row_no bigint, scope string, key string, t timestamp")
    got = rows(orphans.orphan_references(df, records, heavy_parts).select("row_no", "reason", "seen_month").distinct())
    m = "2022-01"
    assert [(r[0], r[1], r[2]) for r in sorted(got, key=lambda r: r[0])] == [
        (2, "deleted", m), (4, "late", m), (5, "missing", m), (7, "deleted", m), (8, "deleted", None), (9, "deleted", m), (10, "late", m)
    ]
    assert orphans.orphan_references(df, records, heavy_parts).count() == 14  # repeated rows come out repeatedly
    assert orphans.orphan_references(df.where("false"), records).count() == 0
    assert {r[1] for r in rows(orphans.orphan_references(df, records.where("false")).select("row_no", "reason"))} == {"missing"}


def plain_reasons(line):
    """The rules of a delivered line, read character by character."""
    line = line[:-1] if line.endswith("\r") else line
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            out, i = "", i + 1
            while True:
                if i >= n:
                    return [("quoting", "")]
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            if i < n and line[i] != ",":
                return [("quoting", "")]
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            out, i = line[i:j], j
            if '"' in out:
                return [("quoting", "")]
        fields.append(out)
        if i >= n:
            break
        i += 1
    if len(fields) != 13:
        return [("column_count", "")]
    return [("value", k) for k in FIELD_RULES if not plain_ok(k, fields[INGREDIENT_FIELDS.index(k)])]


def plain_ok(name, v):
    if not v:
        return True
    if name == "canonical_smiles":
        if set(v) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@+-[]()=#$:/\\%.*"):
            return False
        for a, b, top in (("(", ")", 10**9), ("[", "]", 1)):
            depth = 0
            for c in v:
                depth += (c == a) - (c == b)
                if not 0 <= depth <= top:
                    return False
            if depth:
                return False
        return True
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", v, re.A):
        return False
    x = Decimal(v)
    return {"ob_score": 0 <= x <= 100, "drug_likeness": 0 <= x <= 1, "molwt": 0 < x <= 5000}[name]


def line(**kw):
    base = dict(zip(INGREDIENT_FIELDS, ["HBIN1", "n", "", "CC(=O)O", "", "C2", "40.1", "0.2", "100", "1", "2", "3.0", "4"])) | kw
    return ",".join(base[k] for k in INGREDIENT_FIELDS)


LINES = [
    line(), line(ob_score="100.0"), line(ob_score="100.00000000000000000001"), line(ob_score="0100"), line(drug_likeness="1.0000"), line(drug_likeness="1.00000000000000000001"),
    line(molwt="0.0"), line(molwt="5000"), line(molwt="1e3"), line(molwt=" 5"), line(ob_score="-1"), line(ob_score="٣"), line(ob_score="5\n"), line(ob_score='"5"'), line(ob_score='""'),
    line(canonical_smiles="C(C"), line(canonical_smiles="C)C("), line(canonical_smiles="[[C]]"), line(canonical_smiles="[C(]C)"), line(canonical_smiles="Cé"), line(canonical_smiles="C" * 50_000),
    line(canonical_smiles='"a,b"'), line(ingredient_name='"a ""q"" b"'), line(ingredient_name='"a\nb\r\nc"'), line(ingredient_name='a"b'), line(ingredient_name='"a"b'), line(ingredient_name='"a'),
    line() + ",", line() + "\r", line() + "\r\r", "", ",", line() + ',"x"', "\r", line(molwt="0.000001"), line(ob_score="x", molwt="y", canonical_smiles="?"), ',,,,,,,,,,,,', line(ingredient_name="a\nb"), line(ob_score="1."), line(ob_score=".5"),
    line(ingredient_name='"' + 'a""b,' * 40_000 + '"'), "," * 100_000, '"' * 99_999, line(ingredient_name='"' + 'x' * 200_000),
]


def test_line_rejects_against_plain_reading(spark):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(LINES)] + [(999, None, "")], "line_no bigint, raw_line string, row_no string")
    want = sorted((i, r, f) for i, x in enumerate(LINES) for r, f in plain_reasons(x)) + [(999, "column_count", "")]
    assert rows(rejects.line_rejects(df, INGREDIENT_FIELDS, FIELD_RULES)) == want
    bad = {w[0] for w in want}
    loaded = {r["row_no"]: r for r in rejects.load_valid(df, INGREDIENT_FIELDS, FIELD_RULES).collect()}
    assert set(loaded) == set(range(len(LINES))) - bad
    i = LINES.index(line(ingredient_name='"a\nb\r\nc"'))
    assert loaded[i]["ingredient_name"] == "a\nb\r\nc" and loaded[i]["ingredient_alias_name"] is None
    assert next(csv.reader([LINES[22]]))[1] == loaded[22]["ingredient_name"]
    assert rejects.line_rejects(df.where("false"), INGREDIENT_FIELDS, FIELD_RULES).count() == 0


def test_table_rejects(spark):
    fields = list(FIELD_RULES)
    values = [("50", "0.5", "10", "CC"), (None, "", None, ""), ("101", "1.1", "0", "("), (" 5", "5", "5001", "[C")]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "row_no bigint, " + ", ".join(f"{f} string" for f in fields))
    assert rows(rejects.table_rejects(df, FIELD_RULES)) == sorted([(i, "value", f) for i in (2, 3) for f in fields])


def test_store_of_value_counts_load_by_load(spark):
    def delta(load_no, *cells):
        df = spark.createDataFrame([(i, load_no, *c, None) for i, c in enumerate(cells)], CELLS)
        return profile.signed_counts(profile.cells(df, PROFILED_INGREDIENT))

    def state(store, k):
        return rows(store.after(k).select("col_name", F.coalesce("value", F.lit("-")), "n"))

    one, two, four = delta(1, ("3", "1.0", None), ("3", "x", "4")), delta(2, ("5", "1.0", "4")), delta(4, ("3", None, "7"))
    better = delta(2, ("6", "1.0", "4"), ("6", "1.0", "4"))
    store = profile.ValueCounts(spark, new_place(spark, "t"))
    for d in (one, two, four):
        store.apply(d)
    store.apply(better)  # load 2 comes again, otherwise
    rebuilt = profile.ValueCounts(spark, new_place(spark, "t"))
    rebuilt.apply(one.unionByName(better).unionByName(four))
    assert store.loads() == rebuilt.loads() == [1, 2, 4]
    for k in (0, 1, 2, 3, 4, 99):
        assert state(store, k) == state(rebuilt, k)
    assert state(store, 3) == state(store, 2) and ("numhdonors", "6", 2) in state(store, 4) and state(store, 0) == []
    store.retract(2)
    assert state(store, 2) == state(store, 1) and ("numhdonors", "6", 2) not in state(store, 4)
    assert rows(store.deltas().select("load_no").distinct()) == [(1,), (4,)]
    store.apply(four.withColumn("n", -F.col("n")).withColumn("load_no", F.lit(9).cast("bigint")))  # a load of takings back
    assert state(store, 9) == state(store, 1)
    both = store.states([2, 9])
    assert rows(both.where("load_no = 2").select("col_name", "n")) == rows(store.after(2).select("col_name", "n"))
    assert {r["load_no"] for r in profile.metrics(both).collect()} == {2, 9}
