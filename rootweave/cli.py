"""Command line: proximity of two records, SES of two records, edges from payload files.

python -m rootweave.cli proximity --data DIR --a-id HERB000001 --b-id HBDIS000001 [--random-time 100] [--seed 42]
python -m rootweave.cli ses --data DIR --a-id ... --b-id ... [--top-n 20] [--q-cut 0.05] [--categories functional] [--per-category]
    [--randomize N] [--bg ppi|xref] [--degree-matched]
python -m rootweave.cli payloads --input JSON --output TABLE
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.operators import proximity, ses
from rootweave.plans import network


def _sets(spark: SparkSession, d: str, a_id: str, b_id: str, column: str) -> DataFrame:
    """``pair, side, node`` of two ids of any kind; an id that resolves to nothing is an error."""
    seeds = spark.createDataFrame([("A", a_id.strip().upper()), ("B", b_id.strip().upper())], "side string, id string")
    found = network.Network(spark, d).resolver.route(seeds.select(F.col("id").alias("query"), "id"))
    sets = seeds.withColumnRenamed("id", "query").join(found, "query").select(F.lit(f"{a_id}~{b_id}").alias("pair"), "side", F.col(column).alias("node")).distinct()
    there = {r["side"] for r in sets.select("side").distinct().collect()}
    if there != {"A", "B"}:
        raise ValueError(f"no {column} for {', '.join(x for s, x in (('A', a_id), ('B', b_id)) if s not in there)}")
    return sets


def run_proximity(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    g = network.Network(spark, args.data).graph
    out = proximity.proximity(g, _sets(spark, args.data, args.a_id, args.b_id, "ensp"), args.random_time, args.seed)
    return [r.asDict() for r in out.collect()]


def run_ses(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    n = network.Network(spark, args.data)
    sets = _sets(spark, args.data, args.a_id, args.b_id, "ensp").select("side", "node")
    drawn = None
    if args.randomize:
        background = network.background(n, args.bg)
        most = sets.groupBy("side").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if background.count() < most:
            raise ValueError("background smaller than a set")
        drawn = network.random_sets(n, sets, background, args.randomize, args.seed, args.bg == "ppi" and args.degree_matched)
    allow = ses.PRESETS[args.categories] if args.categories in ses.PRESETS else args.categories.split(",")
    scores = network.set_scores(n, sets, drawn, args.top_n, args.q_cut, allow)
    if not args.per_category:
        scores = ses.combine(scores, ("it",)).withColumn("category", F.lit("combined"))
    return [r.asDict() for r in ses.null_summary(scores, ("category",)).collect()]


def run_payloads(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    from rootweave.sources.payload import payload_edges, per_code
    from rootweave.sources.sinks import flush_edges

    payloads = spark.read.schema("code string, payload string").json(args.input)
    flush_edges(payload_edges(payloads), args.output)
    n = per_code(payloads).agg(F.count(F.lit(1)).alias("codes"), F.count_if("n_ids > 0").alias("with_ids")).first()
    return [n.asDict()]


def main(argv: list[str] | None = None) -> int:
    """0 if there is a result, 1 if there is none, 2 on an error."""
    p = argparse.ArgumentParser(prog="rootweave")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("proximity", "ses"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True)
        s.add_argument("--a-id", required=True)
        s.add_argument("--b-id", required=True)
        s.add_argument("--seed", type=int, default=network.SEED)
        s.add_argument("--output")
        if name == "proximity":
            s.add_argument("--random-time", type=int, default=network.SAMPLES)
        else:
            s.add_argument("--top-n", type=int, default=20)
            s.add_argument("--q-cut", type=float, default=0.05)
            s.add_argument("--categories", default="functional", help="go, pathways, functional, all, or names joined by commas")
            s.add_argument("--bg", choices=["ppi", "xref"], default="ppi")
            s.add_argument("--degree-matched", action="store_true")
            s.add_argument("--per-category", action="store_true")
            s.add_argument("--randomize", type=int, default=0)
    s = sub.add_parser("payloads")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("rootweave").getOrCreate()
    try:
        rows = {"proximity": run_proximity, "ses": run_ses, "payloads": run_payloads}[args.what](spark, args)
    except Exception as e:  # noqa: BLE001 - the command line tells any failure by its exit code
        print(f"error: {e}", file=sys.stderr)
        return 2
    text = json.dumps(rows, indent=2, default=str)
    if args.what != "payloads" and args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    print(text)
    return 0 if rows and (args.what != "payloads" or rows[0]["with_ids"]) else 1


if __name__ == "__main__":
    sys.exit(main())
