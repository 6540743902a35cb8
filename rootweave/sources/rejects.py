"""Delimited records: the valid ones load, the others come out with the reason.

Structure is checked where the records are: Spark partitions them, each Arrow batch goes through pyarrow's
CSV reader once, whose invalid-row callback receives the records of a wrong width. Fields are read as
strings; values are then judged by whole vectors and failing cells labelled.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A record in good quoting: fields that are quoted throughout (inner quotes doubled) or hold no quote. Matched
#: by RE2 over whole vectors: linear and without recursion, so very long fields and very many fields are fine.
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
WELL_QUOTED = rf"\A{_FIELD}(?:,{_FIELD})*\z"
# Line breaks within a record travel through the CSV reader as these two noncharacters.
_LF, _CR = "\ufdd0", "\ufdd1"


@dataclass(frozen=True)
class NumberRule:
    """ASCII digits, optionally a point and more digits; within low..high (low itself only if ``low_ok``)."""

    low: int
    high: int
    low_ok: bool = True


@dataclass(frozen=True)
class SmilesRule:
    """Allowed characters; round brackets balanced, square brackets balanced and not nested."""


# The characters of a SMILES string.
_SMILES = np.zeros(256, dtype=bool)
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@+-[]()=#$:/\\%.*":
    _SMILES[ord(_c)] = True


def _present(values: pa.Array) -> pa.Array:
    return pc.fill_null(pc.not_equal(values, ""), False)


def bad_numbers(values: pa.Array, rule: NumberRule) -> pa.Array:
    """True where a value is there but is no number of the rule. Missing values (null, '') are fine."""
    digits = pc.fill_null(pc.match_substring_regex(values, r"\A[0-9]+(\.[0-9]+)?\z"), False)
    x = pc.cast(pc.if_else(digits, values, None), pa.float64())
    beyond = pc.or_(pc.less(x, float(rule.low)), pc.greater(x, float(rule.high)))
    # A double may round onto a bound from beyond it: there the digits decide.
    over = pc.and_(pc.equal(x, float(rule.high)), pc.match_substring_regex(values, rf"\A0*{rule.high}\.0*[1-9]"))
    if not rule.low_ok:
        beyond = pc.or_(beyond, pc.invert(pc.fill_null(pc.match_substring_regex(values, "[1-9]"), True)))
    good = pc.and_(digits, pc.invert(pc.fill_null(pc.or_(beyond, over), False)))
    return pc.and_(_present(values), pc.invert(good))


def bad_smiles(values: pa.Array, rule: SmilesRule = SmilesRule()) -> pa.Array:
    """True where a value is there but breaks the rule. Works on the bytes of all values at once."""
    filled = pc.fill_null(values, "").cast(pa.large_binary())
    if not len(filled):
        return pa.array([], pa.bool_())
    ends = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    start, stop = ends[:-1] - ends[0], ends[1:] - ends[0]
    data = np.frombuffer(filled.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    odd = running(~_SMILES[data])
    bad = odd[stop] != odd[start]
    for opened, closed, deepest in ((ord("("), ord(")"), None), (ord("["), ord("]"), 1)):
        depth = running((data == opened).astype(np.int64) - (data == closed))
        bad |= depth[stop] != depth[start]
        some = stop > start
        if some.any():
            edges = start[some]
            low = np.minimum.reduceat(depth[1:], edges) - depth[edges]
            bad[some] |= low < 0
            if deepest is not None:
                bad[some] |= np.maximum.reduceat(depth[1:], edges) - depth[edges] > deepest
    return pa.array(bad)


def label_cells(fields: dict[str, pa.Array], rules: dict) -> dict[str, pa.Array]:
    """For each rule a vector: True where the cell fails."""
    return {k: (bad_smiles if isinstance(r, SmilesRule) else bad_numbers)(fields[k].cast(pa.large_string()), r) for k, r in rules.items()}


def _labels(row_no: pa.Array, bad: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    for name, flags in bad.items():
        hit = row_no.filter(flags)
        if len(hit):
            yield pa.record_batch([hit, pa.array(["value"] * len(hit)), pa.array([name] * len(hit))], names=["row_no", "reason", "field_name"])


def table_rejects(table: DataFrame, rules: dict, row_no: str = "row_no") -> DataFrame:
    """Invalid cells of a loaded table of strings: ``row_no, reason, field_name``. Null and '' are valid."""
    def judge(batches):
        for b in batches:
            yield from _labels(b.column(0), label_cells({k: b.column(i + 1) for i, k in enumerate(rules)}, rules))

    picked = table.select(F.col(row_no).cast("bigint").alias("row_no"), *[F.col(f"`{k}`").cast("string").alias(k) for k in rules])
    return picked.mapInArrow(judge, "row_no bigint, reason string, field_name string")


def _parse(batch: pa.RecordBatch, names: list[str]) -> tuple[pa.Table, list[int]]:
    """Records of the batch that have the right width, and the numbers of those that don't."""
    wrong: list[int] = []

    def on_invalid(row) -> str:
        wrong.append(int(row.text.split(",", 1)[0]))
        return "skip"

    lines = pc.binary_join_element_wise(pc.cast(batch.column(0), pa.string()), batch.column(1), ",")
    data = "\n".join(lines.to_pylist()).encode() + b"\n"
    table = csv.read_csv(
        io.BytesIO(data),
        read_options=csv.ReadOptions(column_names=["row_no", *names], block_size=len(data) + 1, use_threads=False),
        parse_options=csv.ParseOptions(invalid_row_handler=on_invalid, quote_char='"', double_quote=True, newlines_in_values=False),
        convert_options=csv.ConvertOptions(column_types={"row_no": pa.int64(), **dict.fromkeys(names, pa.string())}, strings_can_be_null=False),
    )
    return table, wrong


def _prepared(lines: DataFrame, row_no: str, text: str) -> DataFrame:
    """``row_no, raw``: without the CR at the end, line breaks as noncharacters; null counts as ''."""
    raw = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\z", "")
    return lines.select(F.col(row_no).cast("bigint").alias("row_no"), F.translate(raw, "\n\r", _LF + _CR).alias("raw"))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text (one record at least), as one slice is parsed at once."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _well_quoted(batch: pa.RecordBatch) -> pa.Array:
    return pc.match_substring_regex(batch.column(1), WELL_QUOTED)


def line_rejects(lines: DataFrame, names: list[str], rules: dict, row_no: str = "line_no", text: str = "raw_line") -> DataFrame:
    """Failing records of ``lines`` (one record each): ``row_no, reason, field_name``.

    The first that holds of ``quoting``, ``column_count`` (field_name '') and ``value`` (one row per field).
    A null or empty line has one field, so it fails with ``column_count``. Repeated lines are judged each.
    """
    def judge(batches):
        for b in _slices(batches):
            quoted = _well_quoted(b)
            bad = b.filter(pc.invert(quoted)).column(0)
            if len(bad):
                yield pa.record_batch([bad, pa.array(["quoting"] * len(bad)), pa.array([""] * len(bad))], names=["row_no", "reason", "field_name"])
            fine = b.filter(quoted)
            if fine.num_rows:
                table, wrong = _parse(fine, names)
                if wrong:
                    yield pa.record_batch([pa.array(wrong, pa.int64()), pa.array(["column_count"] * len(wrong)), pa.array([""] * len(wrong))], names=["row_no", "reason", "field_name"])
                table = table.combine_chunks()
                if table.num_rows:
                    one = lambda c: table.column(c).combine_chunks()
                    yield from _labels(one("row_no"), label_cells({k: one(k) for k in rules}, rules))

    return _prepared(lines, row_no, text).mapInArrow(judge, "row_no bigint, reason string, field_name string")


def load_valid(lines: DataFrame, names: list[str], rules: dict, row_no: str = "line_no", text: str = "raw_line") -> DataFrame:
    """The records without any failure, as columns of strings: ``row_no`` and ``names``; '' is null."""
    def parse(batches):
        for b in _slices(batches):
            fine = b.filter(_well_quoted(b))
            if not fine.num_rows:
                continue
            table, _ = _parse(fine, names)
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            bad = np.zeros(table.num_rows, dtype=bool)
            for flags in label_cells({k: table.column(k).combine_chunks() for k in rules}, rules).values():
                bad |= flags.to_numpy(zero_copy_only=False)
            good = table.filter(pa.array(~bad))
            columns = [good.column("row_no").combine_chunks()]
            for k in names:
                c = pc.replace_substring(pc.replace_substring(good.column(k).combine_chunks(), _LF, "\n"), _CR, "\r")
                columns.append(pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c))
            yield pa.record_batch(columns, names=["row_no", *names])

    schema = ", ".join(["row_no bigint", *[f"`{k}` string" for k in names]])
    return _prepared(lines, row_no, text).mapInArrow(parse, schema)
