"""Column expressions for the identifier grammar. All are built-ins inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that may stand at the ends of an id.
ID_SPACE = " \t\r\n\u00a0"
SPECIES = "9606."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_id(c: Column | str) -> Column:
    """Without the white space at both ends."""
    return F.btrim(col(c), F.lit(ID_SPACE))


def same_id(c: Column | str) -> Column:
    """Comparison form of an id: trimmed, in capitals; null if nothing is left."""
    return F.nullif(F.upper(trim_id(c)), F.lit(""))


def id_prefix(c: Column | str, prefixes: tuple[str, ...]) -> Column:
    """Which of the prefixes, followed by digits only, the id consists of, in any spelling; null if none."""
    return F.nullif(F.regexp_extract(same_id(c), rf"^({'|'.join(prefixes)})[0-9]+\z", 1), F.lit(""))


def strip_species(c: Column | str) -> Column:
    """``9606.ENSP1`` -> ``ENSP1``; anything else unchanged."""
    c = col(c)
    return F.when(F.startswith(c, F.lit(SPECIES)), F.substring(c, len(SPECIES) + 1, 1 << 30)).otherwise(c)


def cut_version(c: Column | str) -> Column:
    """Trimmed and cut at the first dot; null for null and for what is empty."""
    return F.nullif(F.btrim(F.substring_index(trim_id(c), ".", 1), F.lit(ID_SPACE)), F.lit(""))


_CORE = r"(?is)\A[ \t\r\n\u00a0]*+(?:9606\.)?(ENSP[0-9]++)(?:\..*|[ \t\r\n\u00a0]*)\z"


def protein_core(c: Column | str) -> Column:
    """Core id of a protein: trimmed, capitals, without species and version; null if it is no ENSP id.

    One pass of one regular expression: this runs twice per row of the largest table.
    """
    return F.upper(F.nullif(F.regexp_extract(col(c), _CORE, 1), F.lit("")))


def gene_core(c: Column | str) -> Column:
    """Comparison form of a gene id: ``same_id`` cut at the first dot."""
    return F.upper(cut_version(c))


def ensp_or_null(c: Column | str) -> Column:
    """Case-sensitive form used for background sets: species off, must start with ENSP, version off."""
    x = strip_species(trim_id(c))
    return F.when(F.startswith(x, F.lit("ENSP")), F.substring_index(x, ".", 1))


def canon_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Both ends in binary order. ``least`` skips nulls, so callers drop null ends first."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))
