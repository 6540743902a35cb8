"""Fixed rules of the project's tables: formats, ranges and field order."""

from rootweave.operators.profile import ColumnRule
from rootweave.sources.rejects import NumberRule, SmilesRule

COUNT = "0|[1-9][0-9]{0,2}"
PROFILED_INGREDIENT = [
    ColumnRule("ingredient_info", "numhdonors", COUNT, low=0, high=30),
    ColumnRule("ingredient_info", "mollogp", r"-?[0-9]{1,2}\.[0-9]{1,4}", low=-12, high=18),
    ColumnRule("ingredient_info", "numrotatablebonds", COUNT, low=0, high=60),
]
PROFILED_XREF = [
    ColumnRule(
        "ensembl_xref", "uniprot", "[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}",
        measure="length", distinct_shift=True,
    ),
]
# Field order of a delivered ingredient record.
INGREDIENT_FIELDS = [
    "ingredient_id", "ingredient_name", "ingredient_alias_name", "canonical_smiles", "isomeric_smiles", "molecular_formula",
    "ob_score", "drug_likeness", "molwt", "numhacceptors", "numhdonors", "mollogp", "numrotatablebonds",
]
FIELD_RULES = {
    "ob_score": NumberRule(0, 100),
    "drug_likeness": NumberRule(0, 1),
    "molwt": NumberRule(0, 5000, low_ok=False),
    "canonical_smiles": SmilesRule(),
}
