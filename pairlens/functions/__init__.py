"""Column builders shared by the operators."""

from pairlens.functions.cleaning import canonical_text, clean_value, drug_id, is_complete, side_effect_code

__all__ = ["canonical_text", "clean_value", "drug_id", "is_complete", "side_effect_code"]
