"""Cleaning of identifier columns, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats of the cleaned identifiers.
DRUG_ID = "^CID[0-9]{9}$"
SIDE_EFFECT = "^C[0-9]{7}$"


def clean_value(col: Column) -> Column:
    """Upper case with everything but A-Z and 0-9 taken out; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(col), "[^A-Z0-9]", ""), F.lit(""))


def drug_id(col: Column) -> Column:
    """The cleaned value where it is a drug id, else null."""
    value = clean_value(col)
    return F.when(value.rlike(DRUG_ID), value)


def side_effect_code(col: Column) -> Column:
    """The cleaned value where it is a side-effect code, else null."""
    value = clean_value(col)
    return F.when(value.rlike(SIDE_EFFECT), value)


def canonical_text(cols: list[Column]) -> Column:
    """The cleaned values in ascending order, joined by ``|``; never null.

    Cleaned values hold no ``|``, so equal texts mean equal values in some order.  A missing
    value is empty and sorts first, so the text of an incomplete record starts with ``|``
    (or is empty, for one column).  Being never null, the text is worked out once: no null
    filter over it is inferred and pushed below it.
    """
    raw = F.array(*(F.coalesce(c, F.lit("")) for c in cols))
    return F.array_join(F.sort_array(F.transform(raw, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))), "|")


def is_complete(text: Column) -> Column:
    """Whether a canonical text has all its values."""
    return ~(text.startswith("|") | (text == ""))
