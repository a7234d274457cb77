"""Column functions of names. ASCII stays in the JVM; other names go through pandas."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII = "^[\\x00-\\x7f]*$"


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return names.map(lambda x: nfc(nfc(x).casefold()), na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _normal(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.is_normalized("NFC", x), na_action="ignore")


def collision_key(name: Column) -> Column:
    """Equal for names that differ in case or normal form only: case folded and composed; null for null."""
    ascii_ = name.rlike(ASCII)
    return F.when(ascii_, F.lower(name)).otherwise(_folded(F.when(~ascii_, name)))


def in_normal_form(name: Column) -> Column:
    """Whether a name is in composed normal form (NFC)."""
    ascii_ = name.rlike(ASCII)
    return ascii_ | F.coalesce(_normal(F.when(~ascii_, name)), F.lit(True))
