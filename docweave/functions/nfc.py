"""Unicode composition, which Spark's SQL has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.session import ship, strip_blanks


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(column: str) -> Column:
    """The text in NFC without blanks at the ends."""
    composed = F.pandas_udf(_composed, StringType())
    return strip_blanks(composed(F.col(column)))


ship(__name__)
