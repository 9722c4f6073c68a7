"""NFKC of text columns: Spark has no function for it, so text that it may change is sent through Python, and only that."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Blocks no character of which NFKC changes, alone or beside another of them: ASCII, CJK punctuation, unified ideographs.
_STABLE = r"\x00-\x7f\x{3001}-\x{3029}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"


def may_change(c: Column) -> Column:
    return c.rlike(f"[^{_STABLE}]")


def _form(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(c: Column) -> Column:
    """Text in NFKC. Not for use within a lambda, where Spark allows no Python; see ``nfkc_each``."""
    @F.pandas_udf(StringType())
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(_form, na_action="ignore")

    return F.when(may_change(c), formed(F.when(may_change(c), c))).otherwise(c)


def nfkc_each(items: Column) -> Column:
    """Array of texts, each in NFKC."""
    @F.pandas_udf(ArrayType(StringType()))
    def formed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda texts: None if texts is None else [_form(t) for t in texts])

    any_may = F.coalesce(F.exists(items, may_change), F.lit(False))
    return F.when(any_may, formed(F.when(any_may, items))).otherwise(items)
