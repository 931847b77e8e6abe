"""Name functions with no built-in form: full Unicode case folding, and gestalt pattern similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.semantics import normalise_text

_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("character", "token", "combined")])


@F.pandas_udf(T.StringType())
def fold_name(names: pd.Series) -> pd.Series:
    """NFKC, stripped, case-folded, white space collapsed."""
    return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def folded(df: DataFrame, column: str, out: str) -> DataFrame:
    """`df` with `out`: `column` as `fold_name` gives it.

    For ASCII text that is what built-in functions give. Python sees each distinct other name once, and they are joined back.
    """
    c = F.col(column)
    # Four ASCII control characters count as white space for one side only.
    plain = F.coalesce((F.octet_length(c) == F.char_length(c)) & ~c.rlike("[\\x1c-\\x1f]"), F.lit(True))
    odd = df.filter(~plain).select(column).distinct().withColumn(out, fold_name(column))
    return df.filter(plain).withColumn(out, normalise_text(c)).unionByName(df.filter(~plain).join(odd, column).select(*[f"`{x}`" for x in df.columns], out))


def by_words(key: str) -> str:
    """The key with its words in order."""
    return " ".join(sorted(key.split()))


def similarity(a: str, b: str) -> tuple[float, float, float]:
    """Ratcliff-Obershelp ratio of two comparison keys, as they are and with sorted words, and 0.65 : 0.35 of both."""
    c = SequenceMatcher(None, a, b).ratio()
    t = SequenceMatcher(None, by_words(a), by_words(b)).ratio()
    return round(c, 6), round(t, 6), round(0.65 * c + 0.35 * t, 6)


@F.pandas_udf(_SCORES)
def name_similarity(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """`similarity` of each pair; null counts as empty."""
    return pd.DataFrame([similarity(a or "", b or "") for a, b in zip(left, right)], columns=["character", "token", "combined"])
