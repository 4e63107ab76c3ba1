"""The two ratio functions Spark lacks. Both run on distinct, already blocked pairs.

The functions are made inside their callers, so they travel to the workers by value.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def sequence_ratio(a: str, b: str) -> Column:
    """Ratcliff-Obershelp ratio of (first, second), in that order; 0 when either is empty."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def ratio_bound(a: str, b: str) -> Column:
    """No less than ``sequence_ratio``: twice the characters both hold, repeats counted, over all characters; null for null or
    empty text. Stays in the JVM, so that pairs which can't reach a ratio never get to Python."""

    def bag(text: Column) -> Column:
        def numbered(i: Column) -> Column:
            char, upto = F.substring(text, i, F.lit(1)), F.substring(text, F.lit(1), i)
            return F.concat(char, (i - F.length(F.replace(upto, char, F.lit("")))).cast("string"))

        return F.transform(F.sequence(F.lit(1), F.length(text)), numbered)

    x, y = (F.nullif(F.col(c), F.lit("")) for c in (a, b))
    return 2.0 * F.size(F.array_intersect(bag(x), bag(y))) / (F.length(x) + F.length(y))


def closest_of(word: str, choices: Column) -> Column:
    """The choice most like the word, ratio 0.78 or better; null otherwise."""

    @F.pandas_udf(T.StringType())
    def closest(words: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for w, names in zip(words, lists):
            best = max(((SequenceMatcher(None, n, w or "").ratio(), n) for n in (names if names is not None else [])), default=(0.0, None))
            out.append(best[1] if best[0] >= 0.78 else None)
        return pd.Series(out, dtype="object")

    return closest(word, choices)
