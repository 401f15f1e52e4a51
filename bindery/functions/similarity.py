"""Calibrated similarities and the weighted score of a record against a file's book."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions import text as X

#: Weights of the compared fields, floors and ceilings, and the knots between
#: which a raw ratio's penalty is a straight line.
TITLE_WEIGHT, AUTHOR_WEIGHT, SERIES_WEIGHT, YEAR_WEIGHT = 1.0, 0.8, 0.2, 0.15
CEILING = 0.7
AUTHOR_AGREES = 0.5
TITLE_AGREES = 0.5
KNOTS = ((0.35, 1.00), (0.50, 0.88), (0.60, 0.78), (0.70, 0.63), (0.80, 0.45), (0.90, 0.22), (1.00, 0.00))
DEAD_BAND = 0.97
FLOOR = 0.35


def sequence_ratio(left: str | None, right: str | None) -> float:
    """The ratio of matching characters; 0 if a side is empty. Not symmetric."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    return difflib.SequenceMatcher(None, left, right).ratio()


def _memoised():
    known: dict[tuple, float] = {}

    def of(left, right):
        key = (left, right)
        if key not in known:
            known[key] = sequence_ratio(left, right)
        return known[key]

    return of


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    of = _memoised()
    return pd.Series([of(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def best_ratios(wanted: pd.Series, found: pd.Series) -> pd.Series:
    """For each name wanted, the highest ratio to any name found."""
    of = _memoised()
    return pd.Series([[max(of(a, b) for b in other) for a in own] if len(other) else [] for own, other in zip(wanted, found)])


def penalty(raw: Column) -> Column:
    """What a raw ratio costs: nothing in the dead band, everything below the floor."""
    told = F.lit(1.0)
    for (low, at_low), (high, at_high) in reversed(list(zip(KNOTS, KNOTS[1:]))):
        line = at_low + ((raw - low) / (high - low)) * (at_high - at_low)
        told = F.when((raw >= low) & (raw <= high), line).otherwise(told)
    return F.when(raw >= DEAD_BAND, F.lit(0.0)).when(raw < FLOOR, F.lit(1.0)).otherwise(told)


def compared_titles(file: Column, record: Column) -> Column:
    """struct(file, record) of the titles that are compared, from ``text.parted`` of both: whole
    titles where both have a subtitle, else the heads."""
    both = file["subtitle"].isNotNull() & record["subtitle"].isNotNull()
    told = lambda x: F.when(both, F.concat(x["head"], F.lit(": "), x["subtitle"])).otherwise(x["head"])
    return F.struct(told(file).alias("file"), told(record).alias("record"))


def weighted_score(title: Column, author: Column, series_differs: Column, year_differs: Column) -> Column:
    """Penalties (author: a similarity; null: not compared) -> the score, to four places.

    ``series_differs`` and ``year_differs`` are booleans, null where a side is silent.
    """
    agrees = F.coalesce(author >= AUTHOR_AGREES, F.lit(False))
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    told = lambda x, w: F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    weight = (
        F.lit(TITLE_WEIGHT)
        + F.when(agrees, F.lit(AUTHOR_WEIGHT)).otherwise(F.lit(0.0))
        + told(series_differs, SERIES_WEIGHT)
        + told(year_differs, YEAR_WEIGHT)
    )
    cost = (
        TITLE_WEIGHT * title
        + F.when(agrees, AUTHOR_WEIGHT * (1.0 - author)).otherwise(F.lit(0.0))
        + SERIES_WEIGHT * flag(series_differs)
        + YEAR_WEIGHT * flag(year_differs)
    )
    score = 1.0 - cost / weight
    return F.round(F.when(agrees, F.least(score, F.lit(1.0))).otherwise(F.least(score, F.lit(CEILING))), 4)


def heads_agree(own: Column, other: Column) -> Column:
    """Whether a record's title says nothing against the file's, from the keys of both heads:
    the record's is in the file's as whole words, or is similar enough; a file without a title
    agrees."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    inside = (other != "") & F.contains(padded(own), padded(other))
    return (own == "") | inside | (1.0 - penalty(ratio(own, other)) >= TITLE_AGREES)
