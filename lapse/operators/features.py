"""Model features from the table's own values, without a dictionary on the driver.

Numeric columns are read as they are (linear model: standardised; trees: the
number of an interval between exact quantiles). Each value of a categorical
column is a 0/1 feature of its own. The dictionary of values is a stored table
(column, value, code), numbered by the distributed codes of
:mod:`lapse.operators.ordered` and joined to the rows; only its size reaches
the driver, and names are joined to results by code.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.operators.ordered import dense_codes
from lapse.operators.selection import values_at_ranks
from lapse.session import materialize, release

FEW_VALUES = 1 << 17  # a column's values that every task may hold (some 10 MB)


@dataclass
class Features:
    """Columns and their codes; ``edges[j]`` are the interval ends of numeric column j, ``dictionary`` the stored table."""

    numeric: list[str]
    categorical: list[str]
    edges: list[list[float]]
    dictionary: DataFrame
    values: list[int]  # how many values each categorical column has

    @property
    def offsets(self) -> list[int]:
        """First slot of every numeric column, then that of the categorical values."""
        out = [0]
        for e in self.edges:
            out.append(out[-1] + len(e) + 1)
        return out

    @property
    def spans_of_all(self) -> list[tuple[int, int]]:
        """First and last slot (exclusive) of every column, the numeric ones first."""
        return [*zip(self.offsets[:-1], self.offsets[1:]), *self.spans]

    @property
    def slots(self) -> int:
        return self.offsets[-1] + sum(self.values)

    @property
    def spans(self) -> list[tuple[int, int]]:
        """First and last slot (exclusive) of each categorical column's values: codes are numbered column by column."""
        out, at = [], self.offsets[-1]
        for n in self.values:
            out.append((at, at + n))
            at += n
        return out


def value_dictionary(df: DataFrame, categorical: Iterable[str]) -> DataFrame:
    """One row for every (column, value) pair with ``code``: its place in the order of columns as given, then of values. NULL is no value."""
    cols = list(categorical)
    pair = lambda i, c: F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
    long = df.select(F.explode(F.array(*[pair(i, c) for i, c in enumerate(cols)])).alias("p")).where("p.value IS NOT NULL").select("p.*").distinct()
    keyed = long.withColumn("key", F.concat(F.lpad(F.col("i").cast("string"), 4, "0"), F.lit(":"), F.col("value")))
    values = materialize(keyed, "values")
    coded = dense_codes(values, "key", "code")
    out = materialize(coded.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("key", 1, 4).cast("int") + 1).alias("column"),
                                    F.expr("substring(key, 6)").alias("value"), F.col("code").cast("long").alias("code")), "dictionary")
    release(values)
    return out


def learn(df: DataFrame, numeric: Iterable[str], categorical: Iterable[str], intervals: int = 32) -> Features:
    """Interval ends (the distinct values at ranks i (n - 1) // ``intervals``) and the dictionary of ``df``, a stored table.

    One interval has no ends between: a learner that takes numbers as they are asks for 1, and no rank is looked for."""
    numeric, categorical = list(numeric), list(categorical)
    ranks = lambda n: [i * (n - 1) // intervals for i in range(1, intervals)]
    found = values_at_ranks(df, {c: ranks for c in numeric}) if numeric and intervals > 1 else {}
    dictionary = value_dictionary(df, categorical) if categorical else df.sparkSession.createDataFrame([], "column string, value string, code long")
    n = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return Features(numeric, categorical, [sorted(set(found[c][1].values())) if c in found else [] for c in numeric], dictionary, [n.get(c, 0) for c in categorical])


def with_codes(df: DataFrame, f: Features) -> DataFrame:
    """``df`` with ``{column}__code``: the code of every categorical value, NULL for a value that the dictionary lacks.

    A column of few values is looked up in a broadcast of at most
    :data:`FEW_VALUES` rows, so that neither its hot values nor the wide rows
    are shuffled; longer lists are joined as AQE decides."""
    for c, n in zip(f.categorical, f.values):
        d = f.dictionary.where(F.col("column") == c).select(F.col("value").alias(f"{c}__value"), F.col("code").alias(f"{c}__code"))
        d = F.broadcast(d) if n <= FEW_VALUES else d
        df = df.withColumn(f"{c}__value", F.col(c).cast("string")).join(d, f"{c}__value", "left").drop(f"{c}__value")
    return df


def intervals(x: pa.Array, edges: np.ndarray) -> np.ndarray:
    """Number of the interval of each double: how many ``edges`` (sorted) lie below it. NULL is in the first, NaN beyond all numbers."""
    unknown = x.is_null().to_numpy(zero_copy_only=False)
    return np.where(unknown, 0, np.searchsorted(edges, x.to_numpy(zero_copy_only=False), "left"))
