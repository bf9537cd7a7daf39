"""Stratified split by the order of a seeded md5.

md5 text orders rows the same way in every engine, and its leading digits are
uniform, so the hash of the last test row of a class is found by counting
rows per prefix, twice, and looking at single hashes only under one
six-digit prefix (one row in 16 million).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lapse.session import materialize, release

_STEP = 3  # hex digits a round: 4,096 prefixes for every class


def split_key(df: DataFrame, cols: Iterable[str], seed: int) -> Column:
    """md5 of the seed and the columns as text: NULL as a lone backslash, reals with six decimals."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> Column:
        x = F.col(f"`{c}`")
        x = x.cast("decimal(38,6)") if isinstance(kinds[c], (DoubleType, FloatType)) else x
        return F.coalesce(x.cast("string"), F.lit("\\"))

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[text(c) for c in cols]))


def split_cuts(hashed: DataFrame, label: str, h: str, fraction: float) -> dict:
    """Per class the greatest hash of a test row (None: no test row): the hash that holds row number round(fraction n) - 1."""
    sizes = {r[0]: r["n"] for r in hashed.groupBy(label).agg(F.count("*").alias("n")).collect() if r[0] is not None}
    # half up as SQL rounds, not half to even
    todo = {y: (int(n * fraction + 0.5) - 1, "") for y, n in sizes.items() if int(n * fraction + 0.5) > 0}
    cuts = dict.fromkeys(sizes)
    for depth in (_STEP, 2 * _STEP, 32):
        inside = F.lit(False)
        for y, (_, prefix) in todo.items():
            inside = inside | ((F.col(label) == F.lit(y)) & F.col(h).startswith(prefix))
        at = hashed.where(inside).groupBy(F.col(label).alias("y"), F.substring(h, 1, depth).alias("p")).agg(F.count("*").alias("n"))
        left = dict(todo)
        for r in at.orderBy("y", "p").toLocalIterator():
            want, prefix = left[r["y"]]
            if 0 <= want < r["n"]:
                todo[r["y"]] = (want, r["p"])
            left[r["y"]] = (want - r["n"], prefix)
    cuts.update({y: p for y, (_, p) in todo.items()})
    return cuts


def stratified_split(df: DataFrame, label: str, test_fraction: float, seed: int, key: list[str] | None = None) -> DataFrame:
    """``df`` with ``is_test``: in each class round(fraction n) rows, the first by :func:`split_key` over ``key`` (all columns by default).

    Rows of one hash fall on the same side, so a class with equal rows at the
    cut has more test rows; ``key=[customer]`` keeps a customer on one side.
    Rows without a label are dropped.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("_h", split_key(df, key or df.columns, seed))
    narrow = materialize(hashed.select(label, "_h"), "split_hashes")
    is_test = F.lit(False)
    for y, cut in split_cuts(narrow, label, "_h", test_fraction).items():
        if cut is not None:
            is_test = is_test | ((F.col(label) == F.lit(y)) & (F.col("_h") <= F.lit(cut)))
    release(narrow)
    return hashed.withColumn("is_test", is_test).drop("_h")
