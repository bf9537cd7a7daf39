"""Exact order statistics by narrowing brackets; nothing is sorted globally.

The value at a rank is looked for between two values that surely enclose it.
A mergeable sketch (``percentile_approx``, partial aggregation, no shuffle of
rows) proposes the bracket, one aggregation counts the rows below and inside
it, and only if the counts confirm the rank is the bracket taken: exactness
never rests on the sketch's error bound. Brackets that still hold many rows
are sketched again, inside. What is left, some thousandth of the rows or less
after each round, is grouped by value and read off. Overlapping brackets of a
column are merged first, so a row is looked at once however many ranks are asked;
a bracket of one value is an answer itself. Rows are counted by numpy, batch by
batch: a hundred bounds would be as many expressions for every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.session import materialize, release, ship_by_value


@dataclass
class _Bracket:
    """Ranks of one column that lie between ``lo`` and ``hi`` (inclusive; None: no bound), with the rows below and inside."""

    column: str
    ranks: list[int]
    lo: float | None
    hi: float | None
    below: int
    inside: int
    stuck: bool = False
    name: str = field(default="")

    def condition(self):
        x = F.col(self.column)
        return ((x >= F.lit(self.lo)) if self.lo is not None else F.lit(True)) & ((x <= F.lit(self.hi)) if self.hi is not None else F.lit(True))

    def holds(self) -> Callable[[np.ndarray], slice]:
        """Its place among sorted values, where NaN is the largest."""
        lo, hi = self.lo, self.hi
        return lambda x: slice(0 if lo is None else np.searchsorted(x, lo, "left"), len(x) if hi is None else np.searchsorted(x, hi, "right"))

    @property
    def one_value(self) -> bool:
        """All its rows hold the same value."""
        return self.lo is not None and self.lo == self.hi

    def settled(self, limit: int) -> bool:
        """Needs no further round: few rows, one value, or a round that did not narrow it."""
        return self.stuck or self.inside <= limit or self.one_value


def _counted(df: DataFrame, bounds: list[tuple[str, float, float]]) -> list[tuple[int, int]]:
    """Rows below and rows inside each (column, lowest, highest value), in one pass; NaN is the largest value, as in Spark."""
    places: dict[str, list[int]] = {}
    for j, (c, _, _) in enumerate(bounds):
        places.setdefault(c, []).append(j)
    ends = {c: (np.array([bounds[j][1] for j in js]), np.array([bounds[j][2] for j in js])) for c, js in places.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, upto = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), np.int64)
        for b in batches:
            for c, js in places.items():
                x = np.sort(b.column(c).drop_null().to_numpy(zero_copy_only=False))
                below[js] += np.searchsorted(x, ends[c][0], "left")
                upto[js] += np.searchsorted(x, ends[c][1], "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bounds))), pa.array(below), pa.array(upto - below)], names=["j", "below", "inside"])

    ship_by_value(__name__)
    parts = df.select(*places).mapInArrow(count, "j long, below long, inside long")
    found = {r["j"]: (r["below"], r["inside"]) for r in parts.groupBy("j").agg(F.sum("below").alias("below"), F.sum("inside").alias("inside")).collect()}
    return [found.get(j, (0, 0)) for j in range(len(bounds))]


def _narrow(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> list[_Bracket]:
    """One round: a sketch inside every bracket, then one count of what the proposals hold."""
    slack = 2.0 / accuracy
    asked = []
    for b in brackets:
        at = lambda r: (r - b.below) / max(1, b.inside - 1)  # noqa: E731, B023
        for r in b.ranks:
            asked.append((b, r, max(0.0, at(r) - slack), min(1.0, at(r) + slack)))
    sketches = []
    for i, b in enumerate(brackets):
        probs = [p for a in asked if a[0] is b for p in a[2:]]
        sketches.append(F.percentile_approx(F.when(b.condition(), F.col(b.column)), probs, accuracy).alias(str(i)))
    found = df.agg(*sketches).first()
    proposals = []
    for i, b in enumerate(brackets):
        cuts = sorted((found[str(i)][2 * j], found[str(i)][2 * j + 1], r) for j, r in enumerate(b.ranks))
        merged: list[list] = []
        for lo, hi, r in cuts:
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
                merged[-1][2].append(r)
            else:
                merged.append([lo, hi, [r]])
        proposals += [(b, lo, hi, sorted(rs)) for lo, hi, rs in merged]
    counts = _counted(df, [(b.column, lo, hi) for b, lo, hi, _ in proposals])
    out, failed = [], {}
    for (b, lo, hi, ranks), (below, inside) in zip(proposals, counts):
        if below <= ranks[0] and ranks[-1] < below + inside:
            out.append(_Bracket(b.column, ranks, lo, hi, below, inside, stuck=inside > b.inside // 2))
        else:  # the sketch was further off than it says: these ranks keep the old bracket
            failed.setdefault(id(b), (b, []))[1].extend(ranks)
    out += [_Bracket(b.column, sorted(rs), b.lo, b.hi, b.below, b.inside, stuck=True) for b, rs in failed.values()]
    return out


def _grouped(df: DataFrame, brackets: list[_Bracket]) -> DataFrame:
    """``j``, ``v``, ``n``: the rows inside every bracket (its number j), to distinct values with counts."""
    within = [(j, b.column, b.holds()) for j, b in enumerate(brackets)]
    columns = list(dict.fromkeys(b.column for b in brackets))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: np.sort(b.column(c).drop_null().to_numpy(zero_copy_only=False)) for c in columns}
            found = [(j, *np.unique(x[c][place(x[c])], return_counts=True)) for j, c, place in within]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(v), j, np.int32) for j, v, _ in found])),
                                              pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([n for _, _, n in found]).astype(np.int64))], names=["j", "v", "n"])

    ship_by_value(__name__)
    return df.select(*columns).mapInArrow(inside, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n"))


def values_at_ranks(df: DataFrame, ranks: dict[str, Callable[[int], Iterable[int]]], accuracy: int = 10_000,
                    limit: int = 50_000, rounds: int = 8) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column the number of its non-null values and the exact value at each 0-based ascending rank asked for.

    ``ranks[c](n)`` names the ranks of column ``c`` for ``n`` values (read as
    doubles; ranks outside 0..n-1 are left out). ``df`` is read a few times: pass
    a stored table. Only counts, bracket ends and the answers reach the driver.
    """
    cols = list(ranks)
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    ns = df.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    todo, done = [], []
    for i, c in enumerate(cols):
        n = ns[f"c{i}"]
        if want := sorted({r for r in ranks[c](n) if 0 <= r < n}):
            todo.append(_Bracket(f"c{i}", want, None, None, 0, n))
    for _ in range(rounds):
        done += [b for b in todo if b.settled(limit)]
        todo = [b for b in todo if not b.settled(limit)]
        if not todo:
            break
        todo = _narrow(df, todo, accuracy)
    done += todo
    out = {c: (ns[f"c{i}"], {}) for i, c in enumerate(cols)}
    for b in done:
        if b.one_value:
            out[cols[int(b.column[1:])]][1].update(dict.fromkeys(b.ranks, b.lo + 0.0))  # -0.0 is 0.0
    done = [b for b in done if not b.one_value]
    if not done:
        return out
    values = _grouped(df, done)
    start = F.sum("n").over(Window.partitionBy("j").orderBy("v")) - F.col("n")
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r - b.below).cast("long") for r in b.ranks]) for b in done]), F.col("j") + 1)
    hits = (values.withColumn("at", start)
            .select("j", "v", F.explode(F.filter(wanted, lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("n")))).alias("r")))
    for h in hits.collect():
        b = done[h["j"]]
        out[cols[int(b.column[1:])]][1][h["r"] + b.below] = h["v"]
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10_000, limit: int = 50_000) -> DataFrame:
    """Linearly interpolated quantiles (as ``percentile``), long form ``(column_name, p, value)``; a column without values gives NULLs."""
    from math import ceil, floor
    narrow = materialize(df.select(*cols), "quantile_input")
    h = lambda n, p: float(p) * (n - 1)
    found = values_at_ranks(narrow, {c: (lambda n: [r for p in probs for r in (floor(h(n, p)), ceil(h(n, p)))]) for c in cols}, accuracy, limit)
    release(narrow)
    rows = []
    for c in cols:
        n, at = found[c]
        for p in probs:
            if not n:
                rows.append((c, float(p), None))
                continue
            lo, hi = at[floor(h(n, p))], at[ceil(h(n, p))]
            rows.append((c, float(p), lo + (h(n, p) - floor(h(n, p))) * (hi - lo)))
    return df.sparkSession.createDataFrame(rows, "column_name string, p double, value double")
