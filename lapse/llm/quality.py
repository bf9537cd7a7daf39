"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed to ``buckets`` features. Counted over all rows
they give the raw model q, over the rows marked as target the target model p
(both smoothed); the log importance of a text is the sum of log p / q over its
features. Adding standard Gumbel noise to it and keeping the k largest sums
draws k rows without replacement in proportion to their importance. The noise
is a hash of seed and row, so that reruns agree.

Two passes over the texts; what is shuffled in between is one array of counts
a task. The k-th largest sum is found from counts: the ordered bits of the sum
are cut to a prefix that few rows share, and only those are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.common import stored
from lapse.session import ship_by_value

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def features(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of the words (A-Z in lower case, parted by ASCII white space) and of the pairs of neighbours, repeats included."""
    from zlib import crc32
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(df: DataFrame, text: str, group: str, buckets: int) -> np.ndarray:
    """Counts of every feature in rows with ``group`` 0 and 1, over all rows; 2 x ``buckets`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, buckets), np.int64), False
        for b in batches:
            for t, g in zip(b.column(0), b.column(1)):
                total[g.as_py()] += np.bincount(features(t.as_py(), buckets), minlength=buckets)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * buckets, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int64)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    ship_by_value(__name__)
    sums = df.select(F.col(text).cast("string").alias("t"), F.col(group).cast("int").alias("g")).mapInArrow(run, "part int, counts binary")
    # a tree of sums: 64 groups of tasks, then one
    sums = sums.withColumn("part", (F.spark_partition_id() % 64).cast("int")).groupBy("part").applyInArrow(add, "part int, counts binary")
    total = np.zeros(2 * buckets, np.int64)
    for r in sums.collect():  # at most 64 rows of 2 x buckets numbers
        total += np.frombuffer(r["counts"], np.int64)
    return total.reshape(2, buckets)


def log_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p / q by feature: p from target rows (row 1), q from all rows; without a target 0."""
    if not counts[1].any():
        return np.zeros(counts.shape[1])
    p, q = counts[1] + smoothing, counts.sum(axis=0) + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def importance(df: DataFrame, text: str, ratios: np.ndarray, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` columns and ``log_weight`` of every row."""
    sent, buckets = df.sparkSession.sparkContext.broadcast(ratios), len(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            w = np.array([float(table[features(t.as_py(), buckets)].sum()) for t in b.column(0)], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(w, pa.float64())], names=[*b.schema.names[1:], "_w"])

    ship_by_value(__name__)
    rows = df.select(F.col(text).cast("string").alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("_w", T.DoubleType())]))
    return out.select(*[F.col(f"_c_{c}").alias(c) for c in carry], F.col("_w").alias("log_weight"))


def top_k(df: DataFrame, value: str, k: int, ties: tuple[str, ...], width: int = 4096) -> DataFrame:
    """``df`` with ``selected``: the ``k`` rows with the largest ``value``, ties by the columns ``ties``.

    Rounds of counting: the span that still holds the k-th value is cut into
    ``width`` equal steps and the step with the k-th value is kept, until few
    rows are left in it (or all are equal); those alone are ranked."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    if not n or k >= n or k <= 0:
        return df.withColumn("selected", F.lit(bool(n and k > 0)))
    above, inside = 0, n
    while inside > 100_000 and high > low:
        step = (high - low) / width
        at = F.least(F.floor((F.col(value) - low) / step), F.lit(width - 1))
        found = df.where(F.col(value).between(low, high)).groupBy(at.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).orderBy(F.desc("s")).collect()
        for r in found:  # at most ``width`` rows
            if above + r["n"] >= k:
                same = (r["a"], r["b"], r["n"]) == (low, high, inside)
                low, high, inside = r["a"], r["b"], r["n"]
                break
            above += r["n"]
        if same:
            break
    # rows equal in value and ties are interchangeable: they are counted first, and each such group gets its number of places
    span = F.col(value).between(low, high)
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, -1)
    groups = (df.where(span).groupBy(value, *ties).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_m", F.least(F.col("_n"), F.greatest(F.lit(0), F.lit(k - above) - F.coalesce(F.sum("_n").over(before), F.lit(0)))))
                .withColumnsRenamed({c: f"_e_{c}" for c in (value, *ties)}))
    same = F.col(value) == F.col(f"_e_{value}")
    for c in ties:
        same = same & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    equal = Window.partitionBy(value, *ties).orderBy(value)
    edge = df.where(span).join(groups, same).withColumn("selected", F.row_number().over(equal) <= F.col("_m"))
    rest = df.where(~span).withColumn("selected", F.col(value) > high)
    return rest.select(*df.columns, "selected").union(edge.select(*df.columns, "selected"))


def resample(df: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "quality", share: float | None = None,
             buckets: int = 10_000, seed: int = 9) -> DataFrame:
    """``key``, ``log_weight``, ``gumbel_key`` and ``selected`` of every row.

    The target are all rows that ``labels`` marks 1; ``share`` of all rows is
    drawn, where None means the share of 1 among the labelled rows. A null or
    empty text weighs 0; rows of one key are told apart by their text; a null
    key is unlabelled; without a target all weigh 0 and the draw is uniform;
    an empty table gives an empty result. Other columns are not read.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_lk")).agg((F.max(label) > 0).cast("int").alias("_y"))
    marked = stored(marked, "quality-labels")
    n_marked, good = marked.agg(F.count(F.lit(1)), F.sum("_y")).first()
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    # both models count every row of theirs; the marked keys have no bound, so they are never broadcast
    target = marked.where("_y = 1").select("_lk", F.lit(1).alias("_g")).hint("merge")
    marked_rows = rows.join(target, F.col("_k") == F.col("_lk"), "left").select("_t", F.coalesce("_g", F.lit(0)).alias("_g"))
    counts = ngram_counts(marked_rows, "_t", "_g", buckets)
    weights = importance(rows.withColumn("_h", F.xxhash64("_t")), "_t", log_ratios(counts), ("_k", "_h"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "_k", "_h"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = stored(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "quality")
    if share is None:
        share = good / n_marked if n_marked else 1.0
    n = scored.count()
    chosen = top_k(scored, "gumbel_key", round(share * n), ("_k", "_h"))
    return chosen.select(F.col("_k").alias(key), "log_weight", "gumbel_key", "selected")
