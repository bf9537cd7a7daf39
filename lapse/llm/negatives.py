"""Hard-negative mining by a secondary-sort shuffle.

Scores are exact integer inner products of anchors with all rows, computed in
tiles: a group of anchors against a block of rows, so that neither side is
ever whole in a task. Two rounds of tiles send only what can matter. The first
gives each anchor's best rows of its own label (its positives). The second
knows the positives' scores, hence the score window of each, and sends from
every tile the first rows of another label in each window; no other row of the
tile can be among the first of all tiles.

Each pair is packed into one key of (anchor, descending score, positive before
negative, id). ``repartitionAndSortWithinPartitions`` deals the keys by anchor
and sorts them; a streaming iterator then reads every anchor's pairs once, in
falling score: a positive opens its window, a negative goes to the open
windows that its score falls in, and a window is done after its first rows.
The iterator holds one counter for each open window and never an anchor's
pairs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm import vectors
from lapse.llm.common import stored
from lapse.llm.vectors import EXACT, matrix, whole_vector
from lapse.session import ship_by_value

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_TOP = 2 ** 63
_KEY = ">QQBQ"


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: int64, or Python integers where the products may pass 2^53."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return ints(a) @ ints(b).T


def first_rows(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Positions (ascending ids) of the ``n`` highest scores of those ``among``, ties to the smaller position, best first."""
    at = np.flatnonzero(among)
    s = scores[at]
    if len(at) > n and s.dtype != object:
        least = np.partition(s, len(s) - n)[len(s) - n]
        above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
        pick = np.concatenate([above, equal[: n - len(above)]])
        at, s = at[pick], s[pick]
    order = sorted(range(len(at)), key=lambda i: (-int(s[i]), int(at[i])))[:n]
    return at[order]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and highest whole score between ``low`` and ``high`` per cent of ``score``."""
    return -(-low * score // 100), high * score // 100


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key whose byte order is (anchor, descending score, kind, id); scores are 0 or more."""
    if score >= _TOP:
        raise OverflowError(f"the score of rows {anchor} and {row} does not fit in a long")
    return struct.pack(_KEY, anchor + _TOP, _TOP - 1 - score, kind, row + _TOP)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = struct.unpack(_KEY, key)
    return anchor - _TOP, _TOP - 1 - score, kind, row - _TOP


def mine(pairs: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Result rows from sorted keys, one pass, holding no more than one counter for each window of the current anchor."""
    current, windows = None, []
    for key, _ in pairs:
        anchor, score, kind, row = unpack(key)
        if anchor != current:
            current, windows = anchor, []
        if kind == 0:
            if len(windows) < positives:
                windows.append([row, score, *window(score, low, high), 0])
            continue
        for w in windows:
            if w[4] < negatives and w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], row, w[1], score


def hard_negatives(rows: DataFrame, anchors: Column | str, key: str, vector: str, label: str, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, group_rows: int = 4096, block_rows: int = 8192) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``rows``. A row's score is its inner product
    with the anchor, components counted as floor(``scale`` x). Higher scores
    come first, ties by smaller id. Positives of an anchor are its first
    ``positives`` other rows of its label (all, if fewer), and of the rows of
    other labels whose score lies within ``low`` to ``high`` per cent of the
    positive's, the first ``negatives`` are returned (all, if fewer), ranked
    from 1. Negative positives have an empty window (``low`` < ``high``).

    Rows with a null key, label or vector, or with a null or non-finite
    component (after scaling), take no part. Of vectors of different lengths
    the shorter lacks components, which count as zero. Rows of one id count
    once: the first by label, then vector. Empty tables, no anchors, one label
    or no rows in a window give no rows. A score of 2^63 or more of a pair that
    a tile sends raises an OverflowError; other scores may be of any size. Other
    columns are read only by ``anchors``.
    """
    spark = rows.sparkSession
    ship_by_value(__name__)
    ship_by_value(vectors.__name__)
    if not 0 <= low < high <= 100:
        raise ValueError("0 <= low < high <= 100 must hold: a negative must not outscore its positive")
    is_anchor = F.expr(anchors) if isinstance(anchors, str) else anchors
    valid = (rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), whole_vector(F.col(f"`{vector}`"), scale).alias("x"),
                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
                 .where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL"))
    one = valid.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.*")
    data = stored(one, "negatives-rows")
    n, dims, n_anchors = data.agg(F.count("*"), F.max(F.size("x")), F.count_if("anchor")).first()
    if not n or not n_anchors:
        return spark.createDataFrame([], _RESULT)
    dims = max(int(dims), 1)
    groups, blocks = -(-n_anchors // group_rows), -(-n // block_rows)

    # tiles: anchors go to every block, rows to every group of anchors
    by_hash = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    tile_rows = data.select("id", "label", "x", by_hash(1, blocks).alias("blk")).select("*", every(groups).alias("grp"))
    asked = data.where("anchor").select("id", "label", "x", by_hash(2, groups).alias("grp"))

    def tiles(left: DataFrame, choose, schema: str) -> DataFrame:
        """``choose(scores, other ids, own label, anchor row)`` names the pairs of a tile that are sent."""
        def solve(a: pa.Table, b: pa.Table) -> pa.Table:
            out = ([], [], [])
            if a.num_rows and b.num_rows:
                b = b.sort_by("id")
                ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
                y, x = matrix(b.column("x"), dims), matrix(a.column("x"), dims)
                more = a.column("scores").to_pylist() if "scores" in a.column_names else [None] * a.num_rows
                a_ids, a_labels = a.column("id").to_pylist(), a.column("label").to_pylist()
                for at in range(0, len(x), 256):
                    s = inner_products(x[at: at + 256], y)
                    for j, row in enumerate(s, at):
                        for i in choose(row, ids != a_ids[j], labels == a_labels[j], more[j]):
                            out[0].append(a_ids[j])
                            out[1].append(int(ids[i]))
                            out[2].append(int(row[i]))
            if out[2] and max(out[2]) >= _TOP:
                raise OverflowError("the score of a pair does not fit in a long")
            return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor", "id", "score"), out)})

        put = left.select("*", every(blocks).alias("blk"))
        return put.groupBy("grp", "blk").cogroup(tile_rows.groupBy("grp", "blk")).applyInArrow(solve, schema)

    def best(scores, other, same, _):
        return first_rows(scores, other & same & (scores >= 0), positives)

    def in_windows(scores, _, same, windows):
        sent = set()
        for p in windows:
            least, most = window(p, low, high)
            sent |= set(first_rows(scores, ~same & (scores >= least) & (scores <= most), negatives).tolist())
        return sorted(sent)

    pair = "anchor long, id long, score long"
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")  # at most ``positives`` rows a block
    near = stored(tiles(asked, best, pair).withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).drop("r"), "negatives-positives")
    windows = near.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("scores"))
    opened = stored(asked.join(windows, "id").select("id", "label", "x", "grp", "scores"), "negatives-windows")
    far = tiles(opened, in_windows, pair)

    pairs = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = pairs.rdd.map(lambda r: (pack(r["anchor"], r["score"], r["kind"], r["id"]), None))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]))
    return spark.createDataFrame(dealt.mapPartitions(lambda it: mine(it, positives, negatives, low, high)), _RESULT, verifySchema=False)
