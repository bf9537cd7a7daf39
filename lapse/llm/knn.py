"""Exact top-k search by inner product: a Voronoi kNN join.

The inner product becomes a distance by one more coordinate: with M the
largest norm, v gets sqrt(M^2 - |v|^2) and a query gets 0, so that
|q - v|^2 = |q|^2 + M^2 - 2 q.v and the highest products are the nearest rows.
Pivots (rows of the data) cut both sides into Voronoi cells. Per cell two
summaries are kept: of the queries, how many, how far from the pivot and how
far the (k+1)-th nearest pivot is, which bounds the distance of the k-th
neighbour; of the data, how many. Query cells are packed to groups; a data row
at distance x of its pivot p goes to a group only if, for one of its cells i,

    |p_i p| - U_i - theta_i  <=  x  <=  |p_i p| + U_i + theta_i,

which the triangle inequality gives for every row that can be among the k
nearest. Each group is solved locally, in blocks of data rows against blocks
of queries, and the local answers are merged. Cells with many rows (one vector
repeated a million times) only mean more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import stored
from lapse.session import ship_by_value

_ROW = "id long, v binary, norm double, dims int"
_RESULT = "query_id long, vec_id long, score long"


def _encode(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part, components floor(scale x) as float64 bytes (whole numbers, hence exact)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("norm", pa.float64()), ("dims", pa.int32())])
        for b in batches:
            ids, vs, norm, dims = [], [], [], []
            for i, x in zip(b.column(0), b.column(1)):
                if not i.is_valid or not x.is_valid or x.values.null_count:
                    continue
                v = scale * np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(v)
                top = float(np.abs(v).max(initial=0))
                length = top * float(np.linalg.norm(v / top)) if top else 0.0  # finite where the squares are not
                if not np.isfinite(length):
                    continue
                ids.append(i.as_py())
                vs.append(v.astype("<f8").tobytes())
                norm.append(length)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(norm, pa.float64()),
                                              pa.array(dims, pa.int32())], schema=schema)

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, _ROW)


def _matrix(raw: list[bytes], dims: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors count as zero in the components that they lack."""
    m = np.zeros((len(raw), dims))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, "<f8")
        m[i, : len(v)] = v
    return m


def _to_pivots(m: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances to all pivots in the space with the added coordinate."""
    a = (m * m).sum(axis=1) + extra ** 2
    b = (pivots * pivots).sum(axis=1) + pivot_extra ** 2
    return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * (m @ pivots.T + np.outer(extra, pivot_extra)), 0))


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products: int64, or Python integers where 64 bits may not hold them."""
    if not q.size or not d.size or float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < 2 ** 53:
        return (q @ d.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    s = whole(q) @ whole(d).T
    return s.astype(np.int64) if all(-2 ** 63 <= x < 2 ** 63 for x in s.flat) else s


def _solve(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best rows of the block for every query, ties to the smaller id, the query's own id left out."""
    order = np.argsort(d_ids, kind="stable")
    d_ids, d = d_ids[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], d_ids[1:] != d_ids[:-1]]))
    out_q, out_d, out_s = [], [], []
    for at in range(0, len(q), 256):
        s = _scores(q[at: at + 256], d)
        if len(first) < len(d_ids):  # several rows of one id: the best counts, once
            s = np.maximum.reduceat(s, first, axis=1)
        names = d_ids[first]
        for qi, row in zip(q_ids[at: at + 256].tolist(), s):
            want = min(k + 1, len(row))  # one more, in place of the query's own
            least = np.partition(row, len(row) - want)[len(row) - want] if row.dtype != object else sorted(row)[len(row) - want]
            above = np.flatnonzero(row > least)
            best = np.concatenate([above, np.flatnonzero(row == least)[: want - len(above)]])
            best = np.array(sorted(best.tolist(), key=lambda i: (-int(row[i]), int(names[i]))), np.int64)
            best = best[names[best] != qi][:k]
            if row.dtype == object and any(not -2 ** 63 <= x < 2 ** 63 for x in row[best]):
                raise OverflowError(f"a score of row {qi} does not fit in a long")
            out_q += [qi] * len(best)
            out_d += names[best].tolist()
            out_s += row[best].tolist()
    return out_q, out_d, out_s


def knn_join(queries: DataFrame, data: DataFrame, key: str, vector: str, k: int = 5, scale: int = 256, pivots: int = 96,
             group_queries: int = 1024, block_rows: int = 8192, seed: int = 1) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows of ``data`` with the highest integer inner products.

    Components count as floor(``scale`` x). Ties go to the smaller id. Rows
    with the query's own id are no candidates; a query with fewer candidates
    gets all. Null keys, null vectors and those holding a null or non-finite
    component take no part on either side. Of vectors of different lengths the
    shorter lacks components, which count as zero. Several data rows of one id
    count once with the best score, several queries of one id as the first by
    value. Empty tables give an empty result. Other columns are not read.
    Numbers of any size may occur: scores are exact, bounds are taken in units
    of the largest norm, and only a score beyond 64 bits among the ``k`` best of
    a block raises an OverflowError (a query's own product does not). Vectors
    whose scaled components or norm leave the doubles count as non-finite.
    """
    spark = data.sparkSession
    ship_by_value(__name__)
    rows = stored(_encode(data, key, vector, scale), "knn-data")
    asked = stored(_encode(queries, key, vector, scale).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("r")).select("id", "r.*"), "knn-queries")
    most, dims, n_rows = rows.agg(F.max("norm"), F.max("dims"), F.count(F.lit(1))).first()
    if not n_rows:
        return spark.createDataFrame([], _RESULT).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    q_dims, q_most = asked.agg(F.max(F.octet_length("v") / 8), F.max("norm")).first()
    q_dims = q_dims or 0
    dims = max(int(dims), int(q_dims), 1)

    # pivots: rows of the data, distinct in id and vector; bounded by the parameter
    chosen = {}
    for r in rows.select("id", "v").orderBy(F.xxhash64(F.lit(seed), "id"), "id", "v").limit(pivots).collect():
        if bytes(r["v"]) not in chosen.values():
            chosen.setdefault(r["id"], bytes(r["v"]))
    # distances in units of the largest norm: squares stay finite, and rounding is bounded by the slack
    unit = 2.0 ** int(np.ceil(np.log2(max(most, q_most or 0.0, 1.0))))
    norm2 = (most / unit) ** 2
    p = _matrix(list(chosen.values()), dims) / unit
    extra = lambda m: np.sqrt(np.maximum(norm2 - (m * m).sum(axis=1), 0))
    p_extra = extra(p)
    between = _to_pivots(p, p_extra, p, p_extra)
    slack = 2e-6
    sent = spark.sparkContext.broadcast((p, p_extra))

    # summaries of the query cells (at most one row a pivot)
    def query_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, piv_extra = sent.value
        for b in batches:
            m = _matrix(b.column(1).to_pylist(), dims) / unit
            if not len(m):
                continue
            x = _to_pivots(m, np.zeros(len(m)), piv, piv_extra)
            theta = np.partition(x, k, axis=1)[:, k] if x.shape[1] > k else np.full(len(m), np.inf)
            cell = x.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(x[np.arange(len(m)), cell]), pa.array(theta)],
                                             names=["id", "v", "cell", "x", "theta"])

    placed = asked.select("id", "v").mapInArrow(query_cells, "id long, v binary, cell int, x double, theta double")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("u"), F.max("theta").alias("theta")).collect()
    if not cells:
        return spark.createDataFrame([], _RESULT).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")

    # groups: neighbouring cells up to group_queries; a larger cell is split by hash
    group_of, low, high, splits = {}, [], [], []
    left = sorted(cells, key=lambda c: c["cell"])
    while left:
        members, n = [left.pop(0)], 0
        n = members[0]["n"]
        while left:
            near = min(range(len(left)), key=lambda i: between[members[0]["cell"], left[i]["cell"]])
            if n + left[near]["n"] > group_queries:
                break
            members.append(left.pop(near))
            n += members[-1]["n"]
        for c in members:
            group_of[c["cell"]] = len(splits)
        reach = [between[c["cell"]] - c["u"] - c["theta"] - slack for c in members]
        limit = [between[c["cell"]] + c["u"] + c["theta"] + slack for c in members]
        low.append(np.min(reach, axis=0))
        high.append(np.max(limit, axis=0))
        splits.append(-(-n // group_queries))
    blocks = -(-n_rows // block_rows)
    plan = spark.sparkContext.broadcast((np.array(low), np.array(high), splits))

    # replicate the data that a group needs; the queries of a group go to all its blocks
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, piv_extra = sent.value
        lo, hi, parts = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                m = _matrix(b.column(1).to_pylist(), dims) / unit
                x = _to_pivots(m, extra(m), piv, piv_extra)
                cell = x.argmin(axis=1)
                dist = x[np.arange(len(m)), cell]
                for g in range(len(parts)):
                    need = np.flatnonzero((dist >= lo[g][cell]) & (dist <= hi[g][cell]))
                    if len(need):
                        part = b.take(pa.array(need))
                        for s in range(parts[g]):
                            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g] * len(need), pa.int32()), pa.array([s] * len(need), pa.int32())],
                                                             names=["id", "v", "grp", "part"])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = rows.select("id", "v").mapInArrow(replicate, "id long, v binary, grp int, part int").withColumn("blk", block)
    group = F.element_at(F.create_map(*[F.lit(x) for c, g in group_of.items() for x in (c, g)]), F.col("cell"))
    many = F.element_at(F.array(*[F.lit(s) for s in splits]), F.col("grp") + 1)
    put = (placed.select("id", "v", group.alias("grp")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id"), many).cast("int"))
                 .withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        got = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = lambda t: np.array(t.column("id").to_pylist(), np.int64)
            got = _solve(ids(left), _matrix(left.column("v").to_pylist(), dims), ids(right), _matrix(right.column("v").to_pylist(), dims), k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), got)})

    by = ("grp", "part", "blk")
    found = put.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(solve, _RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a block
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
