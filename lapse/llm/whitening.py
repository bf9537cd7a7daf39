"""Embedding whitening with distributed block matrices.

Rows get dense indices, are centred and put into blocks of an MLlib
``BlockMatrix``. The transpose times the matrix is the scatter, its middle
dimension split over tasks and the partial products added on the way; the
scatter of d columns is d x d, so its eigenvectors are found locally. A second
``BlockMatrix`` product by the whitening matrix projects all rows.

Components count as whole numbers x = floor(scale c). The mean is the exact
quotient of whole sums: a row is centred as (x - q) - r/n, where q and r are
quotient and remainder of the sum by n, which loses nothing however far the
data lie from zero. ``BlockMatrix`` names rows by 32-bit numbers and keeps a
map of its blocks on the driver, so larger tables are cut to slabs of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from lapse.llm import vectors
from lapse.llm.common import stored
from lapse.llm.vectors import matrix, whole_vector
from lapse.session import ship_by_value

#: Local and global part of the numbers that ``monotonically_increasing_id`` gives.
_LOCAL = 33
_HALF = 1 << 31
_CENTRED = StructType().add("c", ArrayType(DoubleType())).add("deviation", "long")
_WHITENED = StructType().add("whitened", ArrayType(DoubleType())).add("deviation", "long")
_COMPONENTS = "component int, n long, eigenvalue double, explained double, unit array<double>, identity_error double"


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` stored, with ``i``: 0, 1, ... without gaps. Row numbers within write tasks are stored, task offsets added."""
    raw = stored(df.withColumn("_m", F.monotonically_increasing_id()), "whitening-rows")
    task = F.shiftright("_m", _LOCAL)
    sizes = raw.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # one row a write task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_task", before.alias("_off"))
    return (raw.withColumn("_task", task).join(offsets, "_task")
               .withColumn("i", F.col("_off") + F.col("_m") - F.shiftleft("_task", _LOCAL)).drop("_m", "_task", "_off"))


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Exact sum of every component: halves of the numbers are added in 64 bits a batch, batches as decimals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for b in batches:
            for at in range(0, b.num_rows, 100_000):
                x = matrix(b.column(0).slice(at, 100_000), dims).astype(np.int64)
                high, low = (x >> 31).sum(axis=0), (x & (_HALF - 1)).sum(axis=0)
                total = [t + int(h) * _HALF + int(w) for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["d", "s"])

    got = fit.select("x").mapInArrow(run, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s")).collect()
    by = {r["d"]: int(r["s"]) for r in got}
    return [by[d] for d in range(dims)]


def centre(x: np.ndarray, q: list[int], r: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows less the mean q + r/n, and the exact sum of (n x - S)^2 of every row (an OverflowError beyond 64 bits)."""
    r_of, small = np.array(r, object), 2 ** 62
    if float(np.abs(x).max(initial=0)) < small and max(map(abs, q), default=0) < small:
        whole = x.astype(np.int64) - np.array(q, np.int64)
    else:
        whole = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) - np.array(q, object)
    most = int(np.abs(whole).max(initial=0))
    if (n * most + n) ** 2 * x.shape[1] < 2 ** 63:
        scaled = n * whole.astype(np.int64) - r_of.astype(np.int64)
        deviation = (scaled * scaled).sum(axis=1)
    else:
        deviation = ((n * whole.astype(object) - r_of) ** 2).sum(axis=1)
        if max(deviation, default=0) >= 2 ** 63:
            raise OverflowError("a deviation does not fit in a long")
    return whole.astype(np.float64) - r_of.astype(np.float64) / n, deviation.astype(np.int64)


def _centred(df: DataFrame, keep: list[str], mean: tuple[list[int], list[int], int], dims: int) -> DataFrame:
    """The columns ``keep``, ``c`` (the centred row) and ``deviation``."""
    schema = StructType([*df.select(*keep).schema.fields, *_CENTRED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                c, deviation = centre(matrix(part.column(len(keep)), dims), *mean)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, dims), pa.int32()), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in range(len(keep))], lists, pa.array(deviation, pa.int64())], names=[*keep, "c", "deviation"])

    return df.select(*keep, "x").mapInArrow(run, schema)


def _blocks(df: DataFrame, slab: int, slab_rows: int, rows: int, dims: int, rows_block: int, cols_block: int) -> BlockMatrix:
    """The rows of one slab as a BlockMatrix; rows that ``df`` lacks are zero.

    A product reads its blocks three times, so they are kept (and made again from the stored rows if an executor is lost)."""
    first = slab * slab_rows
    part = df.where((F.col("i") >= first) & (F.col("i") < first + slab_rows)).select((F.col("i") - first).alias("i"), array_to_vector("c").alias("v"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(part, "v"), min(slab_rows, rows - first), dims)
    return indexed.toBlockMatrix(rows_block, cols_block).persist(StorageLevel.MEMORY_AND_DISK)


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b, the middle dimension dealt to ``splits`` tasks (Python's ``multiply`` lacks this parameter)."""
    java = a._java_matrix_wrapper._java_model.multiply(b._java_matrix_wrapper._java_model, int(splits))
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def eigen(scatter: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of scatter / n, falling, and unit eigenvectors as columns (largest entry positive), without those below ``least`` times the first; the trace."""
    cov = (scatter + scatter.T) / (2 * n)
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1], units[:, ::-1]
    units = units * np.where(units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])] < 0, -1.0, 1.0)
    keep = values > max(least * values[0], 0) if len(values) else np.zeros(0, bool)
    return values[keep], units[:, keep], float(np.trace(cov))


def whiten(rows: DataFrame, key: str, vector: str, components: int | None = None, scale: int = 256, least: float = 1e-10, carry: Iterable[str] = (),
           block_values: int = 1 << 18, cols_block: int = 1024, slab_rows: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """Two tables: the whitened rows and the components.

    Rows: the key, ``carry``, ``whitened`` (array: the centred row on each
    component over the root of its eigenvalue) and ``deviation`` (sum of
    (n x - S)^2 over the dimensions, exact). Components: ``component`` (from 1),
    ``n``, ``eigenvalue``, ``explained`` (of the trace), ``unit`` (array),
    ``identity_error`` (largest entry of the whitened covariance less the
    identity, the same on all rows).

    Mean and covariance (divisor n) are of the fit list, each distinct vector x
    once. Null vectors and those holding a null or non-finite component are
    dropped; null keys are kept. Shorter vectors are filled up with zeros.
    Components with an eigenvalue of at most ``least`` times the first are
    left out, since no double-precision covariance tells them from zero: a
    single distinct vector has no component and gives two empty tables, as an
    empty table does. Every row of a repeated row is returned. Equal
    eigenvalues leave their vectors free within their plane; the order of
    additions may change last digits from run to run. A component of 2^63 or
    more, or a deviation beyond 64 bits, raises. Other columns are not read; a
    ``carry`` column named like an output raises.
    """
    spark = rows.sparkSession
    ship_by_value(__name__)
    ship_by_value(vectors.__name__)
    carry = list(carry)
    if clash := {key, *carry} & {"whitened", "deviation"}:
        raise ValueError(f"columns named like outputs: {sorted(clash)}")
    box = F.struct(*[F.col(f"`{c}`") for c in (key, *carry)])
    too_large = lambda c: F.abs(c) >= F.lit(float(2 ** 63))
    x = whole_vector(F.col(f"`{vector}`"), scale)
    valid = (rows.select(box.alias("box"), x.alias("x")).where("x IS NOT NULL")
                 .withColumn("x", F.when(F.exists("x", too_large), F.raise_error(F.lit("a component does not fit in a long"))).otherwise(F.col("x"))))
    numbered = _numbered(valid)
    total, dims = numbered.agg(F.count("*"), F.max(F.size("x"))).first()
    head = [F.col("box")[c].alias(c) for c in (key, *carry)]
    empty = spark.createDataFrame([], StructType([*numbered.schema["box"].dataType.fields, *_WHITENED.fields])), spark.createDataFrame([], _COMPONENTS)
    if not total or not dims:
        return empty
    wide = numbered.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x"))))
    fit = stored(wide.groupBy("x").agg(F.min("i").alias("i")), "whitening-fit")
    n = fit.count()
    mean = [divmod(s, n) for s in _sums(fit, dims)]
    mean = [m[0] for m in mean], [m[1] for m in mean], n

    rows_block = max(64, block_values // min(dims, cols_block))
    cut = (slab_rows, total, dims, rows_block, cols_block)
    slabs, parts = range(-(-total // slab_rows)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit_rows = stored(_centred(fit, ["i"], mean, dims), "whitening-fit-centred")
    held = {r["slab"] for r in fit_rows.groupBy(F.floor(F.col("i") / slab_rows).alias("slab")).count().collect()}
    scatter = np.zeros((dims, dims))
    for s in slabs:
        if s in held:  # a slab may hold only copies of earlier rows
            a = _blocks(fit_rows, s, *cut)
            scatter += _product(a.transpose(), a, min(parts, -(-slab_rows // rows_block))).toLocalMatrix().toArray()
            a._java_matrix_wrapper._java_model.blocks().unpersist(False)
    values, units, trace = eigen(scatter, n, least)
    k = len(values) if components is None else min(components, len(values))
    if not k:
        return empty
    weights = units[:, :k] / np.sqrt(values[:k])
    pieces = [((b, 0), Matrices.dense(len(w), k, w.ravel(order="F").tolist())) for b, w in
              ((at // cols_block, weights[at: at + cols_block]) for at in range(0, dims, cols_block))]
    by = BlockMatrix(spark.sparkContext.parallelize(pieces, len(pieces)), cols_block if dims > cols_block else dims, k, dims, k)

    all_rows = stored(_centred(wide, ["i", "box"], mean, dims), "whitening-centred")
    white, kept = None, []
    for s in slabs:
        a = _blocks(all_rows, s, slab_rows, total, dims, rows_block, min(cols_block, dims))
        kept.append(a)
        got = callMLlibFunc("getIndexedRows", _product(a, by, 1).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        got = got.toDF("i", "w").select((F.col("i") + s * slab_rows).alias("i"), vector_to_array("w").alias("whitened"))
        white = got if white is None else white.unionByName(got)
    white = stored(white, "whitening-projected")
    for a in kept:
        a._java_matrix_wrapper._java_model.blocks().unpersist(False)

    # covariance of the whitened fit list: centred first, k (k + 1) / 2 sums
    y = white.join(fit_rows.select("i"), "i", "left_semi").select("whitened")
    mu = y.agg(*[F.avg(F.col("whitened")[a]) for a in range(k)]).first()
    off = lambda a: F.col("whitened")[a] - F.lit(float(mu[a]))
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    cov = y.agg(*[F.sum(off(a) * off(b)) for a, b in pairs]).first()
    error = max(abs(c / n - (a == b)) for c, (a, b) in zip(cov, pairs))

    table = [(j + 1, n, float(values[j]), float(values[j] / trace), [float(v) for v in units[:, j]], float(error)) for j in range(k)]
    out = all_rows.select("i", "box", "deviation").join(white, "i").select(*head, "whitened", "deviation")
    return out, spark.createDataFrame(table, _COMPONENTS)
