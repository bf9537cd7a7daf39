"""Trees grown from histograms: decision tree, forest and second-order boosting.

A level of a tree is one pass over the rows: each task adds gradient, hessian
and row count to (node, slot) sums, where a slot is an interval of a numeric
column or a value of a categorical one; partial sums are combined by chunk of
slots, and the task that holds a chunk picks each node's best split in it, so
the driver sees one candidate for each chunk and node however many values a
column has. With gradient w y and hessian w the gain is the fall of the Gini
impurity, which grows the decision tree and, over Poisson bootstrap weights and
columns drawn per node, the forest; with those of the logistic loss the same
code boosts (Newton leaf weights with an L2 term).

Sums are whole numbers (fixed point), so they do not depend on the order of
partial sums: a rerun, or a task made again after an executor is lost, grows
the same tree bit for bit. Rows stay in the tasks as coded blocks; a model is a
table of nodes and scores by that table.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.operators.features import Features, intervals, with_codes
from lapse.session import materialize, release, ship_by_value, with_scalars

UNIT = 2 ** 24        # fixed point: rows times weight may reach 5e11
ROOM = 1 << 21        # (node, slot) pairs that a task counts densely (three sums of 8 bytes each)
MARKS = 1 << 24       # bytes that a task marks drawn values by
FEW_SUMS = 1 << 20    # partial sums of a pass that the driver adds up itself (32 bytes each)
PART_ROWS = 1 << 20   # rows of a partition of blocks, where there are more than cores have work with
CHUNK = 1 << 12       # slots that one task judges (the numeric columns' slots always stay together)
NUMERIC, VALUE = 1, 2  # kinds of split: beyond an interval end goes right; having the value goes right
NODE_SCHEMA = ("tree int, node int, depth int, kind int, column string, code long, threshold double, gain double, "
               "grad double, hess double, n long, value double")


@dataclass(frozen=True)
class Params:
    """Settings of a learner. ``columns``: share of the features drawn, per tree or per node; ``rows``: share drawn per tree, or a bootstrap."""

    trees: int = 1
    depth: int = 5
    boosting: bool = False
    rate: float = 1.0
    l2: float = 0.0
    least_rows: int = 1
    least_hess: float = 0.0
    rows: float | str = 1.0
    columns: float | str = 1.0
    seed: int = 42


#: Fixed settings of the three learners.
TREE = Params(depth=5, least_rows=50)
FOREST = Params(trees=100, depth=7, least_rows=30, rows="bootstrap", columns="sqrt per node")
BOOSTED = Params(trees=150, depth=5, boosting=True, rate=0.1, l2=1.0, least_hess=1.0, rows=0.8, columns=0.8)


def uniform(seed: int, *keys) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone (splitmix64 of each key in turn)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed)
        for k in keys:
            z = (z + np.asarray(k).astype(np.int64).view(np.uint64) if isinstance(k, np.ndarray) else z + np.uint64(k & (2 ** 64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / 2 ** 53


def poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) numbers at these quantiles (bootstrap weights)."""
    cum = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(cum, u, side="right").astype(np.int64)


class Tree:
    """Splits and values by heap number (root 1, children 2 i and 2 i + 1)."""

    def __init__(self, depth: int):
        n = 2 << depth
        self.kind, self.col, self.code, self.value = np.zeros(n, np.int8), np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n)

    def walk(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches within ``depth`` steps."""
        flat, first = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        at = np.ones(len(codes), np.int64)
        for _ in range(depth):
            kind, code, end = self.kind.take(at), flat.take(first + self.col.take(at)), self.code.take(at)
            right = np.where(kind == NUMERIC, code > end, code == end)
            at = np.where(kind > 0, 2 * at + right, at)
        return at

    def rows(self, columns: list[tuple[np.ndarray, int]], rows: np.ndarray, depth: int) -> dict[int, np.ndarray]:
        """``rows`` by the node that they reach within ``depth`` steps; ``columns`` as :func:`_columns` gives them."""
        at = {1: rows}
        for _ in range(depth):
            below = {}
            for node, mine in at.items():
                if not self.kind[node]:
                    below[node] = mine
                    continue
                codes, first = columns[self.col[node]]
                code = int(self.code[node]) - first
                right = codes[mine] > code if self.kind[node] == NUMERIC else codes[mine] == code
                below[2 * node], below[2 * node + 1] = mine[~right], mine[right]
            at = below
        return at


# --- rows as blocks ------------------------------------------------------------------


def gather(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows again, ``rows`` a batch: Arrow's own are small, and each block is one more histogram to add up."""
    held, size = [], 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for b in batches:
        at = 0
        while at < b.num_rows:
            held.append(b.slice(at, rows - size))
            at, size = at + held[-1].num_rows, size + held[-1].num_rows
            if size == rows:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def stored_block(arrays: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
    """One row: named arrays as bytes, and how many rows they hold."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary()), pa.array([n], pa.int64())], names=["block", "n"])


def dealt(stored: DataFrame) -> RDD:
    """The arrays of a table of :func:`stored_block` rows; every partition has about as many rows."""
    numbered = stored.rdd.mapPartitionsWithIndex(lambda part, found: (((part, i), r) for i, r in enumerate(found)))
    sizes = numbered.map(lambda kv: (kv[1]["n"], kv[0])).collect()
    cores = stored.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(len(sizes), cores * max(1, -(-sum(n for n, _ in sizes) // (PART_ROWS * cores)))))
    place = _deal(sizes, parts)
    return numbered.partitionBy(parts, lambda key: place[key]).map(lambda kv: {k: v for k, v in np.load(io.BytesIO(bytes(kv[1]["block"]))).items()})


def blocks(df: DataFrame, f: Features, label: str, weight: str, rows: int = 1 << 16) -> tuple[DataFrame, RDD]:
    """The stored table of coded rows in blocks, and its blocks: codes a column, label, weight, and a hash of the row that draws go by.
    Equal rows are drawn alike. Blocks are dealt so that every partition has about as many rows."""
    spans, edges, n_numeric = f.spans_of_all, [np.array(e, np.float64) for e in f.edges], len(f.numeric)
    base = f.offsets[-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.RecordBatch) -> pa.RecordBatch:
            found = {"first": np.array([lo for lo, _ in spans], np.int64), "id": part.column("_id").to_numpy()}
            for c, (lo, hi) in enumerate(spans):
                x = part.column(c)
                codes = intervals(x, edges[c]) if c < n_numeric else np.where(x.is_null().to_numpy(zero_copy_only=False), -1, x.fill_null(0).to_numpy() + (base - lo))
                found[f"c{c}"] = codes.astype(np.min_scalar_type(-max(1, hi - lo)))
            y, w = (part.column(x).to_numpy(zero_copy_only=False) for x in ("_y", "_w"))
            pairs, pair = np.unique(y + 1j * w, return_inverse=True)
            found |= {"pairs": np.stack([pairs.real, pairs.imag], axis=1), "pair": pair.astype(np.uint8)} if len(pairs) <= 256 else {"y": y, "w": w}
            return stored_block(found, part.num_rows)

        yield from map(block, gather(batches, rows))

    ship_by_value(__name__)
    ship_by_value(intervals.__module__)
    row_hash = F.xxhash64(*[F.col(c) for c in [*f.numeric, *f.categorical, label]])
    coded = with_codes(df.withColumn("_id", row_hash), f).select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(f.numeric)], *[F.col(f"{c}__code") for c in f.categorical],
                                                                 F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), "_id")
    stored = materialize(coded.mapInArrow(pack, "block binary, n long"), "tree_blocks")
    return stored, dealt(stored)


def _deal(sizes: list[tuple[int, tuple]], parts: int) -> dict[tuple, int]:
    """The part of every block: the largest first, each to the part with the fewest rows so far."""
    held = [(0, i) for i in range(parts)]
    out = {}
    for n, key in sorted(sizes, reverse=True):
        rows, i = heapq.heappop(held)
        out[key] = i
        heapq.heappush(held, (rows + n, i))
    return out


def _columns(b: dict) -> list[tuple[np.ndarray, int]]:
    """The codes of every column (-1: unknown) and the slot of its code 0."""
    if "codes" in b:  # slots themselves
        return [(b["codes"][:, c], 0) for c in range(b["codes"].shape[1])]
    return [(b[f"c{c}"], int(first)) for c, first in enumerate(b["first"])]


def _labels(b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Label and weight of every row."""
    return (b["pairs"][:, 0][b["pair"]], b["pairs"][:, 1][b["pair"]]) if "pair" in b else (b["y"], b["w"])


def _times(b: dict, number: int, p: Params) -> np.ndarray:
    """How often each row counts in a tree."""
    if p.rows == "bootstrap":
        return poisson(uniform(p.seed, number, b["id"]))
    return (uniform(p.seed, number, b["id"]) < p.rows).astype(np.int64) if p.rows < 1 else np.ones(len(b["id"]), np.int64)


def _gradients(b: dict, p: Params) -> tuple:
    """What :class:`_Weights` adds up, for all rows and whatever the tree: gradient and hessian in units; or, where
    rows have two kinds of them at most, the kind of each row and the units of the kinds."""
    units = lambda y, w: (np.rint(w * y * UNIT).astype(np.int64), np.rint(w * UNIT).astype(np.int64))
    if p.boosting:
        y, w = _labels(b)
        prob = 1 / (1 + np.exp(-b.get("margin", np.zeros(len(y)))))
        return np.rint(w * (prob - y) * UNIT), np.rint(w * prob * (1 - prob) * UNIT)
    if len(b.get("pairs", "...")) <= 2:
        return b["pair"], [*zip(*units(*b["pairs"].T))]
    g, h = units(*_labels(b))
    return g.astype(np.float64), h.astype(np.float64)


class _Weights:
    """Gradient, hessian and count of chosen rows, to be added up by key.

    Sums of whole numbers below 2^53 are exact in doubles: a block has at most
    2^16 rows. Two kinds of rows are counted in one sum, the second in its upper bits."""

    HIGH = 26

    def __init__(self, gradients: tuple, times: np.ndarray, rows: np.ndarray):
        n = times[rows]
        self.kinds = gradients[1] if isinstance(gradients[1], list) else None
        if self.kinds:
            self.parts = [(n + n * (gradients[0][rows].astype(np.int64) << self.HIGH)).astype(np.float64)]
            return
        self.parts = [gradients[0][rows] * n, gradients[1][rows] * n, n.astype(np.float64)]
        # counts go above the hessians' bits where sums of both surely fit into a long
        self.packed = len(n) > 0 and self.parts[1].min() >= 0 and self.parts[1].sum() < 2.0 ** 45 and n.sum() < 2 ** 17
        if self.packed:
            self.parts = [self.parts[0].astype(np.int64), self.parts[1].astype(np.int64) + (n.astype(np.int64) << 45)]

    def sums(self, keys: np.ndarray, size: int, pick=slice(None)) -> np.ndarray:
        """Three sums for each of ``size`` keys of the rows ``pick``."""
        if not self.kinds and self.packed:
            sums = np.zeros((3, size), np.int64)
            for into, x in zip(sums, self.parts):
                np.add.at(into, keys, x[pick])
            sums[2], sums[1] = sums[1] >> 45, sums[1] & ((1 << 45) - 1)
            return sums
        found = [np.bincount(keys, x[pick], size).astype(np.int64) for x in self.parts]
        if not self.kinds:
            return np.stack(found)
        n, second = found[0] & ((1 << self.HIGH) - 1), found[0] >> self.HIGH
        (g0, h0), (g1, h1) = self.kinds[0], self.kinds[-1]
        return np.stack([(n - second) * g0 + second * g1, (n - second) * h0 + second * h1, n])


class _Sums:
    """One tree's sums by (place of the node, slot) in a task.

    A column is counted densely while ``room`` allows, else by the keys that
    occur. Of columns and values that a forest draws per node only the drawn
    ones are counted (``drawn``: a mask of nodes and numeric columns, and the
    sorted keys of drawn values, place of the node times slots + 1, plus the slot)."""

    FEW = 64  # values of a column that are counted whether drawn or not

    def __init__(self, active: np.ndarray, spans: list[tuple[int, int]], n_slots: int, room: int, drawn: tuple | None = None):
        self.active, self.n_slots, self.total = active.tolist(), n_slots, np.zeros((3, len(active)), np.int64)
        self.plans = []  # column, its first slot and number of slots, nodes, what is held: sums, sums of certain keys, or parts
        node, slot = np.divmod(drawn[1], n_slots + 1) if drawn else (None, None)
        for c, (lo, hi) in sorted(enumerate(spans), key=lambda x: x[1][1] - x[1][0]):
            nodes, only = np.arange(len(active)), None
            if drawn and c < drawn[0].shape[1]:
                nodes = np.flatnonzero(drawn[0][:, c])
            elif drawn:
                mine = slice(None) if (lo, hi) == (0, n_slots) else (slot >= lo) & (slot < hi)
                nodes = np.unique(node[mine])
                if hi - lo > self.FEW:
                    only = np.searchsorted(nodes, node[mine]) * (hi - lo) + slot[mine] - lo
            size = len(nodes) * (hi - lo)
            if not size:
                continue
            if only is None and size > room:
                self.plans.append((c, lo, hi - lo, nodes, None, []))
                continue
            room -= 0 if only is not None else size
            self.plans.append((c, lo, hi - lo, nodes, only, np.zeros((3, size if only is None else len(only)), np.int64)))

    def add(self, columns: list[tuple[np.ndarray, int]], at: dict[int, np.ndarray], gradients: tuple, times: np.ndarray) -> None:
        """One more block: ``at``, its rows by node."""
        groups = [at.get(node, np.zeros(0, np.int64)) for node in self.active]
        every = np.arange(len(groups))
        held: dict = {}

        def of(nodes: np.ndarray) -> tuple:
            which = nodes.tobytes()
            if which not in held:
                rows = np.concatenate([groups[j] for j in nodes])
                held[which] = rows, np.repeat(np.arange(len(nodes)), [len(groups[j]) for j in nodes]), _Weights(gradients, times, rows)
            return held[which]

        rows, place, weights = of(every)
        if not len(rows):
            return
        self.total += weights.sums(place, len(groups))
        for c, lo, width, nodes, only, sums in self.plans:
            rows, place, weights = of(nodes)
            codes, first = columns[c]
            codes = codes[rows]
            keys = place * width + codes if first == lo else place * width + codes + (first - lo)
            known = None if not len(codes) or codes.min() >= 0 else codes >= 0
            size = len(nodes) * width
            if only is not None:  # look drawn values up by a mark a key, or among the sorted keys where marks would take much memory
                if size <= MARKS:
                    marks = np.zeros(size, bool)
                    marks[only] = True
                    hit = marks[np.maximum(keys, 0)]
                else:
                    hit = only[np.minimum(np.searchsorted(only, keys), len(only) - 1)] == keys
                pick = np.flatnonzero(hit if known is None else hit & known)
                sums += weights.sums(np.searchsorted(only, keys[pick]), len(only), pick)
                continue
            pick = slice(None) if known is None else np.flatnonzero(known)
            keys = keys[pick]
            if isinstance(sums, np.ndarray) and size <= 4 * len(rows):
                sums += weights.sums(keys, size, pick)
                continue
            seen, where = np.unique(keys, return_inverse=True)
            part = seen, weights.sums(where, len(seen), pick)
            if isinstance(sums, np.ndarray):
                sums[:, seen] += part[1]
            else:
                sums[:] = _add(sums, part)

    def found(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Sorted keys (place of the node times slots + 1, plus the slot; last slot: all rows of the node) and their three sums."""
        every = np.arange(len(self.active))
        keys, parts = [every * (self.n_slots + 1) + self.n_slots], [self.total]
        for _, lo, width, nodes, only, sums in self.plans:
            if isinstance(sums, list):
                if not sums:
                    continue
                at, sums = _merge(sums)
            else:
                at = np.arange(sums.shape[1]) if only is None else only
            place, code = np.divmod(at, width)
            keys.append(nodes[place] * (self.n_slots + 1) + lo + code)
            parts.append(sums)
        keys, sums = np.concatenate(keys), np.concatenate(parts, axis=1)
        there = np.flatnonzero(sums[2])
        there = there[np.argsort(keys[there])]
        return (keys[there], sums[:, there]) if len(there) else None


def _with_margin(b: dict, trees: list[Tree], depth: int) -> dict:
    """The block with the sum of the values that its rows reach in ``trees``, on top of what it has."""
    columns = _columns(b)
    margin = b["margin"].copy() if "margin" in b else np.zeros(len(b["id"]))
    for t in trees:
        for node, rows in t.rows(columns, np.arange(len(margin)), depth).items():
            margin[rows] += t.value[node]
    return {**b, "margin": margin}


def _chunk_size(n_numeric: int) -> int:
    """Slots of a chunk: the running sums of the numeric columns need all their ``n_numeric`` slots in the first one."""
    return max(CHUNK, n_numeric)


def _histogram(b: dict, number: int, tree: Tree, level: int, active: np.ndarray, margin: np.ndarray, p: Params, n_slots: int) -> tuple[np.ndarray, np.ndarray] | None:
    """One block's keys and sums, as of :meth:`_Sums.found`; columns span the slots that occur."""
    columns, times = _columns(b), _times(b, number, p)
    spans = [(int(max(0, x.min())), max(0, int(x.max())) + 1) for x, _ in columns]
    sums = _Sums(active, spans, n_slots, ROOM)
    sums.add(columns, tree.rows(columns, np.flatnonzero(times), level), _gradients(b if margin is None else {**b, "margin": margin}, p), times)
    return sums.found()


def _drawn(number: int, active: np.ndarray, p: Params, offsets: list[int], n_slots: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a tree whose features are drawn per node: which numeric columns each node may split by, and the keys of the values it may."""
    if p.columns != "sqrt per node":
        return None
    n_numeric = len(offsets) - 1
    n_features = n_numeric + n_slots - offsets[-1]
    share = math.sqrt(n_features) / n_features
    numeric = np.array([uniform(p.seed, number, node, np.arange(n_numeric)) < share for node in active.tolist()]).reshape(len(active), n_numeric)
    values = [offsets[-1] + np.flatnonzero(uniform(p.seed, number, node, np.arange(offsets[-1], n_slots)) < share) + j * (n_slots + 1) for j, node in enumerate(active.tolist())]
    return numeric, np.concatenate(values)


def _merge(parts: list[tuple]) -> tuple:
    """Sorted keys of all parts and their added sums. Keys of a part differ."""
    if len(parts) == 1:
        return parts[0]
    size, many = max(int(k[-1]) + 1 if len(k) else 0 for k, _ in parts), sum(len(k) for k, _ in parts)
    if size <= 4 * many:  # most keys occur: added in place
        sums, seen = np.zeros((len(parts[0][1]), size), np.int64), np.zeros(size, bool)
        for k, s in parts:
            sums[:, k] += s
            seen[k] = True
        keys = np.flatnonzero(seen)
        return keys, sums[:, keys]
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(np.concatenate([s for _, s in parts], axis=1)[:, order], starts, axis=1)


def _add(held: list[tuple], new: tuple) -> list[tuple]:
    """``held`` with one more part. Parts are added up only when they are of like size, so a sum is not
    touched again for every block: the work follows the keys that come in, not blocks times keys held."""
    held.append(new)
    while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
        held[-2:] = [_merge(held[-2:])]
    return held


def _chunks(number: int, found: tuple, chunk_size: int, n_slots: int) -> Iterator[tuple[tuple[int, int], tuple]]:
    """A tree's sums cut to chunks of slots; every chunk, also one without keys here, gets the sums of all rows of the nodes, as its last slot."""
    node, slot = np.divmod(found[0], n_slots + 1)
    whole = slot == n_slots
    nodes, totals = node[whole], found[1][:, whole]
    chunk_of = slot // chunk_size
    order = np.argsort(np.where(whole, -1, chunk_of), kind="stable")[len(nodes):]
    bounds = np.searchsorted(chunk_of[order], np.arange(-(-n_slots // chunk_size) + 1))
    for chunk, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        mine, size = order[lo:hi], min(chunk_size, n_slots - chunk * chunk_size) + 1
        keys = node[mine] * size + slot[mine] - chunk * chunk_size
        yield (number, chunk), _merge([(keys, found[1][:, mine]), (nodes * size + size - 1, totals)])


def gain_of(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """g^2 / (h + l2), 0 where there is nothing to divide by."""
    g, h = g / UNIT, h / UNIT + l2
    return np.divide(g * g, h, out=np.zeros_like(h, dtype=np.float64), where=h > 0)


def _best(key: tuple[int, int], found: tuple, active: np.ndarray, p: Params, offsets: list[int], n_slots: int) -> list[tuple]:
    """The best split of every node within one chunk: (tree, node, -gain, slot, kind, column, code, sums of all rows, sums of the left)."""
    number, chunk = key
    step = _chunk_size(offsets[-1])
    first = chunk * step
    size = min(step, n_slots - first) + 1
    out, n_numeric = [], len(offsets) - 1
    bounds = np.searchsorted(found[0], np.arange(len(active) + 1) * size)
    for j, node in enumerate(active.tolist()):
        lo, hi = bounds[j], bounds[j + 1]
        if lo == hi:
            continue
        slot, sums = found[0][lo:hi] - j * size + first, found[1][:, lo:hi]
        total, slot, sums = sums[:, -1], slot[:-1], sums[:, :-1]  # the last key holds all rows of the node
        left, where, kind, col, code = [], [], [], [], []
        for c in range(n_numeric):
            inside = (slot >= offsets[c]) & (slot < offsets[c + 1])
            left.append(np.cumsum(sums[:, inside], axis=1))
            where.append(slot[inside])
            code.append(slot[inside])
            kind.append(np.full(inside.sum(), NUMERIC))
            col.append(np.full(inside.sum(), c))
        inside = slot >= offsets[-1]
        left.append(total[:, None] - sums[:, inside])
        where.append(slot[inside])
        code.append(slot[inside])
        kind.append(np.full(inside.sum(), VALUE))
        col.append(np.full(inside.sum(), -1))
        left, where, kind, col, code = np.concatenate(left, axis=1), *map(np.concatenate, (where, kind, col, code))
        right = total[:, None] - left
        ok = (left[2] >= max(1, p.least_rows)) & (right[2] >= max(1, p.least_rows)) & (left[1] >= p.least_hess * UNIT) & (right[1] >= p.least_hess * UNIT)
        feature = np.where(kind == NUMERIC, col, where)  # what is drawn: a numeric column or one value
        if p.columns == "sqrt per node":
            n_features = n_numeric + n_slots - offsets[-1]
            ok &= uniform(p.seed, number, node, feature) < math.sqrt(n_features) / n_features
        elif p.columns < 1:
            ok &= uniform(p.seed, number, -1, feature) < p.columns
        if not ok.any():
            continue
        gain = gain_of(left[0], left[1], p.l2) + gain_of(right[0], right[1], p.l2) - gain_of(total[0], total[1], p.l2)
        gain[~ok] = -np.inf
        i = int(np.lexsort((where, -gain))[0])
        if gain[i] > 0:
            out.append((number, node, -float(gain[i]), int(where[i]), int(kind[i]), int(col[i]), int(code[i]), tuple(map(int, total)), tuple(map(int, left[:, i]))))
    return out


def _grow(data: RDD, numbers: list[int], p: Params, f: Features, partitions: int) -> tuple[dict[int, Tree], list[tuple]]:
    """Trees ``numbers`` together, a pass a level; boosted ones follow the blocks' margins."""
    offsets, n_slots, n_numeric = f.offsets, f.slots, len(f.numeric)
    chunk_size = _chunk_size(offsets[-1])
    trees = {t: Tree(p.depth) for t in numbers}
    active = {t: np.array([1]) for t in numbers}
    records: dict[tuple[int, int], list] = {}
    # the column of a value's slot is the categorical one whose codes it is among; rows hold it wherever it is
    spans, all_spans = f.spans, f.spans_of_all
    value = lambda s: (-p.rate * s[0] / (s[1] + p.l2 * UNIT) if p.boosting else s[0] / s[1]) if s[1] + p.l2 > 0 else 0.0

    def record(t: int, node: int, sums: tuple) -> None:
        trees[t].value[node] = value(sums)
        records[t, node] = [t, node, node.bit_length() - 1, 0, None, None, None, 0.0, sums[0] / UNIT, sums[1] / UNIT, sums[2], float(trees[t].value[node])]

    for level in range(p.depth):
        todo = {t: a for t, a in active.items() if len(a)}
        if not todo:
            break

        drawn = {t: _drawn(t, a, p, offsets, n_slots) for t, a in todo.items()}

        def partial(part: Iterator[dict], trees=trees, level=level, todo=todo, drawn=drawn) -> Iterator[tuple]:
            sums = {t: _Sums(a, all_spans, n_slots, ROOM // len(todo), drawn[t]) for t, a in todo.items()}
            for b in part:
                columns, gradients = _columns(b), _gradients(b, p)
                for t in todo:
                    times = _times(b, t, p)
                    sums[t].add(columns, trees[t].rows(columns, np.flatnonzero(times), level), gradients, times)
            for t in todo:
                if (found := sums[t].found()) is not None:
                    yield from _chunks(t, found, chunk_size, n_slots)

        parts = data.mapPartitions(partial)
        if sum(len(a) for a in todo.values()) * (n_slots + 1) * data.getNumPartitions() <= FEW_SUMS:  # one stage less
            held: dict = {}
            for key, found in parts.collect():
                held.setdefault(key, []).append(found)
            best = [s for key, found in held.items() for s in _best(key, _merge(found), todo[key[0]], p, offsets, n_slots)]
        else:
            found = parts.combineByKey(lambda v: [v], _add, lambda a, b: reduce(_add, b, a), min(partitions, len(todo) * -(-n_slots // chunk_size)))
            best = found.flatMap(lambda kv, todo=todo: _best(kv[0], _merge(kv[1]), todo[kv[0][0]], p, offsets, n_slots)).collect()
        splits: dict = {}
        for s in best:
            splits[s[:2]] = min(splits.get(s[:2], s), s)  # highest gain, then the first slot
        active = {t: [] for t in todo}
        for (t, node), (_, _, gain, slot, kind, col, code, total, left) in sorted(splits.items()):
            if level == 0:
                record(t, node, total)
            column = col if kind == NUMERIC else n_numeric + next(i for i, (a, z) in enumerate(spans) if a <= slot < z)
            tree = trees[t]
            tree.kind[node], tree.col[node], tree.code[node] = kind, column, code
            name = [*f.numeric, *f.categorical][column]
            edge = f.edges[col][code - offsets[col]] if kind == NUMERIC else None
            records[t, node][3:8] = [kind, name, None if kind == NUMERIC else slot - offsets[-1], edge, -gain]
            record(t, 2 * node, left)
            record(t, 2 * node + 1, tuple(a - b for a, b in zip(total, left)))
            active[t] += [2 * node, 2 * node + 1]
        active = {t: np.array(sorted(a), np.int64) for t, a in active.items()}
    return trees, [tuple(r) for _, r in sorted(records.items())]


def grow(df: DataFrame, f: Features, label: str, weight: str, p: Params, together: int = 25, refresh: int = 25) -> DataFrame:
    """The stored table of nodes (:data:`NODE_SCHEMA` and ``feature_value``) of trees grown on ``df``.

    ``kind`` 0: a leaf; 1: rows with ``column`` > ``threshold`` go right; 2:
    rows with ``column`` = ``feature_value`` go right. ``value``: a leaf's share
    of class 1 by weight, or its addition to the boosted log-odds. A table
    without a split (too few rows, one class) is one root, or empty for no rows.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored, base = blocks(df, f, label, weight)
    base.persist(StorageLevel.MEMORY_AND_DISK)
    rows: list[tuple] = []
    try:
        if not p.boosting:
            for at in range(0, p.trees, together):
                rows += _grow(base, list(range(at, min(at + together, p.trees))), p, f, partitions)[1]
        else:
            done: list[Tree] = []
            data = base
            for t in range(p.trees):
                if done:  # the margins with the last tree; from time to time with all trees from the coded rows: some steps of lineage, whatever the number of rounds
                    again = len(done) % refresh == 0
                    new = (base if again else data).map(lambda b, ts=done[:] if again else done[-1:]: _with_margin(b, ts, p.depth)).persist(StorageLevel.MEMORY_AND_DISK)
                else:
                    new = data
                grown, nodes = _grow(new, [t], p, f, partitions)  # its first pass stores the new margins
                if data is not base:
                    data.unpersist()
                data = new
                done.append(grown[t])
                rows += nodes
            if data is not base:
                data.unpersist()
    finally:
        base.unpersist()
        release(stored)
    if not rows:  # no split anywhere: the share of all rows
        s = df.agg(F.sum(F.col(weight) * F.col(label)), F.sum(weight), F.count("*")).first()
        if s[2]:
            rows = [(t, 1, 0, 0, None, None, None, 0.0, float(s[0]), float(s[1]), s[2], 0.0 if p.boosting else float(s[0] / s[1])) for t in range(p.trees)]
    nodes = df.sparkSession.createDataFrame(rows, NODE_SCHEMA)
    values = f.dictionary.select("code", F.col("value").alias("feature_value"))
    return materialize(nodes.join(values, "code", "left").select(*nodes.columns, "feature_value"), "tree_nodes")


# --- use of a node table --------------------------------------------------------------


def score(df: DataFrame, nodes: DataFrame, p: Params, name: str = "score") -> DataFrame:
    """``df`` with the probability of class 1 by the node table (at most trees x 2^(depth + 1) rows, which every task gets).

    Values that the training rows lacked take no split's right side; NULL and
    unknown numbers go left.
    """
    ship_by_value(__name__)
    ship_by_value(intervals.__module__)
    table = sorted(nodes.collect(), key=lambda r: (r["tree"], r["node"]))
    numeric = sorted({r["column"] for r in table if r["kind"] == NUMERIC})
    values = sorted({r["column"] for r in table if r["kind"] == VALUE})
    seen = {c: sorted({r["feature_value"] for r in table if r["kind"] == VALUE and r["column"] == c}) for c in values}
    ends = {c: sorted({r["threshold"] for r in table if r["kind"] == NUMERIC and r["column"] == c}) for c in numeric}
    cols = numeric + values
    place = {c: {v: i for i, v in enumerate(held)} for c, held in [*ends.items(), *seen.items()]}
    trees: dict[int, Tree] = {}
    for r in table:
        t = trees.setdefault(r["tree"], Tree(p.depth))
        t.value[r["node"]], t.kind[r["node"]] = r["value"], r["kind"]
        if r["kind"]:
            t.col[r["node"]] = cols.index(r["column"])
            t.code[r["node"]] = place[r["column"]][r["threshold"] if r["kind"] == NUMERIC else r["feature_value"]]
    forest = list(trees.values())
    # codes by the splits' own ends and values: how many ends lie below the number, place of the value
    sent = [F.col(c).cast("double") for c in numeric] + [F.col(c).cast("string") for c in values]
    edges, names = [np.array(ends[c], np.float64) for c in numeric], [pa.array(seen[c], pa.string()) for c in values]

    @F.arrow_udf("double")
    def probability(*args: pa.Array) -> pa.Array:
        codes = np.empty((len(args[0]), max(1, len(cols))), np.int32)
        for i, x in enumerate(args[:len(cols)]):
            codes[:, i] = intervals(x, edges[i]) if i < len(edges) else pc.fill_null(pc.index_in(x, names[i - len(edges)].cast(x.type), skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        total = np.zeros(len(codes))
        for t in forest:
            total = total + t.value[t.walk(codes, p.depth)]
        if not p.boosting:
            total = total / max(1, len(forest))
        return pa.array(1 / (1 + np.exp(-total)) if p.boosting else total)

    return df.withColumn(name, probability(*sent) if sent else probability(F.lit(0.0)))


def importance(nodes: DataFrame, p: Params) -> DataFrame:
    """``feature``, ``importance`` (sums to 1): a tree's or forest's share of the gain, averaged over trees; boosting: mean gain of a feature's splits."""
    named = nodes.where("kind > 0").withColumn("feature", F.when(F.col("kind") == VALUE, F.concat_ws("_", "column", "feature_value")).otherwise(F.col("column")))
    if p.boosting:
        per = named.groupBy("feature").agg((F.sum("gain") / F.count("*")).alias("g"))
    else:
        total = named.groupBy(F.col("tree").alias("_t")).agg(F.sum("gain").alias("_all"))
        per = named.join(total, F.col("tree") == F.col("_t")).groupBy("feature").agg(F.sum(F.col("gain") / F.col("_all")).alias("g"))
    return with_scalars(per, per.agg(F.sum("g").alias("_sum"))).select("feature", (F.col("g") / F.col("_sum")).alias("importance"))
