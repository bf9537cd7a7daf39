"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed byte n-grams (lengths 3 to 5, A-Z in lower
case) that occur in it, each once. For every feature, r is the log ratio of
its smoothed share among toxic and other training texts, drawn towards zero by
``doubt`` standard errors of itself (zero within them), so that an n-gram
counts for what its occurrences bear out. A present feature f has the value
r_f, and logistic regression with an L2 penalty gives its weight. All buckets
are judged by this one rule and no number of features is set: they grow with
the evidence. A score is the logistic function of intercept + sum of weight_f r_f over
the features present.

Labels are learnt from a seeded sample of about ``sample`` labelled rows (a
documented bound, so the fit costs the same at any size), drawn by class from
the labels whose key the table holds. The regression is solved in its dual in
the tasks (CoCoA+: Ma et al., ICML 2015): the sample is dealt to groups of some
``GROUP_BYTES`` of text, each group ascends its own dual variables from the
shared weights, and the sums of the groups' moves are the next weights. The
driver holds the weights, one number a bucket, and one dual variable a row; no
text and no features. Every row is scored in one pass over the texts, without
a shuffle; the broadcast model holds 2 ** BITS numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.common import discard, stored
from lapse.session import ship_by_value

BITS = 20  # features are hashed to 2 ** BITS buckets
LENGTHS = (3, 4, 5)
GROUP_BYTES = 1 << 23  # text of one group of the fit
_RANGES = 16  # the buckets are counted in so many ranges


def ngrams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct n-gram buckets of a text; ``seen`` is scratch of 2 ** BITS int32 that needs no clearing."""
    b = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    parts = []
    for n in LENGTHS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + b[k: k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        parts.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    if not parts:
        return np.zeros(0, np.int32)
    g = np.concatenate(parts)
    at = np.arange(len(g), dtype=np.int32)
    seen[g] = at  # the last occurrence of each wins
    return g[seen[g] == at]


@dataclass(frozen=True)
class Model:
    """Log-count ratios, weights times ratios (both by bucket), and the intercept; without ``evidence`` nothing was learnt."""
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    evidence: bool = True


def _counts(train: DataFrame) -> DataFrame:
    """(range, counts): binary int32 pairs (toxic, other) of every bucket of a range, one row per task and range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, rows = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int32), 0
        for b in batches:
            for t, y in zip(b.column(0), b.column(1)):
                total[0 if y.as_py() else 1, ngrams(t.as_py(), seen)] += 1
                rows += 1
        if rows:
            size = (1 << BITS) // _RANGES
            yield pa.RecordBatch.from_arrays([pa.array(range(_RANGES), pa.int32()),
                                              pa.array([total[:, i * size: (i + 1) * size].tobytes() for i in range(_RANGES)], pa.binary())], names=["range", "counts"])

    return train.select("t", "y").mapInArrow(run, "range int, counts binary")


def _summed(parts: DataFrame, column: str, dtype: str) -> np.ndarray:
    """The sum of the arrays that ``parts`` holds by range, one array over all ranges."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), dtype) for c in rows.column(column))
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    rows = parts.where("range >= 0").groupBy("range").applyInArrow(run, "range int, total binary").collect()
    return np.concatenate([np.frombuffer(x["total"], dtype).reshape(-1, (1 << BITS) // _RANGES) for x in sorted(rows, key=lambda x: x["range"])], axis=1)


def log_count_ratios(p: np.ndarray, q: np.ndarray, pos: int, neg: int, alpha: float, doubt: float) -> np.ndarray:
    """The log ratios of (p + alpha) / (pos + 2 alpha) to (q + alpha) / (neg + 2 alpha), nearer to zero by ``doubt`` standard errors."""
    r = np.log((p + alpha) / (pos + 2 * alpha)) - np.log((q + alpha) / (neg + 2 * alpha))
    error = np.sqrt(1 / (p + alpha) + 1 / (q + alpha))
    return np.sign(r) * np.maximum(0.0, np.abs(r) - doubt * error)


def dual_step(a: float, z: float, q: float) -> float:
    """The a in (0, 1) that maximises the dual along one row: log(a' / (1 - a')) + z + q (a' - a) = 0, by bracketed Newton."""
    lo, hi, x = 0.0, 1.0, min(max(a, 1e-9), 1 - 1e-9)
    for _ in range(40):
        f = math.log(x / (1 - x)) + z + q * (x - a)
        if abs(f) < 1e-8:
            break
        if f > 0:
            hi = x
        else:
            lo = x
        new = x - f / (1 / (x * (1 - x)) + q)
        x = new if lo < new < hi else (lo + hi) / 2
        if hi - lo < 1e-14:
            break
    return x


def ascend(found: list[np.ndarray], y: np.ndarray, c: np.ndarray, a: np.ndarray, r: np.ndarray, w: np.ndarray, groups: int, scale: float,
           epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``epochs`` of exact dual coordinate ascent over the rows of one group; the new dual variables and the move of the weights.

    ``found`` lists the buckets of each row, ``y`` is 1 or -1, ``c`` what the
    loss of a row weighs (its dual variable is c a, a in (0, 1)), ``w`` the
    shared weights with the intercept last (a feature of value 1 in every
    row), ``scale`` L2 times the number of rows. ``groups`` is CoCoA+'s safe
    bound, by which moves of all groups may be added.
    """
    u, a, rng = w.copy(), a.copy(), np.random.default_rng(seed)
    norms = [1.0 + float(r[f] @ r[f]) for f in found]
    for _ in range(epochs):
        for i in rng.permutation(len(found)):
            f = found[i]
            rf = r[f]
            new = dual_step(a[i], y[i] * (float(u[f] @ rf) + u[-1]), groups * c[i] * norms[i] / scale)
            move = groups * c[i] * (new - a[i]) * y[i] / scale
            u[f] += move * rf
            u[-1] += move
            a[i] = new
    return a, (u - w) / groups


def _fit(train: DataFrame, rows: int, weigh: dict[int, float], groups: int, r: np.ndarray, l2: float, rounds: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept: logistic regression on the present features (value r), mean loss (weighed by class) plus l2 / 2 |w|^2."""
    sc = train.sparkSession.sparkContext
    w, duals = np.zeros((1 << BITS) + 1), {}
    ratios = sc.broadcast(r)
    for at in range(rounds):
        sent = sc.broadcast((w, duals))

        def run(key: tuple, part: pa.Table) -> pa.Table:
            group = key[0].as_py()
            shared, known = sent.value
            part = part.sort_by([("h", "ascending"), ("t", "ascending")])
            seen = np.zeros(1 << BITS, np.int32)
            found = [f[ratios.value[f] != 0] for f in (ngrams(t.as_py(), seen) for t in part.column("t"))]
            y = np.where(np.array(part.column("y")) > 0, 1.0, -1.0)
            c = np.where(y > 0, weigh[1], weigh[0])
            a, move = ascend(found, y, c, known.get(group, np.full(len(y), 0.0)), ratios.value, shared, groups, l2 * rows, epochs, seed + at)
            size = (1 << BITS) // _RANGES
            return pa.table({"range": pa.array([-1, *range(_RANGES)], pa.int32()), "part": pa.array([group] * (_RANGES + 1), pa.int64()),
                             "d": pa.array([a.tobytes(), *[move[i * size: (i + 1) * size].tobytes() for i in range(_RANGES)]], pa.binary()),
                             "bias": pa.array([float(move[-1])] + [None] * _RANGES, pa.float64())})

        moved = stored(train.groupBy("part").applyInArrow(run, "range int, part long, d binary, bias double"), "toxic-round")
        mine = moved.where("range < 0").orderBy("part").collect()  # one number a row of the bounded sample
        before, duals = duals, {x["part"]: np.frombuffer(x["d"], np.float64) for x in mine}
        w = w + np.append(_summed(moved.select("range", "d"), "d", "f8")[0], sum(x["bias"] for x in mine))
        discard(moved)
        sent.destroy()
        if before and max(np.abs(duals[g] - before[g]).max() for g in duals) < 1e-3:
            break
    ratios.destroy()
    return w[:-1], float(w[-1])


def train_toxicity(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = 20_000,
                   seed: int = 3, alpha: float = 0.5, doubt: float = 2.0, l2: float = 1e-4, rounds: int = 6, epochs: int = 4) -> Model:
    """Fit on the rows of ``df`` whose key is in ``labels`` (a null label is none; of several, the highest holds).

    Only labels of keys that ``df`` holds count. Of those a seeded draw of
    about ``sample`` is used, by class: all of the rarer class up to half the
    bound, the other class fills the rest; the losses of the classes weigh as
    the classes do among all of them. The draw is the one side that is
    broadcast, and its size is bounded by ``sample``. The fit ends when no
    dual variable moves by more than 0.001, or after ``rounds`` rounds of
    ``epochs`` passes.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg((F.max(label) > 0).cast("int").alias("y"))
    marked = stored(marked.join(df.select(F.col(key).alias("_k")), "_k", "left_semi"), "toxic-labels")
    total = {x["y"]: x["count"] for x in marked.groupBy("y").count().collect()}
    rare = min((0, 1), key=lambda y: total.get(y, 0))
    bound = {rare: min(total.get(rare, 0), sample // 2)}
    bound[1 - rare] = sample - bound[rare]
    if any(n > bound[y] for y, n in total.items()):
        hashed = F.pmod(F.xxhash64(F.lit(seed), "_k"), F.lit(1 << 30))
        upto = {y: int(min(1.0, bound[y] / max(1, total.get(y, 0))) * (1 << 30)) for y in (0, 1)}
        marked = marked.where(hashed < F.when(F.col("y") == 1, upto[1]).otherwise(upto[0]))
    train = (df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("t")).join(F.broadcast(marked), "_k")
               .groupBy("_k").agg(F.min("t").alias("t"), F.first("y").alias("y")))  # a repeated key counts once
    train = stored(train.select(F.xxhash64(F.lit(seed + 1), "_k").alias("h"), F.coalesce("t", F.lit("")).alias("t"), "y"), "toxic-train")
    size = {x["y"]: x for x in train.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("t")).alias("bytes")).collect()}
    if len(size) < 2:  # one class: the score is the share of toxic rows
        none = np.zeros(1 << BITS)
        return Model(none, none, float(np.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5))), False)
    pos, neg = size[1]["rows"], size[0]["rows"]
    groups = -(-(size[0]["bytes"] + size[1]["bytes"] + 1) // GROUP_BYTES)
    ship_by_value(__name__)
    p, q = _summed(_counts(train), "counts", "i4")
    r = log_count_ratios(p, q, pos, neg, alpha, doubt)
    if not r.any():  # no n-gram tells the classes apart
        return Model(r, r, float(np.log(total[1] / total[0])), False)
    parts = train.withColumn("part", F.pmod("h", F.lit(groups)))
    share = {y: total[y] / (total[0] + total[1]) / (size[y]["rows"] / (pos + neg)) for y in (0, 1)}
    w, b = _fit(parts, pos + neg, share, groups, r, l2, rounds, epochs, seed)
    discard(train)
    return Model(r, w * r, b)


def score_toxicity(df: DataFrame, model: Model, text: str, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` columns and ``score`` (0 to 1; in place of a carried column of that name) of every row; a null or empty text scores the intercept."""
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, b0 = sent.value
        seen = np.zeros(1 << BITS, np.int32)
        for b in batches:
            z = np.array([b0 + table[ngrams(t.as_py(), seen)].sum() for t in b.column(0)], np.float64)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score, pa.float64())], names=[*b.schema.names[1:], "_score"])

    ship_by_value(__name__)
    rows = df.select(F.col(text).cast("string").alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("_score", T.DoubleType())]))
    return out.select(*[F.col(f"_c_{c}").alias(c) for c in carry if c != "score"], F.col("_score").alias("score"))


def fold(key: str) -> Column:
    """crc32 of the key as text (null: empty) mod 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4


def toxicity(df: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "toxic", held_out: int = 2,
             threshold: float = 0.3, carry: tuple[str, ...] = (), **fit) -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` of every row, with ``carry``.

    Labels are learnt only from keys outside fold ``held_out``. Labels, and
    columns beside the text, are no input of a score, so equal texts score
    alike. Null and empty texts have no n-gram and score the intercept; repeated
    rows come out as they came in; without labels the score is one half for
    all. Carried columns named like the four are left out. ``predicted`` is the
    score against ``threshold`` and no more: a model without features gives it
    to all rows or to none, so filters use :func:`not_rejected`.
    """
    if key in ("held_out", "score", "predicted"):
        raise ValueError(f"the key is named like a result: {key}")
    carry = tuple(c for c in carry if c not in (key, "held_out", "score", "predicted"))
    model = train_toxicity(df, labels.where(fold(key) != held_out), key, text, label, **fit)
    out = score_toxicity(df, model, text, (key, *carry))
    return out.select(F.col(key), (fold(key) == held_out).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)


def not_rejected(df: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "toxic", held_out: int = 2,
                 threshold: float = 0.3, carry: tuple[str, ...] = (), **fit) -> DataFrame:
    """``carry`` columns of the rows that :func:`toxicity` predicts 0.

    Where the training rows tell nothing apart (no usable label, one class
    only, or no n-gram whose counts differ beyond doubt) there is no evidence against any row, and all are kept.
    """
    model = train_toxicity(df, labels.where(fold(key) != held_out), key, text, label, **fit)
    if not model.evidence:
        return df.select(*carry)
    boxed = df.select(F.struct(*[F.col(c) for c in carry]).alias("_row"), F.col(text).alias("_text"))
    return score_toxicity(boxed, model, "_text", ("_row",)).where(F.col("score") < threshold).select("_row.*")
